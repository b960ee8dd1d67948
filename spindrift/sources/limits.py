"""What a reader does to be polite to a service: a token bucket and retries."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


class TokenBucket:
    """Lets `rate` calls through in `per` seconds, all at once if none came before; acquire() sleeps for a token."""

    def __init__(self, rate: float, per: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.per, self.clock, self.sleep = rate, per, clock, sleep
        self.tokens, self.at = rate, clock()

    def acquire(self) -> float:
        """Takes a token, and returns the seconds slept for it."""
        now = self.clock()
        self.tokens = min(self.rate, self.tokens + (now - self.at) * self.rate / self.per)
        self.at = now
        wait = max(0.0, 1 - self.tokens) * self.per / self.rate
        if wait:
            self.sleep(wait)
            self.at += wait
            self.tokens += wait * self.rate / self.per
        self.tokens -= 1
        return wait


def retried(call: Callable[[], T], attempts: int = 3, least: float = 2, most: float = 10, on: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> T:
    """What call() returns; of the given errors so many are waited out, each twice as long as the one before, the last is raised."""
    for n in range(attempts - 1):
        try:
            return call()
        except on:
            sleep(min(most, max(least, 2.0**n)))
    return call()
