"""Jobs in the background, one run of each at a time."""

from __future__ import annotations

import threading
from collections.abc import Callable


class AlreadyRunning(RuntimeError):
    """A job was started while it ran."""


class Job:
    """Runs a function in a thread; a second start while it runs is refused."""

    def __init__(self, name: str, run: Callable[[], object]) -> None:
        self.name, self.run, self.result, self.error = name, run, None, None
        self._lock, self._thread = threading.Lock(), None

    def start(self) -> None:
        with self._lock:
            if self._thread is not None and self._thread.is_alive():
                raise AlreadyRunning(self.name)
            self.result = self.error = None
            self._thread = threading.Thread(target=self._work, name=self.name, daemon=True)
            self._thread.start()

    def _work(self) -> None:
        try:
            self.result = self.run()
        except Exception as e:  # noqa: BLE001  kept for status(), whatever it is
            self.error = e

    def wait(self, seconds: float | None = None) -> None:
        if self._thread is not None:
            self._thread.join(seconds)

    def status(self) -> dict:
        running = self._thread is not None and self._thread.is_alive()
        state = "running" if running else "idle" if self._thread is None else "failed" if self.error else "done"
        return {"name": self.name, "state": state, "error": str(self.error) if self.error else None}
