"""Byte-level BPE encoding and decoding by merge replay over a corpus slice.

Each batch of texts is a slice. Its texts are cut into chunks (an optional space and what follows up to the next
white space, or white space alone), the chunks into the pattern's pieces, and the distinct pieces that are new to
the task are encoded together. A merge looks only at the pairs to its left and right. Pieces of up to LONG bytes, the
main path, have their pairs' positions in arrays, sorted by piece: each round merges every piece's own lowest rank, so
one piece doesn't wait for lower ranks of others (an exit from rank order over all pieces; ids are the same, the README
has figures). Longer pieces have an inverted index from pair to positions, by rank, with a heap of ranks over one linked
list, and are replayed in rank order all at once, so a piece of n bytes costs n log n. Ids, their decimal form and the
decoded bytes of a chunk are kept for a
bounded number of chunks, so frequent chunks cost a look-up. Every text is a row; nothing is shuffled or gathered."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space, which is what the pattern's \s takes.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Chunks and pieces kept by a task, and pieces that are replayed together.
KEPT, TOGETHER = 250_000, 100_000
#: Bytes of a piece that is replayed with others in arrays; longer ones go by the linked list. No rank.
LONG, NONE = 48, 1 << 60


def ids_at(raw: bytes) -> np.ndarray:
    """Of each two neighbouring bytes, their place in a table of 256 by 256."""
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    return b[:-1] << 8 | b[1:]


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Replay:
    """Encodes byte strings by the ranks, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int | None] = {}
        self.singles = np.array(self.single, np.int64)
        keys, merged = [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(r)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.bytes_ranks = self._ranks_of(np.repeat(self.singles, 256), np.tile(self.singles, 256))

    def rank(self, a: int, b: int) -> int | None:
        """The rank of two neighbouring tokens, None if they don't merge."""
        try:
            return self.pairs[a, b]
        except KeyError:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            r = self.pairs[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            return r

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece: of the piece itself where it is a token, else of its replayed merges."""
        out: list[list[int]] = [[w] if (w := self.ranks.get(p)) is not None else [] for p in pieces]
        for most, replay in ((LONG, self._replay_short), (1 << 62, self._replay)):
            rest = [k for k, (p, ids) in enumerate(zip(pieces, out, strict=True)) if not ids and p and len(p) <= most]
            for at in range(0, len(rest), TOGETHER):
                some = rest[at : at + TOGETHER]
                for k, ids in zip(some, replay([pieces[k] for k in some]), strict=True):
                    out[k] = ids
        return out

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of neighbouring tokens, NONE where they don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def _replay_short(self, pieces: list[bytes]) -> list[list[int]]:
        """The replay over many short pieces. The index is an array here: positions by piece and rank. Each round takes
        the lowest rank of every piece that has any, at its first position, and looks up the two pairs it touches."""
        sizes = np.array([len(p) for p in pieces])
        ids = self.singles[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(ids), NONE)
        if len(ids) > 1:
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.bytes_ranks[ids_at(b"".join(pieces))], NONE)
        done_ids, done_owner = [], []
        while len(ids):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            each = np.diff(np.append(starts, len(ids)))
            over = np.repeat(lowest == NONE, each)
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, rank = ids[~over], owner[~over], rank[~over]
                starts, each, lowest = np.flatnonzero(np.diff(owner, prepend=-1)), each[lowest != NONE], lowest[lowest != NONE]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, each))
            first = hits[np.flatnonzero(np.diff(owner[hits], prepend=-1))]
            ids[first] = lowest
            keep = np.ones(len(ids), bool)
            keep[first + 1] = False
            at = first - np.arange(len(first))  # where the merged tokens are once their right halves have gone
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            rank[at] = NONE
            right = at[(at + 1 < len(ids)) & (owner[np.minimum(at + 1, len(ids) - 1)] == owner[at])]
            rank[right] = self._ranks_of(ids[right], ids[right + 1])
            left = at[(at > 0) & (owner[at - 1] == owner[at])]
            rank[left - 1] = self._ranks_of(ids[left - 1], ids[left])
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        ids = ids[np.argsort(owner, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _replay(self, pieces: list[bytes]) -> list[list[int]]:
        single, rank = self.single, self.rank
        ids: list[int] = []
        ends: list[int] = []
        for p in pieces:
            ids += [single[b] for b in p]
            ends.append(len(ids))
        n = len(ids)
        after, before, last = list(range(1, n + 1)), list(range(-1, n - 1)), set()
        start = 0
        for e in ends:
            if e > start:
                before[start], after[e - 1] = -1, n
            start = e
        # where: rank -> positions whose pair has it, maybe no more; at: the rank of each position's pair
        where: dict[int, list[int]] = {}
        at: list[int] = [-1] * n
        for i in range(n):
            if after[i] < n and (r := rank(ids[i], ids[after[i]])) is not None:
                at[i] = r
                where.setdefault(r, []).append(i)
        heap = list(where)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            spots = where.pop(r, None)
            if spots is None:
                continue
            spots.sort()
            for k, i in enumerate(spots):
                if at[i] != r:
                    continue
                j = after[i]
                ids[i], at[j] = r, -1
                last.add(j)
                after[i] = nxt = after[j]
                lower = False
                at[i] = -1
                if nxt < n:
                    before[nxt] = i
                    if (q := rank(r, ids[nxt])) is not None:
                        at[i] = q
                        where.setdefault(q, []).append(i)
                        heapq.heappush(heap, q)
                        lower |= q <= r
                if (prev := before[i]) >= 0:
                    at[prev] = -1
                    if (q := rank(ids[prev], r)) is not None:
                        at[prev] = q
                        where.setdefault(q, []).append(prev)
                        heapq.heappush(heap, q)
                        lower |= q <= r
                if lower:  # a merge of no higher rank came up: it goes first, the rest of this rank waits
                    where.setdefault(r, []).extend(spots[k + 1 :])
                    heapq.heappush(heap, r)
                    break
        out, start = [], 0
        for e in ends:
            out.append([ids[i] for i in range(start, e) if i not in last])
            start = e
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Codec:
    """Texts to (number of ids, decimal ids joined by commas, decoded bytes)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.replay, self.pattern = Replay(ranks), regex.compile(pattern)
        self.pieces: dict[str, tuple[int, str, bytes]] = {}
        self.chunks: dict[str, tuple[int, str, bytes]] = {}

    def learn(self, chunks: set[str]) -> None:
        if len(self.chunks) > KEPT:
            self.chunks.clear()
        if len(self.pieces) > KEPT:
            self.pieces.clear()
        new = chunks.difference(self.chunks)
        parts = {c: self.pattern.findall(c) for c in new}
        pieces = list({p for ps in parts.values() for p in ps}.difference(self.pieces))
        for p, ids in zip(pieces, self.replay.encode([p.encode() for p in pieces]), strict=True):
            self.pieces[p] = (len(ids), ",".join(map(str, ids)), self.replay.decode(ids))
        known = self.pieces
        for c, ps in parts.items():
            if len(ps) == 1:
                self.chunks[c] = known[ps[0]]
            else:
                got = [known[p] for p in ps]
                self.chunks[c] = (sum(g[0] for g in got), ",".join([g[1] for g in got]), b"".join([g[2] for g in got]))

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, str, bytes]]:
        """Of each text, null as an empty one. Texts go in slices of a bounded size."""
        at = 0
        while at < len(texts):
            size, cut, distinct = 0, [], set()
            while at < len(texts) and (not cut or size < 8_000_000):
                cut.append(_CHUNK.findall(texts[at] or ""))
                distinct.update(cut[-1])
                size += len(texts[at] or "")
                at += 1
            self.learn(distinct)
            for chunks in cut:
                got = list(map(self.chunks.__getitem__, chunks))
                yield sum([g[0] for g in got]), ",".join([g[1] for g in got]), b"".join([g[2] for g in got])


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """docs to (key, n_tokens, ids_sha256, decoded_sha256), a row for each row; a null text is an empty one.

    With full=True the row also has ids (ARRAY<INT>) and decoded (BINARY). Repeated rows give repeated rows; other
    columns of docs are not read. path is the vocabulary's file, which every executor has."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(path), pattern)
        for batch in batches:
            got = [
                (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), *((list(map(int, ids.split(","))) if ids else [], raw) if full else ()))
                for n, ids, raw in codec(batch.column(1).to_pylist())
            ]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
            cols = [pa.array([g[k] for g in got], kinds[k]) for k in range(5 if full else 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols) + 1])

    schema = f"{key} {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * full
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)
