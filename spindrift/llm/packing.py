"""Packing of token sequences: first-fit decreasing, a tournament tree over bin capacities, in randomised groups."""

from __future__ import annotations

import math
import os
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.workers import kept_in_worker, tidy

from .common import cut

#: Tokens of a sequence, and pieces of a group's documents, about (a group is one task's unit of work).
LENGTH, GROUP = 4096, 20_000
#: Texts that a worker is sent at once.
LONG_ROWS = 2_500
#: Bytes of texts that are encoded together, words that go to the tokenizer as one text, and words that a worker keeps.
SLICE, TOGETHER, KEPT = 8_000_000, 1_000, 600_000
#: The tokenizer's pieces, and characters whose kind doesn't depend on a library's version of Unicode.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+"
STABLE = "^[!-~\u00c0-\u0527\u3041-\u30ff\u4e00-\u9fd5\uac00-\ud7a3]*$"


class Words:
    """Token ids of texts by a `tokenizers` file whose pieces are PIECE, and so never span white space.

    Each distinct word of a slice of texts is encoded once, without the punctuation at its end, which would multiply
    the words; up to about KEPT words, and what one slice adds, are kept for the task's next slices."""

    def __init__(self, path: str) -> None:
        # one thread: the library's own threads cost more than they gain on short words, and each keeps memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        # a word's place in starts and sizes, which tell its ids in the pool; the empty word has none
        self.place, self.pool = {"": 0}, np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def encode(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one word after another in some order, and of each id its word.

        Words are joined to texts of TOGETHER words, whose ids are dealt to the words by their numbers of pieces.
        Words that lower case still changes, and lots whose pieces don't add up, are encoded one by one."""
        words = pa.array(forms, pa.string())
        plain = pc.and_(pc.match_substring_regex(words, STABLE), pc.equal(pc.utf8_lower(words), words))
        pieces = pc.count_substring_regex(words, PIECE).to_numpy(zero_copy_only=False)
        plain = plain.to_numpy(zero_copy_only=False) & (pieces > 0)
        alone, whole = [np.flatnonzero(~plain)], np.flatnonzero(plain)
        owners, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(whole), 10 * TOGETHER):
            lots = [whole[a : a + TOGETHER] for a in range(at, min(at + 10 * TOGETHER, len(whole)), TOGETHER)]
            texts = [" ".join([forms[k] for k in x.tolist()]) for x in lots]
            for lot, e in zip(lots, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                piece, owner = np.array(e.word_ids, np.int64), np.repeat(lot, pieces[lot])
                if piece[-1] + 1 == len(owner):
                    owners.append(owner[piece])
                    ids.append(np.array(e.ids, np.uint32))
                else:
                    alone.append(lot)
        for k in np.concatenate(alone).tolist():
            own = self.tokenizer.encode_batch_fast([forms[k]], add_special_tokens=False)[0].ids
            owners.append(np.full(len(own), k))
            ids.append(np.array(own, np.uint32))
        return np.concatenate(ids), np.concatenate(owners)

    def learn(self, words: list[str]) -> np.ndarray:
        """Of each word the places of its core and of the punctuation at its end, one after the other."""
        if len(self.place) > KEPT:
            self.clear()
        forms = [w if w.isascii() else unicodedata.normalize("NFC", w) for w in words]  # as the tokenizer does first

        def core(w: str) -> str:
            part = w.rstrip(string.punctuation)
            return part if part and part[-1].isalnum() and "<|" not in w else w  # a special token's string isn't parted

        cores = [w if w.isalnum() else core(w) for w in forms]
        ends = [w[len(c) :] for w, c in zip(forms, cores, strict=True)]
        new = list({*cores, *ends}.difference(self.place))
        ids, owner = self.encode(new)
        first = np.flatnonzero(np.diff(owner, prepend=-1))  # a word's ids stand together
        starts = np.zeros(len(new), np.int64)
        starts[owner[first]] = first + len(self.pool)
        self.starts = np.concatenate([self.starts, starts])
        self.sizes = np.concatenate([self.sizes, np.bincount(owner, minlength=len(new))])
        self.pool = np.concatenate([self.pool, ids])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        at = np.empty((len(words), 2), np.int64)
        at[:, 0] = list(map(self.place.__getitem__, cores))
        at[:, 1] = list(map(self.place.__getitem__, ends))
        return at

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's number of ids."""
        texts = pc.fill_null(texts, "")
        # a special token's string counts as one in lower case only, so texts that may have one stay as they are
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        flat, bounds = split.flatten(), split.offsets.to_numpy()
        # runs of white space at the ends leave empty words, which have no ids
        coded = flat.dictionary_encode()
        at = self.learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()].ravel()
        each = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        take = np.repeat(self.starts[at] - ends[:-1], each) + np.arange(ends[-1])
        return self.pool[take], np.diff(ends[2 * (bounds - bounds[0])])


def pieces(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs to pieces (key, start, length, ids_crc32, doc_tokens, row): each document's ids and end_id, cut every `length`
    ids. row is the document's number, which its pieces share."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_in_worker(f"words of {path}", lambda: Words(path))
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < len(texts):  # slices of bounded size, however long the texts
                size = np.cumsum(pc.fill_null(pc.binary_length(texts.slice(at)), 0).to_numpy(zero_copy_only=False))
                some = max(1, int(np.searchsorted(size, SLICE)))
                ids, counts = words(texts.slice(at, some))
                rows: list[tuple[int, int, int, int, int]] = []
                first = 0
                for k, n in enumerate(counts.tolist()):
                    own = np.append(ids[first : first + n], np.uint32(end_id)).astype("<u4")
                    first += n
                    for s in range(0, n + 1, length):
                        part = own[s : s + length]
                        rows.append((at + k, s, len(part), zlib.crc32(part.tobytes()), n + 1))
                take, *rest = zip(*rows, strict=True)
                documents = pa.array(take)
                columns = [batch.column(0).take(documents), *(pa.array(c, pa.int64()) for c in rest), batch.column(2).take(documents)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "length", "ids_crc32", "doc_tokens", "row"])
                at += some
        words.clear()

    rows = docs.select(F.col(key), F.col(text).cast("string"), F.monotonically_increasing_id())
    return rows.mapInArrow(tidy(run), f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, row long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each item's bin and its offset there. Items go by size, largest first, each to the first bin with room.

    The bins' capacities are the leaves of a tournament tree whose inner nodes hold the larger of two; the way down
    from the root by the left child wherever it has room ends at the first bin that has."""
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    width = 1 << max(0, math.ceil(math.log2(max(1, n))))
    tree = [capacity] * (2 * width)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - width, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, group: int = GROUP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs to their pieces with sequence_id and offset; a sequence has at most `length` ids, gapless from offset 0.

    A null or empty text is a document of end_id alone. Documents are cut only every `length` ids, and are
    dealt, each with all its pieces, at random into groups of about `group` pieces, whose number grows with the input;
    each group is packed by itself; sequence ids are the group's number times 2**32 plus the bin's. Repeated rows are packed each. Other
    columns of docs are not read."""
    cutting = cut(pieces(docs, path, end_id, length, key, text), LONG_ROWS)
    groups = max(1, math.ceil(cutting.count() / group))
    # a document's number in the checkpoint is fixed, so a lost task deals its rows to the same groups again
    dealt = cutting.withColumn("lot", F.pmod(F.xxhash64("row", F.lit(4096)), F.lit(groups))).drop("row")
    kind = docs.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "start", "ids_crc32"], kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        lot = int(rows["lot"].iloc[0])
        return rows.assign(sequence_id=bins + (lot << 32), offset=offsets).drop(columns="lot")

    out = f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("lot").applyInPandas(run, out)
