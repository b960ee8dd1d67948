"""Keyphrases without a model: ranks of words in each text's graph of neighbours, then phrases that differ.

A text's words are linked where they stand at most WINDOW places apart (stop words and punctuation take a place and have
no links). A word's rank is (1 - DAMPING) + DAMPING * the ranks of its neighbours, each shared out by weight, after ROUNDS
rounds. The best THIRD of a text's words make phrases where they are adjacent; a phrase weighs the sum of its different
words' ranks, and phrases are picked one by one for weight and for words that those already picked don't have.

A text needs nothing of the others, so texts don't move: the graphs of a batch's texts are parts of one, ranked together
in arrays, and only phrases leave the task. Memory follows a slice of SLICE tokens, or one text's if that is longer."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.storage import cut
from spindrift.workers import tidy

from .content import stop_words

WINDOW, DAMPING, ROUNDS, THIRD = 2, 0.85, 30, 3
#: How much a phrase's weight counts against its likeness to the picked ones, and places to which weights are rounded.
WEIGHT, DIGITS = 0.7, 6
#: Rows that a worker is sent at once, tokens that are ranked together, and phrases of a text that are looked at first.
LONG_ROWS, SLICE, FIRST = 1_000, 500_000, 24


def marked_words(text: Column) -> Column:
    """Lower-cased words in order, and punctuation that parts phrases."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+|[.,;:!?()\n]"), F.lit(0))


#: The same words and marks, of lower-cased texts with no character beyond NEAR (Latin letters and combining marks), where
#: Python's characters and Java's are alike. Workers read such texts many times as fast as the built-in function.
NEAR = 0x36F
_WORD = "".join(f"\\U{c:08x}" for c in range(NEAR + 1) if unicodedata.category(chr(c))[0] in "LMN")
_MARKED = re.compile(rf"[{_WORD}]+|[.,;:!?()\n]")


def _tokens(plain: pa.Array, words: pa.ListArray) -> pa.ListArray:
    """Each row's words and marks: from its text, or as they are where that is null."""
    found = [_MARKED.findall(text) if text is not None else words[i].as_py() for i, text in enumerate(plain.to_pylist())]
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(itertools.chain.from_iterable(found)), pa.string()))


def ranks(codes: np.ndarray, texts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its node (-1 where its code is), each node as text * words + code, in order, and each node's rank in
    units of the last of DIGITS places. A node is a word of one text."""
    there = codes >= 0
    keys, place = np.unique(texts[there] * words + codes[there], return_inverse=True)
    nodes = np.full(len(codes), -1)
    nodes[there] = place
    pairs = []
    for d in range(1, WINDOW + 1):
        a, b = nodes[:-d], nodes[d:]
        met = (a >= 0) & (b >= 0) & (a != b) & (texts[:-d] == texts[d:])
        pairs += [a[met] * len(keys) + b[met], b[met] * len(keys) + a[met]]
    edges, weight = np.unique(np.concatenate(pairs), return_counts=True)
    to, by = edges // max(1, len(keys)), edges % max(1, len(keys))
    share = weight / np.bincount(by, weight, len(keys))[by]
    rank = np.ones(len(keys))
    for _ in range(ROUNDS):
        rank = 1 - DAMPING + DAMPING * np.bincount(to, share * rank[by], len(keys))
    return nodes, keys, np.rint(rank * 10**DIGITS).astype(np.int64)


def picked(phrases: dict[str, float], n: int, rest: float = 0.0) -> list[tuple[str, float]] | None:
    """n phrases one by one: WEIGHT * weight (as a share of the best) less (1 - WEIGHT) * most words shared with a picked one
    (as a share of both phrases' words); of equal ones the first in order.

    rest: the weight that phrases not given have at most, lighter than all given; None if one of them may be among the n."""
    order, top = sorted(phrases, key=lambda p: (-phrases[p], p)), max(phrases.values(), default=1.0)
    own = {}
    out: list[tuple[str, float]] = []
    taken: dict[str, set[str]] = {}
    while len(out) < (n if rest else min(n, len(order))):
        best, most = "", -1.0
        for p in order:
            share = WEIGHT * phrases[p] / top
            if round(share, DIGITS) < most:  # nor can any lighter phrase be worth more
                break
            if p not in taken:
                mine = own[p] = own.get(p) or set(p.split(" "))
                near = max((len(mine & x) / len(mine | x) for x in taken.values()), default=0.0)
                worth = round(share - (1 - WEIGHT) * near, DIGITS)
                if worth > most or (worth == most and p < best):
                    best, most = p, worth
        else:
            if rest and round(WEIGHT * rest / top, DIGITS) >= most:
                return None
        taken[best] = own[best]
        out.append((best, phrases[best]))
    return out


def _slice(tokens: pa.ListArray, n: int, stop: frozenset[str]) -> list[list[tuple[str, float]]]:
    """Each text's phrases. Single characters and stop words have no code; codes are in order of words."""
    sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    order = pc.sort_indices(flat.dictionary).to_numpy()
    words = flat.dictionary.take(pa.array(order)).to_pylist()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes, texts = place[flat.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes)
    gone = np.array([len(w) < 2 or w in stop for w in words], bool)  # once a different word
    codes[gone[codes]] = -1
    nodes, keys, rank = ranks(codes, texts, len(words))
    of = keys // max(1, len(words))  # a node's text
    many = np.bincount(of, minlength=len(sizes))
    by_rank = np.lexsort((-rank, of))  # stable: nodes of equal rank stay in order of words
    best = np.zeros(len(keys) + 1, bool)
    best[by_rank] = np.arange(len(keys)) - (np.cumsum(many) - many)[of] < (-(-many // THIRD))[of]
    # runs of such words
    at = np.flatnonzero(best[nodes])
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(texts[at]) > 0)])[: len(at)]
    run, starts = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(at))
    once = np.unique(run * max(1, len(keys)) + nodes[at])  # a phrase's different words
    weight = np.bincount(once // max(1, len(keys)), rank[once % max(1, len(keys))], len(starts) - 1).astype(np.int64)
    home = texts[at[new]]
    heavy = np.lexsort((-weight, home))
    ends = np.cumsum(np.bincount(home, minlength=len(sizes)))
    spoken, out = codes[at], []
    for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        taken, found = FIRST, None
        while found is None:  # the heaviest phrases, and more only where lighter ones may be picked
            last = min(end, begin + taken)
            while last < end and weight[heavy[last]] == weight[heavy[last - 1]]:
                last += 1
            own = {" ".join([words[c] for c in spoken[starts[r] : starts[r + 1]].tolist()]): int(weight[r]) / 10**DIGITS for r in heavy[begin:last].tolist()}
            found = picked(own, n, int(weight[heavy[last]]) / 10**DIGITS if last < end else 0.0)
            taken *= 4
        out.append(found)
    return out


def keyphrases(df: DataFrame, key: str, text: Column, n: int = 5) -> DataFrame:
    """(key, place, phrase, weight): up to n phrases of each row's text, place from 1.

    A null or empty text, and one of stop words alone, has none. Repeated rows have each their own; other columns are
    not read. Of words of equal rank, and phrases of equal worth, the first in order of code points goes first."""
    kind, stop = df.schema[key].dataType.simpleString(), frozenset(stop_words())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column(1), batch.column(2))
            sizes = np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(sizes):
                done = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + SLICE, "right")))
                found = [(at + k, p + 1, *x) for k, xs in enumerate(_slice(tokens.slice(at, end - at), n, stop)) for p, x in enumerate(xs)]
                at = end
                if found:
                    rows, places, phrases, weights = zip(*found, strict=True)
                    columns = [batch.column(0).take(pa.array(rows)), pa.array(places, pa.int32()), pa.array(phrases), pa.array(weights, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "place", "phrase", "weight"])

    low = F.lower(F.coalesce(text, F.lit("")))
    far = low.rlike(rf"[^\x00-\x{{{NEAR:x}}}]")
    rows = df.select(key, F.when(~far, low).alias("__sp_text"), F.when(far, marked_words(text)).alias("__sp_words"))
    return cut(rows.mapInArrow(tidy(run), f"{key} {kind}, place int, phrase string, weight double"), LONG_ROWS)
