"""Quality by Bradley-Terry pairwise ranking: scores from preference pairs, cut at a quantile of scores.

A pair is a document labelled 1 and one labelled 0; the first is preferred. Weights are fitted by logistic loss on
the difference of the two feature vectors, on SAMPLE rows at most. The cut is the quantile of all learning rows'
scores at their share of label 0, and the score is placed so that the cut falls on THRESHOLD."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.workers import tidy

from .common import cut, text_hash, without

THRESHOLD = 0.3
#: Labelled rows that weights (not the cut) are fitted on at most, those with the lowest hashes, and preference pairs.
SAMPLE, PAIRS = 20_000, 200_000
RIDGE = 1.0
#: Texts that a worker is sent at once.
LONG_ROWS = 2_000
#: Slots of a histogram of scores.
SLOTS = 4096

#: The features, in order.
FEATURES = (
    "log_words", "word_chars", "word_chars_spread", "long_words", "upper", "digits", "symbols", "marks", "other_ascii",
    "stops_per_word", "distinct_words", "repeats_next", "repeats_second", "distinct_pairs", "lines_per_word", "repeated_lines", "short_lines", "is_empty",
)
_UPPER, _DIGIT, _SYMBOL, _MARK = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>{}[]\\^~@=_+", b"!?"
_OTHER = b"\"'()/-:;"


def features(text: str | None) -> list[float]:
    """The feature vector of a whole text; a null text is an empty one."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    size = sum(map(len, words))

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    lengths = np.fromiter(map(len, words), np.int32, n)
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    distinct = len(set(words)) / n
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    root = min(n, 400) ** 0.5 / 20  # a short text repeats itself less by its length alone
    return [
        float(np.log1p(n)), size / n, float(lengths.std()), float((lengths > 20).mean()), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_MARK), share(_OTHER),
        raw.count(b".") / n, distinct * root, sum(map(eq, words, words[1:])) / n, sum(map(eq, words, words[2:])) / n, pairs,
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), sum(len(x) < 30 for x in lines) / max(1, len(lines)), 0.0,
    ]


def featurize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs to (key, features ARRAY<DOUBLE>), a row for each row. Nothing but the text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], names=[key, "features"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(tidy(run), f"{key} {docs.schema[key].dataType.simpleString()}, features array<double>")


class Ranking:
    """Weights, and where the scores are cut (placed by fit())."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        z = self.standard(x)
        w = np.zeros(x.shape[1])
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        for _ in range(25):  # Newton steps on the logistic loss of the differences
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gradient = d.T @ (p - 1) + RIDGE * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d + RIDGE * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        self.cut = 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Ranking | None:
    """A ranking from (doc_id, features, quality) rows; None unless both labels occur.

    Weights are fitted on the `sample` rows with the lowest hashes of their values (as many again of a label that these
    lack): the one part of this operator that is bounded. The cut is taken over all rows."""
    labelled = labelled.where("quality in (0, 1)")
    count = {r["quality"]: r["n"] for r in labelled.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return None
    rows = _lowest(labelled, sum(count.values()), sample)
    for q in {0, 1} - {r["quality"] for r in rows}:  # a label too rare for the sample
        rows += _lowest(labelled.where(F.col("quality") == q), count[q], sample)
    y = np.array([r["quality"] for r in rows])
    ranking = Ranking(np.array([r["features"] for r in rows]), y)
    ranking.cut = _cut(labelled.select(total(F.col("features"), ranking).alias("s")), count[0])
    return ranking


def _lowest(labelled: DataFrame, n: int, sample: int) -> list:
    """The `sample` rows of n with the lowest hashes. Rows are left out where they are by a bound on the hash that some
    more than enough keep to, so tasks send about as many rows as are taken, however many tasks there are."""
    place = F.pmod(F.xxhash64("doc_id", "quality", "features"), F.lit(1 << 30))
    bound = min(1.0, (1.1 * sample + 200) / max(n, 1))
    return labelled.withColumn("_place", place).where(F.col("_place") < bound * (1 << 30)).orderBy("_place", "doc_id").limit(sample).select("features", "quality").collect()


def _cut(scores: DataFrame, below: int) -> float:
    """The middle between the below-th least score (column s) and the next, so no learning row lies on the cut.

    Exact, whatever the number of rows: histograms of SLOTS slots, each of the slot before, narrow the two places
    down until a slot has few enough distinct scores to read."""
    scores = cut(scores.groupBy("s").agg(F.count("*").alias("n")))

    def kth(k: int) -> float:
        """The k-th least score, from 1."""
        held = scores
        while True:
            low, high, distinct = held.agg(F.min("s"), F.max("s"), F.count("*")).first()
            if distinct <= SLOTS or low == high:
                for s, n in held.orderBy("s").collect():
                    k -= n
                    if k <= 0:
                        return s
            slot = F.least(F.lit(SLOTS - 1), F.floor((F.col("s") - low) / (high - low) * SLOTS))
            placed = held.withColumn("slot", slot)
            for at, n in placed.groupBy("slot").agg(F.sum("n")).orderBy("slot").collect():
                if k <= n:
                    break
                k -= n
            held = placed.where(F.col("slot") == at).drop("slot")

    return (kth(below) + kth(below + 1)) / 2


def total(features: Column, ranking: Ranking) -> Column:
    """The weighted sum of a feature vector."""
    out = F.lit(0.0)
    for k, (w, m, s) in enumerate(zip(ranking.weights.tolist(), ranking.mean.tolist(), ranking.scale.tolist(), strict=True)):
        out = out + F.lit(w) * F.least(F.lit(8.0), F.greatest(F.lit(-8.0), (F.get(features, F.lit(k)) - m) / s))
    return out


def score(features: Column, ranking: Ranking | None) -> Column:
    """The score of a feature vector: 0 to 1, THRESHOLD at the cut. Without a ranking every score is 0.5."""
    if ranking is None:
        return F.lit(0.5)
    place = float(np.log(THRESHOLD / (1 - THRESHOLD)) - ranking.cut)
    return 1 / (1 + F.exp(-(total(features, ranking) + F.lit(place))))


def classify(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """docs and labels (doc_id, quality, ...) to (doc_id, score, predicted), a row for each row of docs.

    Labels are learned only where `learn`, a condition on doc_id, holds (everywhere if None). Rows with a null id or
    label, or a label besides 0 and 1, are not learned from; a document with several rows of labels counts by their
    highest. Null, empty and blank texts have one feature vector and so one score. Repeated rows give repeated rows;
    columns besides doc_id and text are not read."""
    return _classified(docs, labels, learn).drop("hash")


def _classified(docs: DataFrame, labels: DataFrame, learn: Column | None) -> DataFrame:
    """classify() with each row's text_hash() beside its doc_id."""
    keyed = docs.select(F.struct("doc_id", text_hash().alias("hash")).alias("row"), "text")
    vectors = cut(featurize(keyed, "row").select("row.*", "features"), LONG_ROWS)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if learn is not None:
        marks = marks.where(learn)
    ranking = fit(vectors.join(marks, "doc_id"))
    s = score(F.col("features"), ranking)
    return vectors.select("doc_id", "hash", s.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """The rows of docs that classify() doesn't reject, whole and with all their columns.

    Each row is judged by its own text, also where doc_ids are null or repeat."""
    return without(docs, _classified(docs, labels, learn).where("predicted = 0"))
