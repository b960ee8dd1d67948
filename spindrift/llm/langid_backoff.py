"""Language ID, word first: a known word scores by its log frequency in each language, an unseen one by character n-grams.

Counts are taken over all words of all learning rows, on the executors. A word is known if it makes up RARE_WORD or
more of some language's words (and occurs LEAST times), an n-gram if it makes up RARE_GRAM or more of some language's
n-grams; rarer words are scored by their n-grams, rarer n-grams by shorter ones. So the same words are known however
large the corpus is, each language has its own, and of each language 1 / RARE_WORD words and 1 / RARE_GRAM n-grams at
most go to the driver and to every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.workers import tidy

from .common import cut

#: The least share of a language's words and n-grams, the longest n-gram, and the least count of a known word.
RARE_WORD, RARE_GRAM, LONGEST, LEAST = 2e-6, 4e-6, 4, 3
#: Characters of a word that n-grams are taken from at once.
PIECE = 61
#: Word-likelihoods that a document's score adds up at most: a long text is no surer than this many words.
SURE = 25


class Model:
    """Log frequencies by language, of words and n-grams. Counts are a row a word (or n-gram), a column a language."""

    def __init__(self, langs: list[str], words: list[str], counts: np.ndarray, totals: np.ndarray, grams: list[str], gram_counts: np.ndarray, gram_totals: np.ndarray) -> None:
        self.langs = langs
        self.words, self.word_logs = {w: k for k, w in enumerate(words)}, self._logs(counts, totals)
        self.grams, self.gram_logs = {g: k for k, g in enumerate(grams)}, self._logs(gram_counts, gram_totals)

    def _logs(self, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.5) / (totals + 0.5 * (len(counts) + 1)))

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest known n-gram at each place of the word, zero for all if none is known."""
        padded, rows = f"^{word}$", []
        for i in range(len(padded)):
            for n in range(LONGEST, 0, -1):
                if i + n <= len(padded) and (k := self.grams.get(padded[i : i + n])) is not None:
                    rows.append(k)
                    break
        return self.gram_logs[rows].mean(axis=0) if rows else np.zeros(len(self.langs))


def letters(text: Column) -> Column:
    """A text's lower-cased runs of letters, one space between them. Learning and prediction both read this."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def _frequent(counts: DataFrame, name: str, langs: list[str], totals: dict[str, int], share: float, least: int) -> tuple[list[str], np.ndarray]:
    """The values of a column that make up the share of some language's, and their counts by language."""
    enough = F.col("c") >= F.create_map(*(F.lit(x) for k in langs for x in (k, max(least, share * totals[k]))))[F.col("lang")]
    wanted = counts.where(enough).select(name).distinct()  # 1 / share of each language at most
    each = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("c"))), F.lit(0)).alias(f"c{k}") for k, x in enumerate(langs)]
    table = counts.join(F.broadcast(wanted), name, "left_semi").groupBy(name).agg(*each).orderBy(name).toArrow()
    return table.column(0).to_pylist(), np.array([c.to_numpy() for c in table.columns[1:]], np.float64).T.reshape(-1, len(langs))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows of docs with a language and a text. Without any, the model has no languages."""
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    words = docs.select(F.col(lang).cast("string").alias("lang"), F.explode(F.split(letters(F.col(text)), " ")).alias("word")).where("word <> ''")
    counts = cut(words.groupBy("word", "lang").agg(F.count("*").alias("c")))
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    # n-grams are taken from pieces of PIECE characters, each with as many of the next as an n-gram reaches into it:
    # a substring is as slow as the text before it is long
    pieces = counts.select("lang", "c", F.split(padded, rf"(?<=\G.{{{PIECE}}})").alias("p"))
    pieces = pieces.select("lang", "c", F.explode(F.transform("p", lambda x, i: F.struct(x.alias("x"), F.concat(x, F.coalesce(F.left(F.get("p", i + 1), F.lit(LONGEST - 1)), F.lit(""))).alias("y")))).alias("s"))
    pieces = pieces.select("lang", "c", "s.y", F.length("s.x").alias("size")).where("size > 0")

    def starts(k: Column) -> Column:
        last = F.least(F.col("size"), F.length("y") - k + 1)
        return F.when(last > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), last))).otherwise(F.array().cast("array<int>"))

    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda k: F.transform(starts(k), lambda i: F.substring("y", i, k))))
    parts = pieces.select("lang", "c", F.explode(grams).alias("gram")).groupBy("gram", "lang").agg(F.sum("c").alias("c"))
    parts = cut(parts)
    sums = [{r["lang"]: int(r["c"]) for r in x.groupBy("lang").agg(F.sum("c").alias("c")).collect()} for x in (counts, parts)]
    langs = sorted(sums[0])
    if not langs:
        return Model([], [], np.zeros((0, 0)), np.zeros(0), [], np.zeros((0, 0)), np.zeros(0))
    word_sums, gram_sums = (np.array([x.get(k, 0) for k in langs], np.float64) for x in sums)
    words, word_counts = _frequent(counts, "word", langs, sums[0], RARE_WORD, LEAST)
    grams, gram_counts = _frequent(parts, "gram", langs, sums[1], RARE_GRAM, 1)
    return Model(langs, words, word_counts, word_sums, grams, gram_counts, gram_sums)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs to (key, *keep, lang_pred, score), a row for each row.

    `und` with score 0 where the text is null or has no letter, or the model has no language; else the language of
    the highest likelihood, of equal ones the first by name, and its share of the likelihood. A text of words and
    n-grams that are all unknown gets the first language with an even share. Repeated rows give repeated rows."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values: a class would need its module there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.__new__(Model)
        vars(model).update(sent.value)
        for batch in batches:
            texts, at, preds, scores = batch.column(batch.num_columns - 1), 0, [], []
            while at < len(texts):
                size = np.cumsum(pc.fill_null(pc.binary_length(texts.slice(at)), 0).to_numpy(zero_copy_only=False))
                some = max(1, int(np.searchsorted(size, 8_000_000)))
                split = pc.split_pattern(pc.fill_null(texts.slice(at, some), ""), " ")
                flat, bounds = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
                coded = flat.dictionary_encode()
                words = coded.dictionary.to_pylist()
                logs = np.zeros((len(words) + 1, len(model.langs)))
                real = np.array([w != "" for w in words] + [False])
                for k, w in enumerate(words):
                    row = model.words.get(w)
                    if row is not None:
                        logs[k] = model.word_logs[row]
                    elif w:
                        logs[k] = model.unseen(w)
                codes = coded.indices.to_numpy()
                sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(logs[codes], axis=0)]) if len(model.langs) else None
                counts = np.concatenate([[0], np.cumsum(real[codes])])
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    n = int(counts[b] - counts[a])
                    if not n or sums is None:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    x = (sums[b] - sums[a]) / n * min(n, SURE)
                    best = int(x.argmax())
                    preds.append(model.langs[best])
                    scores.append(float(1 / np.exp(x - x[best]).sum()))
                at += some
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    docs = docs.select(key, *keep, letters(F.col(text).cast("string")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(tidy(run), schema + ", lang_pred string, score double")
