"""Secret scans by a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: every match of the rule satisfies it.
The index posts, for each trigram of any query, the rows whose lower-cased text has it. A row's postings are
intersected by the queries, and only rows that satisfy a rule's query are verified with its expression. A rule whose
expression has no mandatory trigram (a run of hex digits) is held against every text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

#: Candidate rows up to which the list of candidates (two hashes and a mask each, 32 bytes) is sent to every executor.
BROADCAST_ROWS = 100_000
#: Alternatives of one literal stretch that a trigram query follows at most.
_STRETCH = 64
#: Matches that are folded before the next array is begun.
CHUNK = 256


def either_case(words: str) -> str:
    """An expression with each ASCII letter in either case; for expressions without classes or escapes."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


@dataclass(frozen=True)
class Rule:
    """kind and expression; a match counts if its group `part` has `least` code points or more."""

    kind: str
    regex: str
    part: int = 0
    least: int = 0


#: The rules of the contract, in its order, then those that the scan adds. The expressions keep to what Java and RE2 read alike.
BASE = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # leftmost runs of 24 or more are the runs [0-9a-f]+ without the short ones
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED

#: A query is True, a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def _both(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and any(p is True for p in parts):
        return True
    some = [p for p in dict.fromkeys(parts) if p is not True]
    if kind == "or":  # an alternative that asks for more than another adds nothing
        asks = [{p} if isinstance(p, str) else set(p[1]) if p[0] == "and" else None for p in some]
        some = [p for p, a in zip(some, asks, strict=True) if a is None or not any(b is not None and b < a for b in asks)]
    return True if not some else some[0] if len(some) == 1 else (kind, tuple(some))


def _literal(strings: set[str]) -> Query:
    """What a text has if it has one of the strings."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(tree, flush: list[Query]) -> set[str] | None:
    """The strings that a parsed expression can match, None if they are too many; then flush gets what is mandatory in them."""
    now: set[str] = {""}

    def broken() -> None:
        nonlocal now
        flush.append(_literal(now))
        now = {""}

    def add(strings: set[str] | None) -> None:
        nonlocal now
        if strings is None or len(now) * len(strings) > _STRETCH:
            broken()
            if strings is not None and len(strings) <= _STRETCH:
                now = set(strings)
        else:
            now = {a + b for a in now for b in strings}

    whole = True
    for op, arg in tree:
        name, strings = str(op), None
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
            strings = {chr(v).lower() for _, v in arg}
        elif name == "SUBPATTERN":
            strings = _walk(arg[3], flush)
        elif name == "BRANCH":
            sides = []
            alternatives: set[str] | None = set()
            for branch in arg[1]:
                inner: list[Query] = []
                got = _walk(branch, inner)
                sides.append(_both("and", [*inner, *([_literal(got)] if got is not None else [])]))
                alternatives = None if got is None or alternatives is None else alternatives | got
            strings = alternatives
            if alternatives is None:
                flush.append(_both("or", sides))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inside = arg
            got = _walk(inside, []) if not low else _walk(inside, flush)
            if got is not None and high <= 1:
                strings = got | ({""} if not low else set())
            elif got is not None and low and len(got) ** int(low) <= _STRETCH:
                strings = {""}
                for _ in range(int(low)):
                    strings = {a + b for a in strings for b in got}
                if high != low:
                    add(strings)
                    strings = None
        if strings is None:
            whole = False
        add(strings)
    if whole:
        return now
    broken()
    return None


def trigram_query(regex: str) -> Query:
    """The Boolean trigram query that every match's lower-cased text satisfies; True if none is mandatory."""
    flush: list[Query] = []
    strings = _walk(sre.parse(regex), flush)
    return _both("and", [*flush, *([_literal(strings)] if strings is not None else [])])


def _trigrams(q: Query) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(_trigrams, q[1]))


def _holds(q: Query, bit: dict[str, int], mask: Column) -> Column:
    if q is True:
        return F.lit(True)
    if isinstance(q, str):
        return F.get(mask, F.lit(bit[q] // 62)).bitwiseAND(F.lit(1 << bit[q] % 62)) != 0
    parts = [_holds(p, bit, mask) for p in q[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if q[0] == "and" else out | p
    return out


def postings(docs: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """The inverted index: (doc_id, hash, gram), gram the place in vocabulary of a trigram that the lower-cased text has."""
    lower = docs.select("doc_id", F.xxhash64(text).alias("hash"), F.lower(text).alias("lower"))
    found = F.array_compact(F.array(*(F.when(F.contains("lower", F.lit(g)), F.lit(k)) for k, g in enumerate(vocabulary))))
    return lower.select("doc_id", "hash", F.explode(found).alias("gram"))


def _fold(items: Column, kind: str, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    """A fold of items, a bound value, over (at, out): step gives the next of the two, out an array of the kind.

    Folding copies out at each step, so it is done chunk by chunk, and the chunks' arrays are joined at the end."""
    none, many = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def chunk(acc: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(items, k * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    chunks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / CHUNK).cast("int"))
    start = F.struct(F.lit(0).alias("at"), many.alias("out"))
    return F.aggregate(chunks, start, chunk, lambda acc: finish(F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out"))))


def spans(text: Column, rule: Rule, kind: int) -> Column:
    """A rule's matches in a text: an array of (start, kind, end) in code points, by start."""
    regex = F.lit(rule.regex)

    def placed(gaps: Column, matches: Column, parts: Column) -> Column:
        steps = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("match"))), parts, lambda x, p: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), F.length(p).alias("part")))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            end = begin + x["match"]
            span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return let(steps, lambda s: _fold(s, "struct<start:int,kind:int,end:int>", step, lambda acc: acc["out"]))

    return let(F.split(text, rule.regex, -1), lambda g: let(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: let(F.regexp_extract_all(text, regex, F.lit(rule.part)), lambda p: placed(g, m, p))))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "found") -> DataFrame:
    """docs with a column `into`: all rules' matches as an array of (start, kind, end) by start, then the rules' order.

    A null or empty text has none. Every row of docs stays, repeated ones too, with all its columns; rows are told
    apart by doc_id and text, so a null or repeated doc_id does no harm. Matches of one rule don't overlap, those of
    different rules may. docs may have any other columns, of any names but `into` and those that begin with __sp_."""
    queries = [trigram_query(r.regex) for r in rules]
    vocabulary = sorted(set().union(*map(_trigrams, queries)))
    bit = {g: k for k, g in enumerate(vocabulary)}
    lots = -(-len(vocabulary) // 62)
    masks = [F.bit_or(F.expr(f"case when gram div 62 = {k} then shiftleft(1L, gram % 62) else 0L end")) for k in range(lots)]
    wanted = None
    for q in queries:
        if q is not True:
            wanted = _holds(q, bit, F.col("__sp_mask")) if wanted is None else wanted | _holds(q, bit, F.col("__sp_mask"))
    with_hash = docs.withColumn("__sp_hash", F.xxhash64("text"))
    if wanted is None:
        joined = with_hash.withColumn("__sp_mask", F.lit(None).cast("array<long>"))
    else:
        index = postings(docs, vocabulary)
        candidates = cut(index.groupBy("doc_id", "hash").agg(F.array(*masks).alias("__sp_mask")).where(wanted))
        few = candidates.count() <= BROADCAST_ROWS
        candidates = candidates.select(F.col("doc_id").alias("__sp_id"), F.col("hash").alias("__sp_h"), "__sp_mask")
        same = with_hash["doc_id"].eqNullSafe(candidates["__sp_id"]) & (with_hash["__sp_hash"] == candidates["__sp_h"])
        joined = with_hash.join(F.broadcast(candidates) if few else candidates, same, "left").drop("__sp_id", "__sp_h")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for k, (r, q) in enumerate(zip(rules, queries, strict=True)):
        may = F.col("text").rlike(r.regex) if q is True else F.coalesce(_holds(q, bit, F.col("__sp_mask")), F.lit(False))
        each.append(F.when(may, spans(F.col("text"), r, k)).otherwise(none))
    return joined.withColumn(into, F.array_sort(F.concat(*each))).drop("__sp_hash", "__sp_mask")


def written(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Matches as kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each match in text replaced by [kind]; overlapping matches go as one, named by the first. n_chars follows.

    Rows without a match stay as they are; no row is dropped."""
    kinds = F.array(*(F.lit(f"[{r.kind}]") for r in rules))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        apart = x["start"] >= acc["at"]
        more = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.get(kinds, x["kind"])))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(apart, more).otherwise(acc["out"]).alias("out"))

    def joined(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    rest = _fold(F.col("__sp_found"), "string", step, joined)
    hit = F.size("__sp_found") > 0
    out = scan(docs, rules, "__sp_found").withColumn("__sp_new", F.when(hit, rest).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("__sp_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__sp_new")).select(*docs.columns)
