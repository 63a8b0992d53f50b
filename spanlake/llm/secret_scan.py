"""Secret scans over a trigram inverted index, with Spark expressions only.

From each rule's regular expression a Boolean query over trigrams of the lower-cased
text is derived: every match must contain them. The index holds one posting
``(gram, doc_id)`` per document and trigram that some query names, and is written to the
shared folder; postings are intersected per document, and only the documents that a
rule's query accepts are searched with its expression. Rules without mandatory trigrams
(``hex``) are searched in every document.

Defined results: a null text is empty; equal or null ids share their postings, so their
candidates are a superset and the search itself decides; further columns of the
documents are kept out of the way. Nothing is broadcast, cut or capped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from spanlake.llm.shared import stored

_parser = re._parser  # the standard library's own reading of a pattern


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and Python share; a match counts if its
    ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that are long enough
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

# A query is True (no mandatory trigram), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple
MANY = 64  # strings that a part of a pattern may stand for before it counts as open


def _both(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and True in parts:
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    return _both("or", [
        _both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)
    ])


def _strings(item) -> set[str] | None:
    """All strings that a part of a pattern can match, lower-cased; None if too many."""
    kind, arg = str(item[0]), item[1]
    if kind == "LITERAL":
        return {chr(arg).lower()}
    if kind == "IN":
        out: set[str] = set()
        for k, a in arg:
            if str(k) == "LITERAL":
                out.add(chr(a).lower())
            elif str(k) == "RANGE" and a[1] - a[0] < 8:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if kind == "SUBPATTERN":
        return _all(arg[3])
    if kind == "BRANCH":
        each = [_all(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if kind == "MAX_REPEAT" and arg[1] != _parser.MAXREPEAT and arg[1] <= 4:
        one = _all(arg[2])
        if one is None or len(one) ** arg[1] > MANY:
            return None
        return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(sorted(one), repeat=n)}
    return None


def _all(items) -> set[str] | None:
    out = {""}
    for item in items:
        more = _strings(item)
        if more is None or len(out) * len(more) > MANY:
            return None
        out = {a + b for a in out for b in more}
    return out


def _needs(items) -> Query:
    """The query of a sequence: closed stretches are spelt out, open parts end them."""
    clauses: list[Query] = []
    stretch = {""}
    for item in items:
        more = _strings(item)
        if more is not None and len(stretch) * len(more) <= MANY:
            stretch = {a + b for a in stretch for b in more}
            continue
        clauses.append(_of_strings(stretch))
        stretch = more or {""}
        if more is None:
            kind, arg = str(item[0]), item[1]
            if kind == "SUBPATTERN":
                clauses.append(_needs(arg[3]))
            elif kind == "BRANCH":
                clauses.append(_both("or", [_needs(x) for x in arg[1]]))
            elif kind == "MAX_REPEAT" and arg[0]:
                clauses.append(_needs(arg[2]))
    clauses.append(_of_strings(stretch))
    return _both("and", clauses)


def trigram_query(pattern: str) -> Query:
    return _needs(_parser.parse(pattern))


def trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*map(trigrams, query[1]))


def accepts(query: Query, has: dict[str, Column]) -> Column:
    """The query as a condition over one column per trigram."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return has[query]
    out = None
    for part in (accepts(q, has) for q in query[1]):
        out = part if out is None else out & part if query[0] == "and" else out | part
    return out


def build_index(docs: DataFrame, grams: set[str]) -> DataFrame:
    """Postings ``(gram, doc_id)``, each once, in order of gram within each file."""
    found = F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit("(?=(" + "|".join(sorted(map(re.escape, grams))) + "))"), F.lit(1)
    ))
    postings = docs.select("doc_id", F.explode(found).alias("gram")).select("gram", "doc_id")
    return stored(postings.sortWithinPartitions("gram", "doc_id"), "trigram-index")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``(doc_id, rules)``: documents whose postings satisfy the query of some rule."""
    grams = sorted(set().union(*map(trigrams, queries.values())))
    marks = index.groupBy("doc_id").agg(*(
        F.max(F.col("gram") == g).alias(f"has{i}") for i, g in enumerate(grams)
    ))
    has = {g: F.col(f"has{i}") for i, g in enumerate(grams)}
    rules = F.array_compact(F.array(*(F.when(accepts(q, has), k) for k, q in queries.items())))
    return marks.select("doc_id", rules.alias("rules")).where(F.size("rules") > 0)


def spans(text: Column, rule: Rule, place: int) -> Column:
    """Matches of one rule as structs ``(start, place, kind, end)`` in code points.

    Splitting by the pattern gives the text between the matches, so that running
    lengths give their places.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("all"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["gap"])
        to = at + F.length(pair["match"])
        return F.struct(
            to.alias("at"), F.concat(acc["all"], F.array(F.struct(at.alias("start"), to.alias("end")))).alias("all")
        )

    pairs = F.arrays_zip(matches.alias("match"), F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"))
    placed = F.arrays_zip(matches.alias("match"), F.aggregate(pairs, start, step)["all"].alias("span"))
    value = lambda m: m["match"] if not rule.group else F.regexp_extract(m["match"], rule.pattern, rule.group)
    kept = F.filter(placed, lambda m: F.length(value(m)) >= rule.least)
    return F.transform(kept, lambda m: F.struct(
        m["span"]["start"].alias("start"), F.lit(place).alias("place"),
        F.lit(rule.kind).alias("kind"), m["span"]["end"].alias("end"),
    ))


SPANS = "array<struct<start:int,place:int,kind:string,end:int>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` plus ``spans``: every match of every rule by start, then order of rules."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    known = docs.withColumn("text", F.coalesce("text", F.lit("")))
    if indexed:
        index = build_index(known, set().union(*map(trigrams, indexed.values())))
        found = candidates(index, indexed).select(F.col("doc_id").alias("__id"), F.col("rules").alias("__rules"))
        known = known.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    else:
        known = known.withColumn("__rules", F.lit(None).cast("array<string>"))
    none = F.array().cast(SPANS)
    each = [
        spans(F.col("text"), r, i) if queries[r.kind] is True
        else F.when(F.array_contains("__rules", r.kind), spans(F.col("text"), r, i)).otherwise(none)
        for i, r in enumerate(rules)
    ]
    return known.withColumn("spans", F.array_sort(F.concat(*(e.cast(SPANS) for e in each)))).drop("__rules")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover, overlapping ones joined, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(
        spans, start, step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))),
    )
