"""Quality rules and perplexity bands of a modified Kneser-Ney model per language.

The models are of strings of ``ORDER`` bytes, as they stand: case, digits, every sign and every
byte of a letter outside ASCII count, so a model grows with what its language holds. Spark
counts the strings of all documents by language; the orders below are counted from which
strings exist (continuation counts). A model is kept as sorted arrays of n-gram hashes with
log-probabilities, and of context hashes with back-off weights, per order. Every language has
a model of its own, however small: its byte pairs back off to byte pairs pooled over all
languages, which a language with little text therefore follows.

Models are broadcast in groups of languages of at most ``MOST`` strings together; each further
group is one more pass over its own languages' documents. A language beyond that is a group
alone; it has 2**32 strings at the very most, as many as there are.

Two scores are measured: the mean negative log-probability per byte, and per word. Each is put
in units of its language: less the median, by the distance of the quartiles (both over all
documents that pass the base rules), by sqrt(1 + ``STEADY`` / bytes), since short documents
vary more. The limits, lower and upper, leave out ``TAIL`` of the labelled good documents of the
language on either side; with fewer than ``LEAST`` of these the limits are those of all
languages' labelled documents together. Every labelled row counts, and the limits are exact
quantiles of them all. Without labels the limits are ``WIDTH`` units.

Defined results: a null text is empty, has no words and fails the base rules; a null
language is a language; equal ids and rows are scored apart; a label of a repeated id holds for
all its rows, several labels of an id count as one, the worst; the columns that this operator
adds replace those of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanlake.llm.shared import mix, segment_hashes, slices, space_words, stored, summed, tidy, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER, LOWEST = 4, 2  # bytes; an n-gram is packed in 32 bits
MOST = 4_000_000
HELD = 2_000_000  # counts that a task holds before it hands them on
TAIL = 0.005
LEAST = 200
NEAR = 10_000  # accuracy of the sketch that says where a limit lies
WIDTH = 6.0
STEADY = 2000
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*METRICS, "n_bytes", "score", "word_score")
LIMITS = ("lower", "upper", "word_lower", "word_upper")


def packed_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the ``ORDER`` bytes that end there, within its row; 0 stands before a row."""
    out = data.astype(np.uint32)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER):
        before = np.zeros(len(data), np.uint32)
        before[k:] = data[:-k]
        before[place < k] = 0
        out |= before << np.uint32(8 * k)
    return out


def hashed(keys: np.ndarray, order: int) -> np.ndarray:
    return mix((keys.astype(np.uint64) << np.uint64(3)) | np.uint64(order))


def shorter(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes of packed n-grams."""
    return keys & np.uint64((1 << 8 * order) - 1)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = ((counts == k).sum() for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(d, [0, 0.1, 0.1, 0.1], [0, 0.9, 1.8, 2.7])


def _find(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted hashes, and which of the wanted are there."""
    if not len(hashes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return place, hashes[place] == wanted


def pair_logs(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of a byte after another over all languages, 256 by 256."""
    model = Model(keys, counts, np.full(1 << 16, -np.log(256)), 2, 1)
    return model.log_probability(np.arange(1 << 16, dtype=np.uint64))


class Model:
    """One language, per order from ``LOWEST`` on: sorted hashes of n-grams and their
    log-probabilities, sorted hashes of contexts and their log back-off weights. ``pairs`` holds
    the log-probabilities below, by the last two bytes."""

    def __init__(
        self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int = ORDER, lowest: int = LOWEST
    ) -> None:
        self.lowest, self.pairs = lowest, pairs
        tables = [(keys.astype(np.uint64), counts)]
        for n in range(order - 1, lowest - 1, -1):
            tables.append(np.unique(shorter(tables[-1][0], n), return_counts=True))
        self.orders: list[tuple[np.ndarray, ...]] = []
        for n, (grams, c) in enumerate(reversed(tables), lowest):
            d = discounts(c)[np.minimum(c, 3)]
            contexts, which = np.unique(grams >> np.uint64(8), return_inverse=True)
            total = np.bincount(which, c, len(contexts))
            weight = np.bincount(which, d, len(contexts)) / total
            lower = np.exp(self.log_probability(grams, n - 1))
            p = np.maximum(c - d, 0) / total[which] + weight[which] * lower
            self.orders.append((*self._sorted(grams, n, np.log(p)), *self._sorted(contexts, n - 1, np.log(weight))))

    @staticmethod
    def _sorted(keys: np.ndarray, order: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = hashed(keys, order)
        place = np.argsort(hashes)
        return hashes[place], values[place].astype(np.float32)

    def log_probability(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        """Of the last byte of each packed n-gram, given those before it."""
        order = self.lowest + len(self.orders) - 1 if order is None else order
        if order < self.lowest:
            return self.pairs[shorter(keys, 2).astype(np.int64)].astype(np.float64)
        hashes, logs, contexts, back = self.orders[order - self.lowest]
        mine = shorter(keys, order)
        place, seen = _find(hashes, hashed(mine, order))
        out = np.zeros(len(keys))
        out[seen] = logs[place[seen]]
        rest = ~seen
        if rest.any():
            place, known = _find(contexts, hashed(mine[rest] >> np.uint64(8), order - 1))
            weight = np.zeros(int(rest.sum()))
            weight[known] = back[place[known]]
            out[rest] = weight + self.log_probability(keys[rest], order - 1)
        return out


def count_grams(docs: DataFrame) -> DataFrame:
    """``(lang, key, n)``: packed n-grams of all documents, summed in each task before the shuffle."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for name, (keys, counts) in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)],
                    names=["lang", "key", "n"],
                )
            sums.clear()

        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                for name, keys, _ in by_language(part.column(0), *utf8(part.column(1))):
                    have = sums.get(name, (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
                    new, n = np.unique(keys, return_counts=True)
                    sums[name] = summed(np.concatenate([have[0], new]), np.concatenate([have[1], n]))
                if sum(len(keys) for keys, _ in sums.values()) > HELD:
                    yield from handed_on()
        yield from handed_on()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, key bigint, n bigint")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def by_language(langs: pa.Array, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """The languages of a slice, the n-grams of each, and which bytes those end at."""
    keys = packed_grams(data, offsets)
    names = langs.to_pylist()
    present = {name: k for k, name in enumerate(dict.fromkeys(names))}
    which = np.repeat(np.array([present[x] for x in names], np.int32), np.diff(offsets))
    for name, k in present.items():
        mine = np.flatnonzero(which == k) if len(present) > 1 else np.arange(len(keys))
        yield name, keys[mine], mine


def language_groups(counts: DataFrame, most: int = MOST) -> list[list[str | None]]:
    """Languages in groups whose models may be broadcast together."""
    groups, held = [], 0
    for r in counts.groupBy("lang").count().orderBy("count", "lang").collect():
        if not groups or held + r["count"] > most:
            groups.append([])
            held = 0
        groups[-1].append(r.lang)
        held += r["count"]
    return groups


def of_languages(names: list[str | None]) -> Column:
    named = [x for x in names if x is not None]
    some = F.col("lang").isin(named) if named else F.lit(False)
    return F.coalesce(some, F.lit(False)) | F.lit(None in names) & F.col("lang").isNull()


def train(counts: DataFrame, names: list[str | None], pairs: np.ndarray) -> dict[str | None, Model]:
    """The models of some languages, from counts over all documents."""
    rows = counts.where(of_languages(names)).toArrow()
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    codes = langs.indices.fill_null(len(langs.dictionary)).to_numpy()
    keys, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    return {
        name: Model(keys[codes == k], n[codes == k], pairs)
        for k, name in enumerate([*langs.dictionary.to_pylist(), None]) if (codes == k).any()
    }


def repeated(keys: np.ndarray, first: bool = True) -> np.ndarray:
    """Which keys occur twice or more; the first of them only if ``first``."""
    place = np.argsort(keys, kind="stable")
    same = keys[place][1:] == keys[place][:-1]
    out = np.zeros(len(keys), bool)
    out[place[1:][same]] = True
    if first:
        out[place[:-1][same]] = True
    return out


def rules(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five base metrics of each row."""
    n = len(offsets) - 1
    starts, ends, bounds = space_words(data, offsets)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = np.concatenate([[0], np.cumsum(chars[ends] - chars[starts])])
    marked = np.zeros(256, bool)
    marked[[ord(c) for c in "#*$%&|<>"]] = True
    marks = np.concatenate([[0], np.cumsum(marked[data])])
    # Lines: cut at newlines and at the rows' ends.
    edges = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    line_start, line_end = edges[:-1], edges[1:].copy()
    line_end -= (data[line_end - 1] == 10) if len(line_end) else 0
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[worded], line_end[worded], line_row[worded]
    key = segment_hashes(data, line_start, line_end) ^ mix(line_row.astype(np.uint64) + np.uint64(1))
    duplicate = np.bincount(line_row[repeated(key, first=False)], minlength=n)
    # Windows of 8 words.
    hashes = segment_hashes(data, starts, ends)
    word_row = np.repeat(np.arange(n), np.diff(bounds))
    first = np.flatnonzero(np.arange(len(starts)) + 8 <= bounds[1:][word_row])
    key = mix(word_row[first].astype(np.uint64) + np.uint64(1))
    for k, factor in enumerate(mix(np.arange(8, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)):
        key += hashes[first + k] * factor
    step = np.zeros(len(starts) + 1, np.int64)
    again = first[repeated(mix(key))]
    np.add.at(step, again, 1)
    np.add.at(step, again + 8, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return [
        np.diff(bounds),
        word_chars[bounds[1:]] - word_chars[bounds[:-1]],
        marks[offsets[1:]] - marks[offsets[:-1]],
        duplicate,
        covered[bounds[1:]] - covered[bounds[:-1]],
    ]


def measure(docs: DataFrame, models: dict[str | None, Model]) -> DataFrame:
    """``docs`` plus the base metrics, ``n_bytes``, ``score`` and ``word_score``."""
    names = [c for c in docs.columns if c not in ADDED]
    docs = docs.select(*names)
    sent = docs.sparkSession.sparkContext.broadcast(
        ({k: m.orders for k, m in models.items()}, next((m.pairs for m in models.values()), None))
    )
    text, lang = names.index("text"), names.index("lang")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, pairs = sent.value
        known = {}
        for name, tables in orders.items():
            known[name] = model = Model.__new__(Model)
            model.orders, model.pairs, model.lowest = tables, pairs, LOWEST
        for batch in batches:
            for at, to in slices(batch.column(text)):
                part = batch.slice(at, to - at)
                data, offsets = utf8(part.column(text))
                logs = np.zeros(len(data) + 1)
                for name, keys, mine in by_language(part.column(lang), data, offsets):
                    if name in known:  # only languages without any text have none
                        different, which = np.unique(keys, return_inverse=True)
                        logs[1:][mine] = known[name].log_probability(different.astype(np.uint64))[which]
                sums = np.cumsum(logs)
                size = np.diff(offsets)
                bits = sums[offsets[:-1]] - sums[offsets[1:]]
                counts = rules(data, offsets)
                added = [pa.array(x.astype(np.int64)) for x in counts]
                scores = [pa.array(bits / np.maximum(n, 1), mask=n == 0) for n in (size, counts[0])]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *added, pa.array(size, pa.int64()), *scores], names=[*names, *ADDED]
                )

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    counts = ", ".join(f"{c} bigint" for c in METRICS)
    return docs.mapInArrow(run, f"{kept}, {counts}, n_bytes bigint, score double, word_score double")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def spreads(measured: DataFrame) -> DataFrame:
    """Median and distance of the quartiles of both scores, over all documents that pass the base
    rules; a row per language."""
    cuts = [F.percentile_approx(x, [0.25, 0.5, 0.75], 100_000).alias(x) for x in ("score", "word_score")]
    return measured.where(~base_failed()).groupBy("lang").agg(*cuts).select(
        F.col("lang").alias("__lang"),
        *(part.alias(f"__{x}_{name}") for x in ("score", "word_score")
          for name, part in (("middle", F.col(x)[1]), ("spread", F.greatest(F.col(x)[2] - F.col(x)[0], F.lit(1e-6))))),
    )


def unsteady() -> Column:
    return F.sqrt(1 + STEADY / F.greatest("n_bytes", F.lit(1)))


def quantiles(values: DataFrame, keys: list[str], tail: float) -> DataFrame:
    """``keys``, ``n`` and the exact ``LIMITS`` of each group of ``(keys, score, word_score)``; between
    two values a limit is interpolated.

    A sketch tells the values around each limit from the rest. The rest is only counted, so
    what is put in order is a five hundredth of a group, however large.
    """
    wide = 10 / NEAR
    wanted = list(zip(LIMITS, ("score", "score", "word_score", "word_score"), (tail, 1 - tail) * 2))
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), F.col(x).alias("value")) for name, x, q in wanted))
    rows = values.select(*keys, F.inline(each)).where("value IS NOT NULL")
    ends = [min(max(end, 0.0), 1.0) for q in (tail, 1 - tail) for end in (q - wide, q + wide)]
    few = F.col("n") <= NEAR
    first = F.col("q") == tail
    around = rows.groupBy(*keys, "name", "q").agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.percentile_approx("value", ends, NEAR).alias("ends"),
    ).select(
        *(F.col(k).alias(f"__{k}") for k in (*keys, "name")), "n", ((F.col("n") - 1) * F.col("q")).alias("at"),
        F.when(few, F.col("least")).when(first, F.col("ends")[0]).otherwise(F.col("ends")[2]).alias("low"),
        F.when(few, F.col("most")).when(first, F.col("ends")[1]).otherwise(F.col("ends")[3]).alias("high"),
    )
    same = F.lit(True)
    for k in (*keys, "name"):
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    value = F.col("value")
    spot = F.when(value < F.col("low"), float("-inf")).when(value > F.col("high"), float("inf")).otherwise(value)
    spots = rows.join(F.broadcast(around), same).groupBy(*keys, "name", "n", "at", spot.alias("spot")).agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(*keys, "name").orderBy("spot"))
    below, above = F.floor("at"), F.ceil("at")
    found = spots.withColumn("upto", upto).groupBy(*keys, "name", "n", "at").agg(
        F.min(F.when(F.col("upto") > below, F.col("spot"))).alias("one"),
        F.min(F.when(F.col("upto") > above, F.col("spot"))).alias("two"),
    )
    missed = F.abs("one").isin(float("inf")) | F.abs("two").isin(float("inf"))
    limit = (
        F.when(missed, F.raise_error(F.lit("a limit lies outside the values around it")).cast("double"))
        .when(below == above, F.col("one"))
        .otherwise((above - F.col("at")) * F.col("one") + (F.col("at") - below) * F.col("two"))
    )
    return found.withColumn("limit", limit).groupBy(*keys).agg(
        F.max("n").alias("n"), *(F.max(F.when(F.col("name") == name, F.col("limit"))).alias(name) for name in LIMITS)
    )


def limits(measured: DataFrame, labels: DataFrame, tail: float) -> DataFrame:
    """``(every, of, n)`` and the limits in units, lower and upper of the score, of the word score: for
    each language ``of`` with labelled good documents, and for all together (``every``)."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("__quality")).where("__quality = 1").select(F.col("doc_id").alias("__id"))
    rows = measured.where(~base_failed()).join(good, F.col("doc_id") == F.col("__id"), "left_semi")
    rows = rows.join(F.broadcast(spreads(measured)), F.col("lang").eqNullSafe(F.col("__lang")))  # a row per language
    units = [((F.col(x) - F.col(f"__{x}_middle")) / F.col(f"__{x}_spread") / unsteady()).alias(x) for x in ("score", "word_score")]
    rows = stored(rows.select(F.col("lang").alias("of"), *units), "labelled-units")
    both = F.array(F.struct(F.lit(False).alias("every"), "of"), F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("of")))
    return stored(quantiles(rows.select(F.inline(both), "score", "word_score"), ["every", "of"], tail), "limits")


def judge(
    docs: DataFrame, labels: DataFrame | None = None, keep: tuple[str, ...] | None = None, most: int = MOST,
    tail: float = TAIL, least: int = LEAST,
) -> DataFrame:
    """``docs`` plus metrics, ``score`` and ``word_score``, the limits of both, ``base_failed`` and ``kept``.

    Trains on ``docs`` itself and measures them once, into the shared folder, with the
    columns ``keep`` (``doc_id`` and ``lang`` among them), all by default. ``labels`` is
    ``(doc_id, quality)``, 1 for good documents.
    """
    columns = list(keep or [c for c in docs.columns if c not in (*ADDED, *LIMITS, "base_failed", "kept")])
    counts = stored(count_grams(docs), "gram-counts")
    pooled = counts.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # 2**16 rows at most
    pairs = pair_logs(pooled.column("key").to_numpy().astype(np.uint64), pooled.column("n").to_numpy())
    groups = language_groups(counts, most)
    parts = [measure(docs.where(of_languages(names)), train(counts, names, pairs)) for names in groups]
    silent = docs.where(~of_languages([name for names in groups for name in names])) if groups else docs
    measured = measure(silent, {})  # documents of languages without any text
    for part in parts:
        measured = measured.unionByName(part)
    measured = stored(measured.select(*columns, *ADDED), "measured")
    default, spread = None, spreads(measured)
    if labels is not None:
        fitted = limits(measured, labels, tail)
        default = fitted.where("every").first()
        own = fitted.where(~F.col("every") & (F.col("n") >= least)).drop("every", "n")
        spread = spread.join(F.broadcast(own), F.col("__lang").eqNullSafe(F.col("of")), "left")
    else:
        spread = spread.withColumns({name: F.lit(None).cast("double") for name in LIMITS})
    spread = spread.select("*", *(F.col(name).alias(f"__{name}") for name in LIMITS)).drop(*LIMITS)
    default = [default[name] for name in LIMITS] if default else [-WIDTH, WIDTH, -WIDTH, WIDTH]
    joined = measured.join(F.broadcast(spread), F.col("lang").eqNullSafe(F.col("__lang")), "left")  # a row per language
    for k, (name, x) in enumerate(zip(LIMITS, ("score", "score", "word_score", "word_score"))):
        unit = F.coalesce(F.col(f"__{name}"), F.lit(float(default[k])))
        joined = joined.withColumn(name, F.col(f"__{x}_middle") + unit * F.col(f"__{x}_spread") * unsteady())
    inside = F.col("score").between(F.col("lower"), F.col("upper")) & F.col("word_score").between(F.col("word_lower"), F.col("word_upper"))
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    ).select(*columns, *ADDED, *LIMITS, "base_failed", "kept")
