"""Summaries of mentions and corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from spanlake.functions.inventory import COARSE_TYPES
from spanlake.functions.numbers import clip, round2

UNITS = {"token": "n_tokens", "character": "n_characters"}


def length_crosstab(found: DataFrame, unit: str, max_len: int) -> DataFrame:
    """Mentions by type and clipped length.

    Rows by falling total, then ``(total)`` and ``(percent)`` (share of each
    length). Columns ``len_0`` .. ``len_<max>``, ``total``, ``percent``.
    """
    length = clip(F.col(UNITS[unit]), 0, max_len)
    lengths = [f"len_{i}" for i in range(max_len + 1)]
    cells = {c: F.count_if(length == i).cast("double") for i, c in enumerate(lengths)}
    per_type = found.groupBy("type").agg(
        *(col.alias(c) for c, col in cells.items()), F.count("*").cast("double").alias("total")
    )
    counts = per_type.rollup("type").agg(
        F.grouping("type").alias("all_types"), *(F.sum(c).alias(c) for c in (*lengths, "total"))
    )
    # There is one row per type here.
    everything = Window.partitionBy()
    total = F.max("total").over(everything)
    share = F.when(F.col("all_types") == 0, round2(F.col("total") * 100 / F.col("grand")))
    counts = counts.withColumn("grand", total).withColumn("share", share)
    counts = counts.withColumn("shares", round2(F.sum("share").over(everything)))
    kinds = F.when(F.col("all_types") == 1, F.array(F.lit("(total)"), F.lit("(percent)"))).otherwise(
        F.array("type")
    )
    rows = counts.withColumn("row", F.explode(kinds))
    is_percent = F.col("row") == "(percent)"
    return rows.orderBy("all_types", F.desc("total"), "type", F.desc("row")).select(
        F.col("row").alias("type"),
        *(
            F.when(is_percent, round2(F.col(c) * 100 / F.col("grand"))).otherwise(F.col(c)).alias(c)
            for c in lengths
        ),
        F.when(~is_percent, F.col("total")).alias("total"),
        F.when(F.col("row") == "(total)", F.col("shares")).when(~is_percent, F.col("share")).alias("percent"),
    )


def length_histogram(found: DataFrame, unit: str, start: int, stop: int, step: int) -> DataFrame:
    """Mentions per type and length bin, empty bins included.

    Bins are ``step`` wide between the edges of ``range(start, stop, step)``; the
    last one takes everything longer.
    """
    edges = list(range(start, stop, step))
    last = len(edges) - 2
    names = [f"{a}-{b - 1}" for a, b in zip(edges[:-2], edges[1:])] + [f"{edges[-2]}+"]
    value = clip(F.col("value"), edges[0], edges[-1])
    index = F.when(value >= edges[-2], F.lit(last)).otherwise(F.floor((value - start) / step))
    # One empty row per type keeps types without mentions in the result.
    seed = found.sparkSession.createDataFrame([(t, None) for t in COARSE_TYPES], "type string, value bigint")
    rows = found.select("type", F.col(UNITS[unit]).alias("value")).unionByName(seed)
    bins = F.array(
        *(
            F.struct(F.lit(i).cast("bigint").alias("bin"), F.lit(name).alias("label"), F.col(f"b{i}").alias("n"))
            for i, name in enumerate(names)
        )
    )
    return (
        rows.withColumn("bin", index)
        .groupBy("type")
        .agg(*(F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(last + 1)))
        .select("type", F.inline(bins))
    )


HEAD = 4  # characters of a tag that choose its bucket


def tag_dictionary(tokens: DataFrame, tag: str = "iob") -> DataFrame:
    """Distinct tags with an id from 0, in order of the tag.

    Tags are numbered within buckets of equal beginnings, which lie in the same order, and
    the buckets' sizes give each one its offset; so only the list of beginnings, and not
    the tags, is ordered as a whole.
    """
    tags = tokens.select(F.col(tag).alias("tag")).distinct().withColumn("head", F.left("tag", F.lit(HEAD)))
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tags.groupBy("head").agg(F.count("*").alias("n")).select(
        F.col("head").alias("bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    place = F.row_number().over(Window.partitionBy("head").orderBy("tag")) - 1
    return (
        tags.withColumn("place", place)
        .join(offsets, F.col("head").eqNullSafe(F.col("bucket")))
        .select("tag", (F.col("offset") + F.col("place")).cast("bigint").alias("id"))
    )


def corpus_summary(
    tokens: DataFrame, by: Sequence[str] = ("data_set",), keys: Sequence[str] = ("doc_id", "sent_id")
) -> DataFrame:
    """Sentences, tokens and the longest sentence per corpus."""
    sentences = tokens.groupBy(*by, *keys).agg(F.count("*").alias("n"))
    return sentences.groupBy(*by).agg(
        F.count("*").alias("sentences"), F.sum("n").alias("tokens"), F.max("n").alias("longest")
    )
