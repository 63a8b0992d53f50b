"""Marked-up documents to fragments, fragments to sentences.

Each document is one row holding its whole text, so the windows below, which run
per document, never see more than one row's text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from spanlake.functions.inventory import NOISE_LABEL
from spanlake.functions.markup import TAG, TAG_NAME, balanced
from spanlake.functions.text import (
    decode_references,
    ends_terminal,
    has_text,
    squash,
    starts_lower,
    upper_majority,
)

# The pieces a text falls into: a tag with the text after it, text alone, or a bracket
# that opens no tag.
PIECE = rf"({TAG}[^<]*+|[^<]++|<[^<]*+)"
CORRECTION = r"""\scorrection=(?:"([^"]*)"|'([^']*)')"""
MODES = ("n", "c")
KEYS = ("doc_id",)


def _by_pos(keys: Sequence[str]) -> WindowSpec:
    return (
        Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _same_level(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "level").orderBy("pos")


def _dealt(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents dealt out whole, before they fall into pieces.

    A text takes more room in pieces, so these parts are not put together again.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(*keys, "text").repartition(parts, *keys)


def pieces(docs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each tag with the text after it, and the nesting depth.

    ``step`` is +1 for an opening tag, -1 for a closing one; ``depth`` counts the
    annotations open after it; ``level`` is the annotation a tag opens or closes;
    ``given`` is the correction of the tag (``tag``, empty for text alone), if it has one.
    """
    c = F.col
    is_tag = c("tag") != ""
    closed = c("tag").startswith("</")
    empty = c("tag").endswith("/>")
    double, single = (F.regexp_extract("tag", CORRECTION, i) for i in (1, 2))
    return (
        _dealt(docs, keys)
        .select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(1))).alias("pos", "piece"))
        .withColumn("tag", F.regexp_extract("piece", rf"^({TAG})", 1))
        .select(
            *keys,
            "pos",
            "tag",
            F.when(is_tag, F.regexp_extract("tag", TAG_NAME, 1)).alias("name"),
            F.when(closed, -1).when(is_tag & ~empty, 1).otherwise(0).alias("step"),
            F.substr("piece", F.length("tag") + 1).alias("after"),
            F.when(
                is_tag & ~closed & ~empty & c("tag").rlike(CORRECTION),
                F.when(double != "", double).otherwise(single),
            ).alias("given"),
        )
        .withColumn("depth", F.sum("step").over(_by_pos(keys)))
        .withColumn("level", F.when(c("step") == 1, c("depth")).when(c("step") == -1, c("depth") + 1))
    )


def _with_fault(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``fault``: a closing tag with nothing, or another name, to close."""
    opened = F.lag("name").over(_same_level(keys))
    fault = (F.col("step") == -1) & ((F.col("level") < 1) | ~F.col("name").eqNullSafe(opened))
    return rows.withColumn("fault", fault)


def markup_errors(docs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Documents whose annotations are not properly nested."""
    return (
        _with_fault(pieces(docs, keys), keys)
        .groupBy(*keys)
        .agg(
            F.sum("step").cast("bigint").alias("unclosed"),
            F.min("depth").cast("bigint").alias("min_depth"),
            F.count_if("fault").alias("faults"),
        )
        .where((F.col("unclosed") != 0) | (F.col("faults") > 0))
    )


def _apply_corrections(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put each ``correction`` attribute in place of its annotation's content."""
    c = F.col
    turn = (
        F.when(c("given").isNotNull(), 1)
        .when((c("step") == -1) & F.lag("given").over(_same_level(keys)).isNotNull(), -1)
        .otherwise(0)
    )
    rows = rows.withColumn("turn", turn).withColumn("inside", F.sum("turn").over(_by_pos(keys)))
    content = (
        F.when(c("given").isNotNull() & (c("inside") == 1), c("given"))
        .when(c("inside") > 0, "")
        .otherwise(c("after"))
    )
    return rows.withColumn("after", content)


def fragments(docs: DataFrame, mode: str = "n", keys: Sequence[str] = KEYS) -> DataFrame:
    """``fragments(keys, frag_id, text, label)`` of every document; ``keys`` tell them apart.

    An outermost annotation is one fragment, markup inside it flattened; plain
    text gives one fragment per line (``label`` NULL). Mode ``c`` uses the
    corrections given as attributes. Markup that does not nest is put right first
    (``functions.markup.put_right`` has the rule); ``markup_errors`` reports it.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    c = F.col
    outer_open = (c("step") == 1) & (c("depth") == 1)
    outer_close = (c("step") == -1) & (c("depth") == 0)
    empty_tag = (c("tag") != "") & (c("step") == 0) & (c("depth") == 0)
    # Odd runs are outermost annotations, even runs the plain text between them.
    turn = F.when(outer_open | outer_close, 1).when(empty_tag, 2).otherwise(0)
    sound = docs.select(*keys, balanced(F.col("text")).alias("text"))
    rows = pieces(sound, keys).withColumn("turn", turn).withColumn("run", F.sum("turn").over(_by_pos(keys)))
    if mode == "c":
        rows = _apply_corrections(rows, keys)
    runs = (
        rows.groupBy(*keys, "run")
        .agg(
            F.max(F.when(outer_open, F.regexp_extract("tag", TAG_NAME, 1))).alias("name"),
            F.sort_array(F.collect_list(F.struct("pos", "after"))).alias("parts"),
        )
    )
    label = F.when(c("name") != NOISE_LABEL, c("name"))
    texts = runs.select(
        *keys, "run", label.alias("label"), F.array_join(c("parts")["after"], "").alias("text")
    ).withColumn("text", decode_references(c("text")))
    cut = F.when(c("run") % 2 == 0, F.split("text", "\n")).otherwise(F.array("text"))
    order = Window.partitionBy(*keys).orderBy("run", "line")
    return (
        texts.select(*keys, "run", "label", F.posexplode(cut).alias("line", "text"))
        .where(has_text(c("text")))
        .withColumn("text", squash(c("text")))
        .select(*keys, F.row_number().over(order).cast("bigint").alias("frag_id"), "text", "label")
    )


def assemble_sentences(frags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``sent_id`` (from 0): which fragments belong to one sentence."""
    w = Window.partitionBy(*keys).orderBy("frag_id")
    prev = F.lag("text").over(w)
    text = F.col("text")
    open_before = ~ends_terminal(F.col("prev"))
    goes_on = (
        ((starts_lower(text) | F.col("label").isNotNull()) & open_before)
        | (upper_majority(text) & upper_majority(F.col("prev")))
    )
    new = F.when(F.col("prev").isNull() | ~goes_on, 1).otherwise(0)
    started = F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return frags.withColumn("prev", prev).withColumn("sent_id", (started - 1).cast("bigint")).drop("prev")
