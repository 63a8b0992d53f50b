"""Runs of adjacent tokens, each opened by a head row.

Shared by mention extraction and chunk spans. A run is cut at block borders and
put together again, so that neither a huge sentence nor a huge run of short ones
needs one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def merge_islands(
    rows: DataFrame,
    keys: Sequence[str],
    block: int,
    first: dict[str, Column],
    wanted: Column,
    lowest: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    gather: Sequence[str] = (),
) -> DataFrame:
    """Aggregate each run of consecutive ``tok_id`` opened by a ``head`` row.

    ``rows`` has ``keys``, ``blk``, ``tok_id`` and the boolean ``head``. A row
    that neither is a head nor follows its predecessor opens a run of its own.
    ``first`` holds values of the opening row, by which ``wanted`` picks the runs
    to return; ``lowest`` minima and ``totals`` sums over the run, ``gather`` columns
    collected in token order (``items``). Adds ``first_tok`` and ``last_tok``.
    """
    lowest, totals = lowest or {}, totals or {}
    measures = {**lowest, **totals}
    merge = [*(F.min(n).alias(n) for n in lowest), *(F.sum(n).alias(n) for n in totals)]
    c = F.col
    w = Window.partitionBy(*keys, "blk").orderBy("tok_id")
    at_border = (c("tok_id") - 1) % block == 0
    follows = F.coalesce(F.lag("tok_id").over(w) == c("tok_id") - 1, F.lit(False))
    # The first row of a later block may continue a run of the block before.
    opens = c("head") | ~(follows | (at_border & (c("blk") > 0)))
    def opening(flag: str, order: WindowSpec, column: Column) -> Column:
        """The column on the last row so far where the flag is set."""
        run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.last(F.when(c(flag), column), ignorenulls=True).over(run)

    names = list(first)
    items = F.struct("tok_id", *gather)
    pieces = (
        rows.withColumn("opens", opens)
        .withColumn("from", opening("opens", w, F.struct("tok_id", *(col.alias(n) for n, col in first.items()))))
        # The opening row's values are grouping keys, not aggregates: the
        # aggregation then needs no sort.
        .select(
            *keys, "blk", "tok_id", *(col.alias(n) for n, col in measures.items()), *gather,
            F.coalesce("from.tok_id", F.lit(0)).alias("piece"), *(c(f"from.{n}").alias(n) for n in names),
        )
        .groupBy(*keys, "blk", "piece", *names)
        .agg(
            F.min("tok_id").alias("first_tok"),
            F.max("tok_id").alias("last_tok"),
            *merge,
            *([F.array_sort(F.collect_list(items)).alias("items")] if gather else []),
        )
    )
    # Only pieces that touch a border can belong together. The others are settled and stay
    # where they are; both branches read the one exchange above.
    touches = (c("piece") == 0) | (c("last_tok") % block == 0)
    columns = [*keys, "first_tok", "last_tok", *names, *measures, *(["items"] if gather else [])]
    settled = pieces.where(~touches & wanted).select(*columns)
    across = Window.partitionBy(*keys).orderBy("first_tok")
    fresh = (c("piece") > 0) | ~F.coalesce(
        F.lag("last_tok").over(across) == c("first_tok") - 1, F.lit(False)
    )
    merged = (
        pieces.where(touches)
        .withColumn("fresh", fresh)
        .withColumn("from", opening("fresh", across, F.struct("first_tok", *names)))
        .select(
            *keys, "last_tok", *measures, *(["items"] if gather else []),
            c("from.first_tok").alias("first_tok"), *(c(f"from.{n}").alias(n) for n in names),
        )
        .groupBy(*keys, "first_tok", *names)
        .agg(
            F.max("last_tok").alias("last_tok"),
            *merge,
            *([F.array_sort(F.flatten(F.collect_list("items"))).alias("items")] if gather else []),
        )
    )
    return settled.unionByName(merged.where(wanted).select(*columns))
