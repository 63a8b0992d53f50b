"""Ordered work inside groups of unbounded size.

A window over one sentence puts that sentence in one task. To keep a huge
sentence (a column file without blank lines) spread out, positions are cut into
blocks of ``BLOCK`` and windows run per (sentence, block). The row on either side
of a block border is repeated in the neighbouring block as a *ghost*, so that
``lag`` and ``lead`` see across the border in the same single shuffle. State that
reaches further than one row is settled from one small record per block.

Positions must be the 1-based position in the sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 1 << 16


def block_of(position: str, size: int) -> Column:
    """Block number of a position column, from 0."""
    return F.expr(f"({position} - 1) div {size}")


def with_ghosts(df: DataFrame, order: str, size: int) -> DataFrame:
    """Add ``blk`` and ``ghost``; border rows appear in both blocks."""
    if size < 2:
        raise ValueError("block size must be at least 2")
    pos = F.col(order)
    own = block_of(order, size)
    homes = (
        F.when(pos % size == 0, F.array(own, own + 1))
        .when((pos % size == 1) & (own > 0), F.array(own, own - 1))
        .otherwise(F.array(own))
    )
    return df.withColumn("blk", F.explode(homes)).withColumn("ghost", F.col("blk") != own)
