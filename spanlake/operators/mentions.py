"""Entity mentions from labelled tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanlake.functions.tags import coarse_type, is_valid_type, mention_type
from spanlake.operators.blocks import BLOCK, block_of
from spanlake.operators.islands import merge_islands


def mentions(
    tokens: DataFrame, keys: Sequence[str] = ("data_set", "doc_id", "sent_id"), block: int = BLOCK
) -> DataFrame:
    """One row per valid mention.

    A ``B`` tag opens a mention; the ``I`` tags right after it are absorbed
    whatever their type. Stray ``I`` tags and labels outside the coarse types give
    nothing. ``O`` tokens are dropped before the shuffle: a gap in ``tok_id``
    marks them.
    """
    c = F.col
    rows = tokens.where(c("iob") != "O").select(
        *keys,
        "tok_id",
        "token",
        "pos",
        "iob",
        F.length("token").alias("length"),
        (~c("iob").startswith("I")).alias("head"),
        block_of("tok_id", block).alias("blk"),
    )
    # Lengths are summed apart from the texts: statistics then never carry those.
    label = mention_type(c("tag"))
    found = merge_islands(
        rows,
        keys,
        block,
        first={"tag": c("iob")},
        wanted=c("tag").startswith("B") & is_valid_type(coarse_type(label)),
        totals={"chars": c("length")},
        gather=("token", "pos"),
    )
    n_tokens = c("last_tok") - c("first_tok") + 1

    def joined(field: str) -> Column:
        return F.array_join(c("items")[field], " ")

    return found.select(
        *keys,
        "first_tok",
        coarse_type(label).alias("type"),
        label.alias("subtype"),
        joined("token").alias("tokens"),
        joined("pos").alias("pos"),
        n_tokens.alias("n_tokens"),
        (c("chars") + n_tokens - 1).alias("n_characters"),
    )


def by_type(found: DataFrame, coarse: str) -> DataFrame:
    """Mentions of one coarse type."""
    return found.where(F.col("type") == coarse)


def faulty(tokens: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``B`` labels outside the coarse types, with counts."""
    label = coarse_type(mention_type(F.col("iob")))
    return (
        tokens.where(F.col("iob").startswith("B") & ~is_valid_type(label))
        .groupBy(*keys, label.alias("label"))
        .agg(F.count("*").alias("n"))
    )


def token_counts(tokens: DataFrame, keys: Sequence[str] = ("data_set",)) -> DataFrame:
    """Tokens per corpus."""
    return tokens.groupBy(*keys).agg(F.count("*").alias("n_tokens"))
