"""Fragments to labelled, numbered tokens.

Tokens stay in one array per fragment until the last step, so labelling and edge
trimming are row-local.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from spanlake.functions.inventory import LEADING_EDGE, TRAILING_EDGE
from spanlake.functions.text import has_text, tokens_of
from spanlake.operators.blocks import BLOCK, block_of

Tagger = Callable[[list[list[str]]], list[list[str]]]
CONTEXT = 256  # tokens on either side of a block that its tagger sees as well
CALL = 1 << 16  # tokens of one call


def tokenize(
    df: DataFrame, col: str = "text", tokenizer: Callable[[pd.Series], pd.Series] | None = None
) -> DataFrame:
    """Add ``tokens array<string>``; rows without tokens are dropped.

    ``tokenizer`` maps a batch of texts to a batch of token lists and replaces the
    default rules.
    """
    if tokenizer is None:
        # Any text but whitespace has a token, and no default token is empty.
        return df.where(has_text(F.col(col))).withColumn("tokens", tokens_of(F.col(col)))
    schema = T.StructType([*df.schema.fields, T.StructField("tokens", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(tokens=tokenizer(batch[col]))

    made = df.mapInPandas(run, schema)
    return made.withColumn("tokens", F.filter("tokens", lambda t: t != "")).where(F.size("tokens") > 0)


def trim_edges(df: DataFrame) -> DataFrame:
    """Add ``lo`` and ``hi``: the tokens of an entity that keep its label.

    At most two articles or opening marks are cut in front, two closing marks at
    the back.
    """
    tokens, n = F.col("tokens"), F.size("tokens")

    def at(i: Column, edge: Sequence[str]) -> Column:
        return F.coalesce(F.get(tokens, i).isin(*edge), F.lit(False))

    lead_one = at(F.lit(0), LEADING_EDGE)
    lead_two = lead_one & at(F.lit(1), LEADING_EDGE)
    trail_one = at(n - 1, TRAILING_EDGE)
    trail_two = trail_one & at(n - 2, TRAILING_EDGE)
    return df.withColumns(
        {
            "lo": lead_one.cast("int") + lead_two.cast("int"),
            "hi": n - 1 - trail_one.cast("int") - trail_two.cast("int"),
        }
    )


def number_tokens(df: DataFrame, keys: Sequence[str] = ("doc_id", "sent_id")) -> DataFrame:
    """Add ``offset``: tokens of the sentence that precede the fragment."""
    before = (
        Window.partitionBy(*keys)
        .orderBy("frag_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    count = F.coalesce(F.sum(F.size("tokens")).over(before), F.lit(0))
    return df.withColumn("offset", count.cast("bigint"))


def label_tokens(df: DataFrame) -> DataFrame:
    """One row per token with its ``iob`` tag.

    Uses the bounds of ``trim_edges`` and the offset of ``number_tokens`` where
    present; without the latter ``tok_id`` counts within the fragment.
    """
    i = F.col("i")
    lo = F.col("lo") if "lo" in df.columns else F.lit(0)
    hi = F.col("hi") if "hi" in df.columns else F.size("tokens") - 1
    offset = F.col("offset") if "offset" in df.columns else F.lit(0)
    rest = [c for c in df.columns if c not in ("tokens", "text", "lo", "hi", "offset")]
    iob = (
        F.when(F.col("label").isNull() | (i < F.col("lo")) | (i > F.col("hi")), "O")
        .when(i == F.col("lo"), F.concat(F.lit("B-"), "label"))
        .otherwise(F.concat(F.lit("I-"), "label"))
    )
    return df.select(
        *rest, lo.alias("lo"), hi.alias("hi"), offset.alias("offset"), F.posexplode("tokens").alias("i", "token")
    ).select(*rest, (F.col("offset") + i + 1).cast("bigint").alias("tok_id"), "token", iob.alias("iob"))


def annotate(
    tokens: DataFrame, tagger: Tagger, keys: Sequence[str] = ("doc_id", "sent_id"), name: str = "pos",
    block: int = BLOCK, context: int = CONTEXT,
) -> DataFrame:
    """Add one label per token from a batch function over whole sentences.

    ``tagger`` maps a list of sentences (token lists) to equally long label lists; a call gets
    ``CALL`` tokens, or one sentence. A sentence of more than ``block`` tokens is handed over in
    blocks of that size, each with up to ``context`` tokens before and after it; the labels of
    those do not count, as their own block has them. So no sentence has to fit in a row.
    """
    if not 0 <= 2 * context <= block:
        raise ValueError("a block must hold its neighbours' context twice over")
    other = [c for c in tokens.columns if c not in keys and c != "tok_id"]
    own = block_of("tok_id", block)
    place = F.col("tok_id") - 1 - own * block  # within its block
    homes = (
        F.when((place < context) & (own > 0), F.array(own, own - 1))
        .when(place >= block - context, F.array(own, own + 1))
        .otherwise(F.array(own))
    )
    dealt = tokens.withColumn("__blk", F.explode(homes)).withColumn("__own", F.col("__blk") == own)
    # What stands at the end of a last block is copied to a block that has no tokens of its own.
    sentences = dealt.groupBy(*keys, "__blk").agg(
        F.array_sort(F.collect_list(F.struct("tok_id", "__own", *other))).alias("items")
    ).where(F.exists("items", lambda x: x["__own"])).drop("__blk")
    schema = T.StructType([*sentences.schema.fields, T.StructField("labels", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(pc.list_value_length(whole.column("items")).to_numpy())
            at = before = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, before + CALL, "right")))
                batch = whole.slice(at, to - at)
                words = [x.values.field("token").to_pylist() for x in batch.column("items")]
                labels = tagger(words)
                if [len(x) for x in labels] != [len(x) for x in words]:
                    raise ValueError("the tagger must return one label per token")
                columns = [*batch.columns, pa.array(labels, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at, before = to, int(sizes[to - 1])

    both = F.explode(F.arrays_zip("items", "labels")).alias("x")
    return sentences.mapInArrow(run, schema).select(*keys, both).where("x.items.__own").select(
        *keys, "x.items.*", F.col("x.labels").alias(name)
    ).drop("__own")
