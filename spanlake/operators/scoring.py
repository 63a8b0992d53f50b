"""Chunk scoring of gold tags against guessed tags.

``pairs`` holds one row per token: the sentence keys, ``tok_id``, ``gold`` and
``guess``. Rows tagged ``O`` on both sides open, close and score nothing, so all but
a sentence's first are dropped before the shuffle; a gap in ``tok_id`` then stands
for them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from spanlake.functions.numbers import f1, percent, with_fixed2
from spanlake.functions.tags import (
    OUTSIDE,
    chunk_end,
    chunk_start,
    normalise_raw,
    parsed,
    tag_prefix,
    tag_type,
)
from spanlake.operators.blocks import BLOCK, with_ghosts
from spanlake.operators.islands import merge_islands

SENTENCE = ("doc_id", "sent_id")
NEAR = 32  # positions that are matched in one place
PART = 4 << 20
UNKNOWN = 1 << 60
OVERALL = "(overall)"

# The task functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The words of the printed reports.
LATEX_HEAD = r"        & Precision &  Recall  & F$_{\beta=1} \\\hline"
SUMMARY = ("processed ", " tokens with ", " phrases; found: ", " phrases; correct: ", ".")
RATES = ("precision: ", "%; recall: ", "%; FB1: ")
ACCURACY = ("accuracy: ", "%; ")


def _parts(df: DataFrame) -> int:
    """Parts of about ``PART`` bytes of what the rows are read from, so that a part is sorted in memory.

    There are as many as shuffles have at least, and eight times as many at most; where the size is not known, no more.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= UNKNOWN else max(least, min(8 * least, -(-size // PART)))


def align(gold: DataFrame, pred: DataFrame, keys: Sequence[str] = SENTENCE) -> DataFrame:
    """Pair gold and predicted tags by position.

    ``status`` is ``matched``, ``gold_only`` or ``guess_only``. To score the result use
    ``whole_sentences``: a row left out would be taken for an ``O`` between its neighbours.
    """
    spot = F.expr(f"tok_id div {NEAR}").alias("__spot")
    g = gold.select(*keys, "tok_id", spot, F.col("iob").alias("gold"), F.lit(True).alias("in_gold"))
    p = pred.select(
        *(F.col(k).alias(f"__{k}") for k in (*keys, "tok_id")), spot.alias("__other"),
        F.col("iob").alias("guess"), F.lit(True).alias("in_pred"),
    )
    status = (
        F.when(F.col("in_pred").isNull(), "gold_only")
        .when(F.col("in_gold").isNull(), "guess_only")
        .otherwise("matched")
    )
    # As an array of one the tags and status of a position are made together: what looks at the status
    # alone, and what looks at the tags of matched rows, then read one and the same exchange.
    cell = F.array(F.struct("gold", "guess", status.alias("status")))
    # Rows are dealt out by their few neighbouring positions; within these the position decides, put
    # so that it is no key of the join.
    same = F.col("__spot") == F.col("__other")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    same = same & (F.col("tok_id") <= F.col("__tok_id")) & (F.col("tok_id") >= F.col("__tok_id"))
    both = (F.coalesce(k, f"__{k}").alias(k) for k in (*keys, "tok_id"))
    n = _parts(gold)
    g, p = g.repartition(n, "__spot", *keys), p.repartition(n, "__other", *(f"__{k}" for k in keys))
    return g.join(p, same, "full_outer").select(*both, F.inline(cell))


def _beside_unmatched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Is a row of this sentence, with no other sentence between, unmatched? A row is its sentence's
    hash and a flag in one number, since handing a row to Python costs by its columns."""
    for batch in batches:
        codes = batch.to_numpy(zero_copy_only=False)
        sentences = codes >> 1
        run = np.append(0, np.cumsum(sentences[1:] != sentences[:-1]))[: len(codes)]
        yield pa.array((np.bincount(run, weights=codes & 1) > 0)[run] if len(codes) else np.zeros(0, bool))


def whole_sentences(aligned: DataFrame, keys: Sequence[str] = SENTENCE) -> tuple[DataFrame, DataFrame]:
    """``align``'s sentences in which every token has both tags, ready to be scored, and
    the rows of the others.

    Told apart by the sentences of unmatched rows, one row each, so a sentence need not
    come together anywhere. Rows that stand beside an unmatched one of their sentence, as most of
    ``align``'s do, are left out before the others are exchanged.
    """
    matched, unmatched = aligned.where("status = 'matched'"), aligned.where("status <> 'matched'")
    incomplete = unmatched.select(*keys).distinct()
    code = F.shiftleft(F.xxhash64(*keys), 1).bitwiseOR((F.col("status") != "matched").cast("bigint"))
    broken = F.arrow_udf(_beside_unmatched, "boolean").asNondeterministic()
    left = aligned.withColumn("__code", code).withColumn("__broken", broken("__code"))
    left = left.where("status = 'matched' AND NOT __broken").drop("status", "__code", "__broken")
    whole = left.join(incomplete, list(keys), "left_anti")
    return whole, unmatched.unionByName(matched.join(incomplete, list(keys), "left_semi"))


def raw_tags(pairs: DataFrame, outside: str = "O") -> DataFrame:
    """Give prefixless tags a ``B-``; each token becomes its own chunk."""
    return pairs.withColumns(
        {c: normalise_raw(F.col(c), outside) for c in ("gold", "guess")}
    )


def split_tags(pairs: DataFrame) -> DataFrame:
    """Prefix and type of both tags as columns."""
    return pairs.select(
        "*",
        *(
            part(F.col(c)).alias(f"{c}_{name}")
            for c in ("gold", "guess")
            for name, part in (("prefix", tag_prefix), ("type", tag_type))
        ),
    )


def _same_tag(a: Column, b: Column) -> Column:
    return (tag_prefix(a) == tag_prefix(b)) & (tag_type(a) == tag_type(b))


def token_accuracy(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tokens whose prefix and type agree, of all tokens."""
    hit = _same_tag(F.col("gold"), F.col("guess"))
    out = pairs.groupBy(*keys).agg(F.count("*").alias("tokens"), F.count_if(hit).alias("matched"))
    return out.withColumn("accuracy", percent(F.col("matched"), F.col("tokens")))


def chunk_flags(
    pairs: DataFrame, keys: Sequence[str] = SENTENCE, block: int = BLOCK
) -> DataFrame:
    """Per token: does a chunk start here, did one end just before?"""
    rows, _ = _neighbours(pairs, ("gold", "guess"), keys, block)
    return rows.where(~F.col("ghost")).select(
        *keys,
        "tok_id",
        "gold",
        "guess",
        chunk_start("before_gold", "gold").alias("gold_start"),
        chunk_end("before_gold", "gold").alias("gold_end"),
        chunk_start("before_guess", "guess").alias("guess_start"),
        chunk_end("before_guess", "guess").alias("guess_end"),
    )


def _neighbours(
    pairs: DataFrame, tags: Sequence[str], keys: Sequence[str], block: int
) -> tuple[DataFrame, WindowSpec]:
    """Rows with the parsed tags before and after, ``O`` across a gap in positions.

    ``before_*`` and ``after_*`` are the neighbouring tokens' tags. ``last_*`` is
    the previous kept row's tag (NULL if none in this block) and ``next_of_*``
    the tag that followed that row. Tags are parsed once, before the shuffle, and
    travel as one struct.
    """
    w = Window.partitionBy(*keys, "blk").orderBy("tok_id")
    fields = [f"{t}_{part}" for t in tags for part in "pt"]
    split_up = parsed(tags)
    cell = F.struct("tok_id", "ghost", *(split_up[f].alias(f) for f in fields))
    rows = (
        with_ghosts(pairs.select(*keys, "tok_id", *tags), "tok_id", block)
        .select(*keys, "blk", "ghost", "tok_id", *tags, cell.alias("cell"))
        .withColumns({"last": F.lag("cell").over(w), "next": F.lead("cell").over(w)})
    )
    joined = F.col("last.tok_id") == F.col("tok_id") - 1
    joins = F.col("next.tok_id") == F.col("tok_id") + 1
    near = {
        "last_tok_id": F.col("last.tok_id"),
        "next_tok_id": F.col("next.tok_id"),
        "next_ghost": F.col("next.ghost"),
    }
    for f in fields:
        outside = OUTSIDE if f.endswith("_p") else ""
        near[f] = F.col(f"cell.{f}")
        near[f"last_{f}"] = F.col(f"last.{f}")
        near[f"before_{f}"] = F.when(joined, F.col(f"last.{f}")).otherwise(outside)
        near[f"after_{f}"] = F.when(joins, F.col(f"next.{f}")).otherwise(outside)
        near[f"next_of_{f}"] = F.when(joined, F.col(f"cell.{f}")).otherwise(outside)
    return rows.withColumns(near), w


def _states(pairs: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Start and end flags and the joint-match state of each kept token.

    A match opens where gold and guess start together with one type; it is lost
    or closed when either ends or the types part. ``state`` is the state on the
    token, NULL while it depends on an earlier block.
    """
    # First tokens stay, so that a corpus without any chunk still has its row.
    kept = pairs.where(~((F.col("gold") == "O") & (F.col("guess") == "O")) | (F.col("tok_id") == 1))
    rows, w = _neighbours(kept, ("gold", "guess"), keys, block)
    c = F.col
    rows = rows.withColumns(
        {
            "gold_start": chunk_start("before_gold", "gold"),
            "guess_start": chunk_start("before_guess", "guess"),
            "gold_end": chunk_end("gold", "after_gold"),
            "guess_end": chunk_end("guess", "after_guess"),
            "left": c("last_tok_id").isNotNull()
            & (chunk_end("last_gold", "next_of_gold") | chunk_end("last_guess", "next_of_guess")),
        }
    ).withColumnsRenamed({"gold_t": "gold_type", "guess_t": "guess_type"})
    same = c("gold_type") == c("guess_type")
    event = F.when(~c("ghost") & c("gold_start") & c("guess_start") & same, True).when(
        ~c("ghost") & (c("left") | ~same), False
    )
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.last(event, ignorenulls=True).over(run)
    state = F.when(c("blk") == 0, F.coalesce(known, F.lit(False))).otherwise(known)
    return rows.withColumn("state", state).where(~c("ghost"))


def _left_state() -> Column:
    """State after leaving the token."""
    return F.when(F.col("gold_end") | F.col("guess_end"), False).otherwise(F.col("state"))


def _hands_over() -> Column:
    """Last row of a block whose state a later block may need."""
    last = F.col("next_tok_id").isNull() | F.col("next_ghost")
    return last & ((F.col("blk") > 0) | _left_state())


def match_state(
    pairs: DataFrame, keys: Sequence[str] = SENTENCE, block: int = BLOCK
) -> DataFrame:
    """Tokens not ``O`` on both sides, with ``state`` (inside a joint match) and
    ``hit`` (a correct chunk ends here)."""
    rows = _states(pairs, keys, block).where(~((F.col("gold") == "O") & (F.col("guess") == "O")))
    w = Window.partitionBy(*keys).orderBy("blk")
    # One row per block border of long sentences; none for ordinary ones.
    carried = (
        rows.where(_hands_over())
        .select(
            *keys,
            F.lead("blk").over(w).alias("blk"),
            F.last(_left_state(), ignorenulls=True).over(w).alias("entering"),
        )
        .where(F.col("blk").isNotNull())
    )
    # Most rows know their state within the block; only those before a later block's first event
    # meet what enters it. Both branches read one exchange of the tokens.
    waiting = rows.where("state IS NULL").join(carried, [*keys, "blk"], "left")
    waiting = waiting.withColumn("state", F.coalesce("entering", F.lit(False)))
    columns = [
        *keys, "tok_id", "gold", "guess", "gold_start", "guess_start", "gold_end", "guess_end", "state",
        (F.col("state") & F.col("gold_end") & F.col("guess_end")).alias("hit"),
    ]
    return rows.where("state IS NOT NULL").select(*columns).unionByName(waiting.select(*columns))


def _tally(
    pairs: DataFrame, by: Sequence[str], keys: Sequence[str], block: int
) -> DataFrame:
    """Chunk counts per (gold type, guess type), in one pass over the tokens.

    A token that ends a chunk on both sides while ``state`` waits on an earlier
    block is *pending*; blocks of long sentences also hand over their final
    state. Both keep their block as a grouping key until the window below
    settles them; all other tokens collapse to one row per pair of types.
    """
    group = [*by, *(k for k in keys if k not in by)]
    rows = _states(pairs, group, block)
    both_end = F.col("gold_end") & F.col("guess_end")
    pending = F.col("state").isNull() & both_end
    hands_over = _hands_over()
    place = F.when(pending | hands_over, F.struct(*group, "blk"))
    sums = rows.groupBy(*by, "gold_type", "guess_type", place.alias("place")).agg(
        F.count_if("gold_start").alias("gold"),
        F.count_if("guess_start").alias("guessed"),
        F.count_if(F.col("state") & both_end).alias("correct"),
        F.count_if(pending).alias("pending"),
        F.max(F.when(hands_over, _left_state())).alias("out"),
    )
    earlier = (
        Window.partitionBy(*by, *(f"place.{k}" for k in group))
        .orderBy("place.blk")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    entering = F.coalesce(F.last("out", ignorenulls=True).over(earlier), F.lit(False))
    return sums.withColumn("entering", entering).select(
        *by,
        "gold_type",
        "guess_type",
        "gold",
        "guessed",
        (F.col("correct") + F.when(F.col("entering"), F.col("pending")).otherwise(0)).alias("correct"),
    )


def _per_type(tally: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per type and overall from counts per pair of types."""
    sides = F.array(
        F.struct(
            F.col("gold_type").alias("type"), "gold", F.lit(0).cast("bigint").alias("guessed"), "correct"
        ),
        F.struct(
            F.col("guess_type").alias("type"), F.lit(0).cast("bigint").alias("gold"), "guessed",
            F.lit(0).cast("bigint").alias("correct"),
        ),
    )
    rows = tally.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    totals = [F.sum(c).alias(c) for c in ("gold", "guessed", "correct")]
    out = (
        rows.groupingSets([[*by, "type"], [*by]], *by, "type")
        .agg(F.grouping("type").alias("all_types"), *totals)
        .withColumn("type", F.when(F.col("all_types") == 1, OVERALL).otherwise(F.col("type")))
    )
    seen = (F.col("gold") > 0) | (F.col("guessed") > 0) | (F.col("all_types") == 1)
    return out.where(seen).drop("all_types")


def chunk_counts(
    pairs: DataFrame, by: Sequence[str] = (), keys: Sequence[str] = SENTENCE, block: int = BLOCK
) -> DataFrame:
    """Chunks in gold and in guess, per type and overall."""
    rows = _states(pairs, [*by, *(k for k in keys if k not in by)], block)
    tally = rows.groupBy(*by, "gold_type", "guess_type").agg(
        F.count_if("gold_start").alias("gold"),
        F.count_if("guess_start").alias("guessed"),
        F.lit(0).cast("bigint").alias("correct"),
    )
    return _per_type(tally, list(by)).drop("correct")


def correct_chunks(
    pairs: DataFrame, by: Sequence[str] = (), keys: Sequence[str] = SENTENCE, block: int = BLOCK
) -> DataFrame:
    """Chunks with the same extent and type on both sides."""
    return score(pairs, by, keys, block).select(*by, "type", "correct")


def score(
    pairs: DataFrame, by: Sequence[str] = (), keys: Sequence[str] = SENTENCE, block: int = BLOCK
) -> DataFrame:
    """Precision, recall and F1 in percent, per type and overall.

    ``by`` adds columns (run, corpus) to report separately.
    """
    counts = _per_type(_tally(pairs, list(by), list(keys), block), list(by))
    return counts.withColumns(
        {
            "precision": percent(F.col("correct"), F.col("guessed")),
            "recall": percent(F.col("correct"), F.col("gold")),
        }
    ).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def chunk_spans(
    tokens: DataFrame, tag: str = "iob", keys: Sequence[str] = SENTENCE, block: int = BLOCK
) -> DataFrame:
    """``(start, end, type)`` of each chunk under the scorer's rules."""
    kept = tokens.select(*keys, "tok_id", F.col(tag).alias("tag")).where(F.col("tag") != "O")
    rows, _ = _neighbours(kept, ("tag",), keys, block)
    c = F.col
    rows = rows.where(~c("ghost")).select(
        *keys,
        "tok_id",
        c("tag_t").alias("type"),
        chunk_start("before_tag", "tag").alias("head"),
        chunk_end("tag", "after_tag").alias("ends"),
        "blk",
    )
    chunks = merge_islands(
        rows,
        keys,
        block,
        first={"type": c("type"), "open": c("head")},
        wanted=c("open"),
        lowest={"stop": F.when(c("ends"), c("tok_id"))},
    )
    return chunks.select(
        *keys,
        c("first_tok").alias("start"),
        F.coalesce("stop", "last_tok").alias("end"),
        "type",
    )


def report_lines(scores: DataFrame, accuracy: DataFrame | None = None, style: str = "text") -> DataFrame:
    """The printed report: ``(line_no, line)``, one line per type.

    ``scores`` comes from ``score`` and ``accuracy`` from ``token_accuracy``, both
    without extra keys; the text style needs both.
    """
    c = F.col
    if style == "text":
        return _text_report(scores, accuracy)
    if style != "latex":
        raise ValueError(f"unknown report style {style!r}")
    by_type = Window.orderBy("overall", "type")
    rows = with_fixed2(scores, ("precision", "recall", "f1"))
    rows = rows.withColumn("overall", c("type") == OVERALL).withColumn(
        "n", F.row_number().over(by_type)
    )
    head = LATEX_HEAD
    name = F.when(c("overall"), "Overall").otherwise(F.rpad("type", F.greatest(F.length("type"), F.lit(7)), " "))
    # The line before the overall row carries its own rule; it may be the header.
    penultimate = F.lead("overall").over(by_type)
    body = F.concat(
        name, F.lit(" &  "), "precision", F.lit(r"\% & "), "recall", F.lit(r"\% & "), "f1", F.lit(r" \\"),
        F.when(c("overall") | penultimate, r"\hline").otherwise(""),
    )
    header = F.when(c("overall"), F.lit(head + r"\hline")).otherwise(F.lit(head))
    lines = F.when(c("n") == 1, F.array(header, body)).otherwise(F.array(body))
    return (
        rows.select("n", lines.alias("lines"))
        .select("n", F.posexplode("lines").alias("i", "line"))
        .select((c("n") + F.when(c("n") == 1, c("i")).otherwise(1)).cast("bigint").alias("line_no"), "line")
        .orderBy("line_no")
    )


def _text_report(scores: DataFrame, accuracy: DataFrame) -> DataFrame:
    c = F.col
    # The accuracy row meets the overall row by grouping; both are single rows.
    totals = accuracy.select(F.lit(OVERALL).alias("type"), "tokens", "accuracy")
    rows = (
        scores.unionByName(totals, allowMissingColumns=True)
        .groupBy("type")
        .agg(*(F.max(x).alias(x) for x in (
            "gold", "guessed", "correct", "precision", "recall", "f1", "tokens", "accuracy")))
        .withColumn("overall", c("type") == OVERALL)
    )
    rows = with_fixed2(rows, ("precision", "recall", "f1", "accuracy"))
    count = [F.coalesce(x, F.lit(0)).cast("string") for x in ("tokens", "gold", "guessed", "correct")]
    between = [F.lit(words) for words in SUMMARY]
    summary = F.concat(*(x for pair in zip(between, count) for x in pair), between[-1])
    measures = [x for words, rate in zip(RATES, ("precision", "recall", "f1")) for x in (F.lit(words), c(rate))]
    rates = F.concat(F.lit(ACCURACY[0]), c("accuracy"), F.lit(ACCURACY[1]), *measures)
    name = F.lpad("type", F.greatest(F.length("type"), F.lit(17)), " ")
    detail = F.concat(name, F.lit(": "), *measures, F.lit("  "), c("guessed").cast("string"))
    lines = (
        F.when(~c("overall"), F.array(detail))
        .when(c("tokens") > 0, F.array(summary, rates))
        .otherwise(F.array(summary))
    )
    w = Window.orderBy(F.desc("overall"), "type", "i")
    return (
        rows.select("overall", "type", F.posexplode(lines).alias("i", "line"))
        .select(F.row_number().over(w).cast("bigint").alias("line_no"), "line")
        .orderBy("line_no")
    )
