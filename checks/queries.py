"""One Spark query per operator: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import fixtures as X
from spanlake.functions import tags, text
from spanlake.operators import chars, corpora, fragments, labels, mentions, scoring, splits, stats
from spanlake.plans import jobs
from spanlake.sources import annotated, columns, pairs
from spanlake.sources.workspace import new_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Sources and sinks


@query
def corpus_scan(spark, sf):
    folder = new_folder(spark, "data/press/trn")
    X.write_documents(X.table(spark, sf, "documents"), folder)
    return annotated.read_annotated(spark, folder)


@query
def clean_lines(spark, sf):
    docs = X.table(spark, sf, "documents")
    ragged = F.concat(F.lit("  \r\n\t"), F.replace("text", F.lit("\n"), F.lit(" \r\n \n\tp1.png\n  ")))
    return docs.select("doc_id", text.clean_lines(ragged).alias("text"))


def _written_columns(spark, sf):
    folder = X.files(spark, sf, "columns", lambda folder: columns.write_columns(X.tokens(spark, sf), folder))
    return columns.read_columns(spark, folder)


def _stretches(rows: DataFrame, keys: tuple[str, ...], joined: dict[str, str]) -> DataFrame:
    """``keys``, the first and ``last`` ``tok_id``, the rows ``n`` and the ``joined`` texts of rows that
    stand next to each other in a task, agree in ``keys`` and have consecutive ``tok_id``. Read from files, most sentences are one
    such stretch, so that sentences and not tokens are grouped afterwards.

    Handing a row to Python costs by its columns: the texts are handed over with one number, by which
    neighbours of a stretch agree, and what is made of them comes back with the stretch's last row."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for code, *columns in batches:
            codes = code.to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.append(codes[1:] != codes[:-1], [True] * min(1, len(codes)))) + 1
            cuts = np.append(0, ends)
            texts = []
            for column, between in zip(columns, joined.values()):  # nulls are left out, a stretch of nulls is null
                filled = np.concatenate([[0], np.cumsum(column.is_valid().to_numpy(zero_copy_only=False))])[cuts]
                lists = pa.ListArray.from_arrays(pa.array(filled, pa.int32()), column.drop_null())
                texts.append(pc.if_else(pa.array(np.diff(filled) > 0), pc.binary_join(lists, between), None))
            place = np.full(len(codes), -1)
            place[ends - 1] = np.arange(len(ends))
            at = pa.array(place, pa.int64(), mask=place < 0)
            yield pa.StructArray.from_arrays([x.take(at) for x in (pa.array(np.diff(cuts), pa.int64()), *texts)], names=["n", *joined])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, ", ".join(["n bigint", *(f"{x} string" for x in joined)])).asNondeterministic()
    code = F.xxhash64(*keys, F.col("tok_id") - F.monotonically_increasing_id())
    ended = rows.withColumn("code", code).select(*keys, F.col("tok_id").cast("bigint").alias("last"), made("code", *joined).alias("made"))
    return ended.where("made.n IS NOT NULL").select(*keys, (F.col("last") - F.col("made.n") + 1).alias("tok_id"), "last", "made.*")


def _by_sentence(rows: DataFrame, keys: tuple[str, ...], joined: dict[str, str]) -> DataFrame:
    """One row per sentence: its ``joined`` texts in the order of the tokens, ``n`` and ``last``."""
    parts = F.sort_array(F.collect_list(F.struct("tok_id", *joined)))
    return _stretches(rows, keys, joined).groupBy(*keys).agg(
        parts.alias("parts"), F.sum("n").alias("n"), F.max("last").alias("last")
    ).select(*keys, *(F.array_join(F.col("parts")[x], between).alias(x) for x, between in joined.items()), "n", "last")


@query
def read_columns(spark, sf):
    rows = _written_columns(spark, sf).withColumnRenamed("token", "text")
    return _by_sentence(rows, ("data_set", "file", "sent_id"), {"text": " ", "pos": "", "iob": " "}).drop("file", "sent_id")


def _pair_lines(spark, sf):
    """The lines of a pair file with ``-X-`` lines and trailing blanks."""
    rows = pairs.format_pairs(X.pairs(spark, sf))
    line = F.expr(
        "case when line = '' and sent_id % 3 = 0 then '-X- O O' when line = '' and sent_id % 3 = 1 then '  '"
        " when line <> '' and tok_id % 5 = 2 then concat(line, '  ') else line end"
    )
    return rows.withColumn("line", line)


def _write_lines(rows, folder):
    """Sentences whole and in order; ``format_pairs`` brought each together."""
    rows.sortWithinPartitions("doc_id", "sent_id", "tok_id").select("line").write.text(folder)


def prepare_pairs(spark, sf):
    return X.files(spark, sf, "pair-files", lambda folder: _write_lines(_pair_lines(spark, sf), folder))


@query
def read_pairs(spark, sf):
    folder = prepare_pairs(spark, sf)
    back = pairs.read_pairs(spark, folder)
    rows = back.withColumn("lines", F.concat_ws(" ", "token", "gold", "guess"))
    return _by_sentence(rows, ("file", "sent_id"), {"lines": "|"}).drop("file", "sent_id")


@query
def width_check(spark, sf):
    folder = new_folder(spark, "ragged")
    rows = _pair_lines(spark, sf)
    extra = F.when((F.col("tok_id") > 1) & (F.col("line") != "") & (F.col("doc_id") % 50 == 0), F.concat(F.lit("x "), "line"))
    _write_lines(rows.withColumn("line", F.coalesce(extra, "line")), folder)
    widths = pairs.check_width(spark, folder)
    return widths.groupBy("width", "ok").agg(F.sum("lines").alias("lines"))


@query
def format_columns(spark, sf):
    return columns.format_columns(X.tokens(spark, sf))


@query
def score_report(spark, sf):
    p = X.pairs(spark, sf)
    return scoring.report_lines(scoring.score(p), scoring.token_accuracy(p))


@query
def score_report_latex(spark, sf):
    return scoring.report_lines(scoring.score(X.pairs(spark, sf)), style="latex")


@query
def split_files(spark, sf):
    folder = new_folder(spark, "splits")
    sentences = splits.shard(splits.split(splits.plain_text(X.tokens(spark, sf))))
    columns.write_splits(sentences, folder)
    back = spark.read.text(folder)
    return back.select("split", F.col("shard").cast("bigint").alias("shard"), F.col("value").alias("text"))


# Text repair


@query
def escape_tags(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", text.escape_unknown_tags(F.col("html")).alias("html"))


@query
def unwrap_lines(spark, sf):
    cleaned = text.clean_lines(F.col("text"))
    return X.table(spark, sf, "documents").select("doc_id", text.unwrap_lines(cleaned).alias("text"))


@query
def break_punct(spark, sf):
    single = text.squash(F.col("text"))
    return X.table(spark, sf, "documents").select("doc_id", text.break_after_punct(single).alias("text"))


@query
def dehyphenate(spark, sf):
    return X.hyphenated(spark, sf).select("doc_id", "sent_id", text.dehyphenate(F.col("text")).alias("text"))


@query
def squash_ws(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", text.squash(F.replace("html", F.lit(">"), F.lit(">\n\t "))).alias("html"))


@query
def case_majority(spark, sf):
    return X.lines(spark, sf).select("doc_id", "sent_id", text.upper_majority(F.col("line")).alias("upper"))


# Tags


@query
def split_tags(spark, sf):
    return scoring.split_tags(X.pairs(spark, sf)).drop("source", "token")


@query
def raw_tags(spark, sf):
    rows = scoring.raw_tags(X.raw_pairs(spark, sf), outside="NONE")
    return rows.select("doc_id", "sent_id", "tok_id", "gold", "guess")


@query
def coarse_types(spark, sf):
    coarse = tags.coarse_type(tags.mention_type(F.col("iob")))
    return (
        X.tokens(spark, sf)
        .where("iob <> 'O'")
        .select("doc_id", "sent_id", "tok_id", coarse.alias("type"), tags.is_valid_type(coarse).alias("valid"))
    )


@query
def references(spark, sf):
    """Characters written as references of each kind, and one name that stands for none."""
    written = F.col("text")
    for char, ref in X.REFERENCES.items():
        written = F.replace(written, F.lit(char), F.lit(ref))
    return X.table(spark, sf, "documents").select("doc_id", text.decode_references(written).alias("text"))


# Fragments, sentences, labels


@query
def fragments_(spark, sf):
    return fragments.fragments(X.annotated(spark, sf))


QUERIES["fragments"] = QUERIES.pop("fragments_")


@query
def fragments_lenient(spark, sf):
    return fragments.fragments(X.broken(spark, sf))


@query
def corrections(spark, sf):
    return fragments.fragments(X.annotated(spark, sf), mode="c")


@query
def markup_errors(spark, sf):
    return fragments.markup_errors(X.broken(spark, sf))


def _sentences(spark, sf):
    return fragments.assemble_sentences(fragments.fragments(X.annotated(spark, sf)))


@query
def sentence_assembly(spark, sf):
    return _sentences(spark, sf).select("doc_id", "frag_id", "sent_id")


@query
def tokenize(spark, sf):
    rows = labels.tokenize(X.lines(spark, sf), "line")
    return rows.select("doc_id", "sent_id", F.posexplode("tokens").alias("i", "token")).select(
        "doc_id", "sent_id", (F.col("i") + 1).cast("bigint").alias("tok_id"), "token"
    )


@query
def label_tokens(spark, sf):
    rows = labels.label_tokens(labels.tokenize(_sentences(spark, sf)))
    return rows.select("doc_id", "frag_id", "tok_id", "token", "iob")


@query
def trim_edges(spark, sf):
    marked = F.expr(
        "case when label is null then text when frag_id % 3 = 0 then concat('« (', text, ') .')"
        " when frag_id % 3 = 1 then concat('l\\'', text) else concat(text, ' !') end"
    )
    frags = _sentences(spark, sf).withColumn("text", marked)
    rows = labels.label_tokens(labels.trim_edges(labels.tokenize(frags)))
    return rows.select("doc_id", "frag_id", "tok_id", "token", "iob")


@query
def number_tokens(spark, sf):
    rows = labels.number_tokens(labels.trim_edges(labels.tokenize(_sentences(spark, sf))))
    return labels.label_tokens(rows).select("doc_id", "sent_id", "tok_id", "token", "iob")


@query
def annotate_hook(spark, sf):
    def shape(token):
        first = token[0]
        return "X" if first.isupper() else "x" if first.islower() else "d" if first.isnumeric() else "p"

    def shapes(sentences):
        return [[shape(t) for t in s] for s in sentences]

    words = X.words(spark, sf).select("doc_id", "sent_id", "tok_id", "token")
    return labels.annotate(words, shapes)


@query
def documents_to_tokens(spark, sf):
    return jobs.documents_to_tokens(X.annotated(spark, sf))


# Scoring


@query
def align_pairs(spark, sf):
    return scoring.align(X.tokens(spark, sf, deal=False), X.predictions(spark, sf, deal=False))


@query
def score_aligned(spark, sf):
    whole, _ = scoring.whole_sentences(scoring.align(X.tokens(spark, sf, deal=False), X.predictions(spark, sf, deal=False)))
    return scoring.score(whole)


@query
def chunk_flags(spark, sf):
    return scoring.chunk_flags(X.pairs(spark, sf).select("doc_id", "sent_id", "tok_id", "gold", "guess"))


@query
def match_state(spark, sf):
    rows = scoring.match_state(X.pairs(spark, sf))
    return rows.select("doc_id", "sent_id", "tok_id", "state", "hit")


@query
def chunk_spans(spark, sf):
    return scoring.chunk_spans(X.tokens(spark, sf))


@query
def token_accuracy(spark, sf):
    return scoring.token_accuracy(X.pairs(spark, sf), ["source"])


@query
def chunk_counts(spark, sf):
    return scoring.chunk_counts(X.pairs(spark, sf))


@query
def correct_chunks(spark, sf):
    return scoring.correct_chunks(X.pairs(spark, sf))


@query
def score(spark, sf):
    return scoring.score(X.pairs(spark, sf))


@query
def score_by_corpus(spark, sf):
    return scoring.score(X.pairs(spark, sf), by=["source"])


# Mentions and statistics


def _mentions(spark, sf):
    return mentions.mentions(X.tokens(spark, sf))


@query
def mentions_(spark, sf):
    return _mentions(spark, sf)


QUERIES["mentions"] = QUERIES.pop("mentions_")


@query
def mentions_by_type(spark, sf):
    return mentions.by_type(_mentions(spark, sf), "pers")


@query
def faulty_labels(spark, sf):
    return mentions.faulty(X.tokens(spark, sf))


@query
def token_counts(spark, sf):
    return mentions.token_counts(X.tokens(spark, sf))


@query
def length_crosstab_tokens(spark, sf):
    return stats.length_crosstab(_mentions(spark, sf), "token", 8)


@query
def length_crosstab_chars(spark, sf):
    return stats.length_crosstab(_mentions(spark, sf), "character", 25)


@query
def length_hist_chars(spark, sf):
    return stats.length_histogram(_mentions(spark, sf), "character", 0, 35, 5)


@query
def length_hist_tokens(spark, sf):
    return stats.length_histogram(_mentions(spark, sf), "token", 0, 12, 2)


@query
def tag_dictionary(spark, sf):
    return stats.tag_dictionary(X.tokens(spark, sf))


@query
def corpus_summary(spark, sf):
    return stats.corpus_summary(X.tokens(spark, sf))


# Splits


@query
def plain_sentences(spark, sf):
    return splits.plain_text(X.tokens(spark, sf))


@query
def corpus_split(spark, sf):
    rows = splits.split(splits.plain_text(X.tokens(spark, sf)))
    return rows.select("doc_id", "sent_id", "rank", "split", "text")


@query
def train_shards(spark, sf):
    rows = splits.shard(splits.split(splits.plain_text(X.tokens(spark, sf))))
    return rows.select("doc_id", "sent_id", "rank", "split", "shard")


@query
def train_shards_equal(spark, sf):
    rows = splits.shard(splits.split(splits.plain_text(X.tokens(spark, sf))), equal=True)
    return rows.select("doc_id", "sent_id", "rank", "split", "shard")


@query
def union_corpora(spark, sf):
    p = X.pairs(spark, sf)
    both = {c: p.select("doc_id", "sent_id", "tok_id", "token", F.col(c).alias("iob")) for c in ("gold", "guess")}
    return corpora.union_corpora(both).groupBy("data_set", "iob").agg(F.count("*").alias("n"))


# Characters


@query
def char_inventory(spark, sf):
    return chars.char_inventory(X.table(spark, sf, "documents"))


@query
def char_coverage(spark, sf):
    vocab = chars.char_inventory(X.table(spark, sf, "benchmark"))
    return chars.char_coverage(X.table(spark, sf, "pages"), vocab, "html")


@query
def char_sequences(spark, sf):
    return chars.char_sequences(splits.plain_text(X.tokens(spark, sf)))


@query
def char_sequences_backward(spark, sf):
    return chars.char_sequences(splits.plain_text(X.tokens(spark, sf)), backward=True)


@query
def char_ids(spark, sf):
    vocab = chars.char_inventory(X.table(spark, sf, "benchmark"))
    pieces = chars.char_sequences(splits.plain_text(X.tokens(spark, sf)))
    return chars.char_ids(pieces, vocab, col="chars").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), " "))


# Whole jobs from files


@query
def files_to_statistics(spark, sf):
    tables = jobs.tokens_to_statistics(_written_columns(spark, sf))
    return tables["mentions"].groupBy("data_set", "type", "subtype").agg(
        F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.sum("n_characters").alias("characters")
    )


@query
def files_to_shards(spark, sf):
    """Ranks are by file name, so only the files' sizes can be known beforehand."""
    folder = new_folder(spark, "plain")
    columns.write_splits(jobs.tokens_to_shards(_written_columns(spark, sf)), folder)
    back = spark.read.text(folder)
    return back.groupBy("split", F.col("shard").cast("bigint").alias("shard")).agg(F.count("*").alias("n"))
