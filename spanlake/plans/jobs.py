"""The four jobs of the corpus tool chain.

Each returns lazy DataFrames; nothing runs before an action or a write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from spanlake.functions.text import repair, token_shape
from spanlake.operators.fragments import assemble_sentences, fragments, markup_errors
from spanlake.operators.labels import Tagger, annotate, label_tokens, number_tokens, tokenize, trim_edges
from spanlake.operators.mentions import faulty, mentions, token_counts
from spanlake.operators.scoring import raw_tags, report_lines, score, token_accuracy
from spanlake.operators.splits import plain_text, shard, split
from spanlake.operators.stats import corpus_summary, length_crosstab, length_histogram, tag_dictionary
from spanlake.sources.annotated import prepare


DOCUMENT = ("corpus", "doc_id")


def document_keys(df: DataFrame) -> tuple[str, ...]:
    """The columns that tell documents apart: ``corpus`` counts where there is one."""
    return tuple(c for c in DOCUMENT if c in df.columns)


def _prepared(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return prepare(docs.select(*keys, "text")).withColumn("text", repair(F.col("text")))


def documents_to_tokens(
    docs: DataFrame, mode: str = "n", tokenizer=None, tagger: Tagger | None = None,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """``documents([corpus,] doc_id, text)`` to ``tokens(keys, sent_id, tok_id, token, iob, pos)``.

    Cleans and escapes the text, repairs its lines, extracts the annotations,
    assembles sentences and labels their tokens. One shuffle, by document; a tagger
    adds one by sentence. Without a tagger ``pos`` is the token's shape. The corpus, if
    there is one, is the tokens' ``data_set``.
    """
    keys = tuple(keys or document_keys(docs))
    sentences = assemble_sentences(fragments(_prepared(docs, keys), mode, keys), keys)
    # Fragments without tokens still separate sentences, but have none to label.
    numbered = number_tokens(trim_edges(tokenize(sentences, tokenizer=tokenizer)), (*keys, "sent_id"))
    tokens = label_tokens(numbered).select(*keys, "sent_id", "tok_id", "token", "iob")
    if tagger is None:
        tokens = tokens.withColumn("pos", token_shape(F.col("token")))
    else:
        tokens = annotate(tokens, tagger, (*keys, "sent_id"))
    return tokens.withColumnRenamed("corpus", "data_set")


def repaired_documents(docs: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The documents whose markup ``documents_to_tokens`` puts right, and what was wrong."""
    keys = tuple(keys or document_keys(docs))
    return markup_errors(_prepared(docs, keys), keys)


def sentence_keys(tokens: DataFrame) -> tuple[str, ...]:
    """The columns that tell sentences apart, of documents or of files that were read."""
    return tuple(c for c in ("data_set", "file", "doc_id", "sent_id") if c in tokens.columns)


def tokens_to_statistics(tokens: DataFrame, keys: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All summaries of a token table, by name; it needs a ``data_set`` column.

    They share the mention table: write it out or persist it if you want several.
    """
    keys = tuple(keys or sentence_keys(tokens))
    found = mentions(tokens, keys)
    return {
        "mentions": found,
        "faulty_labels": faulty(tokens),
        "token_counts": token_counts(tokens),
        "length_crosstab_tokens": length_crosstab(found, "token", 8),
        "length_crosstab_chars": length_crosstab(found, "character", 25),
        "length_hist_tokens": length_histogram(found, "token", 0, 12, 2),
        "length_hist_chars": length_histogram(found, "character", 0, 35, 5),
        "tag_dictionary": tag_dictionary(tokens),
        "corpus_summary": corpus_summary(tokens, keys=[k for k in keys if k != "data_set"]),
    }


def pairs_to_report(
    pairs: DataFrame,
    style: str = "text",
    raw: bool = False,
    outside: str = "O",
    keys: Sequence[str] = ("doc_id", "sent_id"),
) -> DataFrame:
    """The printed score report. ``outside`` only matters for ``raw`` tags."""
    tagged = raw_tags(pairs, outside) if raw else pairs
    scores = score(tagged, keys=keys)
    return report_lines(scores, token_accuracy(tagged) if style == "text" else None, style)


def tokens_to_shards(
    tokens: DataFrame, seed: int = 42, train: float = 0.8, shards: int = 100, equal: bool = False,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Shuffled plain sentences with ``split`` and ``shard``, ready to write.

    As an array of one a sentence's text is made with its row: the ranks, which need the keys alone, then
    read the exchange of the texts, and tokens are made, or read from their files, once.
    """
    keys = tuple(keys or sentence_keys(tokens))
    sentences = plain_text(tokens, keys).select(*keys, F.inline(F.array(F.struct("text"))))
    return shard(split(sentences, seed, train, keys), shards, equal)
