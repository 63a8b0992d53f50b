"""Stupid-backoff scores of every document under an n-gram model of all other documents.

    S(w | h) = c(h w) / c(h)            where h w occurs elsewhere, h the ``ORDER`` - 1 words before
             = 0.4 * S(w | shorter h)   otherwise
    S(w)     = c(w) / N                 where w occurs elsewhere
             = 0.4 / N                  otherwise

c and N count every occurrence in the corpus but those in the document itself (a document
would else know each of its own n-grams, and junk score like common text). The first words of
a document have the shorter histories that are there. Words are ``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased; all words and all counts from 1 are used. Rows are documents, so a copy is
"elsewhere".

* Documents are taken in blocks of about ``BLOCK`` bytes of text and dealt out by block, each as its
  different words and the order they stand in; all that follows reads this one exchange.
* The n-grams of a block are counted by 64-bit hash, one order after the other, dealt to
  buckets by ranges of the hash, and packed (differences of sorted keys, counts; byte planes
  under zstandard). A bucket's rows come together, which gives its count table, and each block
  gets the counts of its n-grams back, in their order. An n-gram of every document is one key
  a block.
* A block's counts meet its words; a document's own occurrences are taken off, words whose
  n-gram is left with none back off, and the logarithms are summed by document.

Nothing is broadcast; the driver gets the number of words. Blocks are cut in the order in which a
task reads its rows, so ``docs`` has to give them in that order again should a task be run anew, as
a scan of files does; write out anything else first. Hashes of different n-grams are
taken for different (with 5 * 10**9 of them, less than one collision is expected).

Defined results: a null text is empty; a document without words has 0 words, a sum of 0
and a null mean; in a corpus of one document N is 1; rows with equal ids are scored apart;
further columns are not looked at; an empty table gives no rows. A block holds one document
at least, which has to fit in a worker.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from spanlake.llm.shared import hashed_words, mix, packed, slices, space_words, summed, unpacked, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 3
BACKOFF = 0.4
BUCKETS, BUCKET_WORDS = 256, 2_000_000
BLOCK = 1 << 24  # bytes of text of a block
BLOCKS = "block bigint, ids binary, sizes binary, words binary, places binary"
GRAMS = "block bigint, part int, bucket int, keys binary, counts binary"
COUNTED = "block bigint, part int, bucket int, counts binary"


def schema_of(names: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in names.split(", "))])


def total_words(docs: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for at, to in slices(batch.column(0)):
                n += len(space_words(*utf8(batch.column(0).slice(at, to - at)))[0])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return docs.select("text").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def blocks(docs: DataFrame) -> DataFrame:
    """``BLOCKS``: ids and sizes of a block's documents, hashes of its words, frequent ones first,
    and the place of each document's words among them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = schema_of(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0  # 2**24 blocks a task
        ids, sizes, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, sizes, parts, held
            joined, parts = np.concatenate(parts), []
            words, place, times = np.unique(joined, return_inverse=True, return_counts=True)
            del joined
            falling = np.argsort(-times, kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[falling] = np.arange(len(words), dtype=np.int32)
            table = pa.Table.from_arrays([pa.chunked_array(ids)], names=["doc_id"]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            row = {
                "block": task << 24 | number, "ids": sink.getvalue().to_pybytes(),
                "sizes": packed(np.concatenate(sizes)), "words": packed(words[falling]), "places": packed(rank[place]),
            }
            number += 1
            ids, sizes, parts, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                words, bounds = hashed_words(part.column(1))
                parts.append(words)
                ids.append(part.column(0))
                sizes.append(np.diff(bounds).astype(np.int64))
                held += part.num_rows + len(words) * 6
                if held >= BLOCK:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast(kind), "text").mapInArrow(run, BLOCKS)


def grams(words: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``order`` the places at which an n-gram of a document ends, and its key."""
    room = np.repeat(np.cumsum(sizes).astype(np.int32), sizes)  # words from each on to its document's end
    room -= np.arange(len(words), dtype=np.int32)
    keys = words
    for n in range(1, order + 1):
        inside = room >= n
        yield np.flatnonzero(inside).astype(np.int32) + np.int32(n - 1), keys[inside]
        del inside
        if n < order:  # the last ones reach beyond their document and are left out above
            keys = keys * (mix(np.array([n], np.uint64)) | np.uint64(1))
            keys[: max(0, len(words) - n)] += words[n:]
            keys = mix(keys)


def packed_grams(made: DataFrame, order: int, buckets: int) -> DataFrame:
    """``GRAMS``: by block, order and bucket the different n-grams and how often the block has them."""
    schema = schema_of(GRAMS)
    least = np.array([-(-(b << 32) // buckets) << 32 for b in range(buckets)], np.uint64)  # key of each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, sizes, words, places in zip(*batch.columns):
                words = unpacked(words.as_py(), np.uint64)[unpacked(places.as_py(), np.int32)]
                for part, (_, key) in enumerate(grams(words, unpacked(sizes.as_py(), np.int64), order)):
                    key.sort()
                    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
                    times = np.diff(np.append(head, len(key)))
                    key = key[head]
                    del head
                    cuts = np.append(np.searchsorted(key, least), len(key))
                    out = []
                    for b in np.flatnonzero(np.diff(cuts)).tolist():
                        a, z = cuts[b], cuts[b + 1]
                        steps = np.concatenate([key[a : a + 1], np.diff(key[a:z])])
                        out.append({"block": block.as_py(), "part": part, "bucket": b, "keys": packed(steps), "counts": packed(times[a:z])})
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return made.mapInArrow(run, GRAMS)  # of all columns: pruned, it would not share the exchange


def counted(made: DataFrame) -> DataFrame:
    """``COUNTED``: the corpus counts of the n-grams of each row of ``GRAMS``, in their order."""
    schema = schema_of(COUNTED)

    def run(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in group.column("keys")]
        counts = np.concatenate([unpacked(x.as_py(), np.int64) for x in group.column("counts")])
        known, total = summed(np.concatenate(keys), counts)
        found = [packed(total[np.searchsorted(known, key)]) for key in keys]
        return pa.Table.from_arrays(
            [group.column("block"), group.column("part"), group.column("bucket"), pa.array(found, pa.binary())], schema=schema
        )

    return made.groupBy("part", "bucket").applyInArrow(run, COUNTED)


def elsewhere(key: np.ndarray, row: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs outside its own document; ``counts`` are those of the
    different keys in ascending order, rows ascend."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    del key
    left = counts[np.cumsum(new, dtype=np.int32) - np.int32(1)] if len(new) else np.zeros(0, np.int64)
    row = row[order]
    new[1:] |= row[1:] != row[:-1]
    del row
    own = np.diff(np.append(np.flatnonzero(new), len(new)))
    left -= np.repeat(own, own)
    out = np.empty(len(new), np.int64)
    out[order] = left
    return out


def score(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, log_score, mean_log_score)`` of every document."""
    total = total_words(docs)
    made = blocks(docs).repartition("block")
    buckets = max(buckets, -(-total // BUCKET_WORDS))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, block: pa.Table, counts: pa.Table) -> pa.Table:
        with pa.ipc.open_stream(block.column("ids")[0].as_py()) as reader:
            table = reader.read_all()
        sizes = unpacked(block.column("sizes")[0].as_py(), np.int64)
        words = unpacked(block.column("words")[0].as_py(), np.uint64)[unpacked(block.column("places")[0].as_py(), np.int32)]
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rest = np.maximum(total - sizes, 1)
        part, bucket = counts.column("part").to_numpy(), counts.column("bucket").to_numpy()
        # What is held of each word is kept small, as two blocks are worked on beside the JVM's heap.
        n_words = len(words)
        logs, backed, before = np.zeros(n_words), np.full(n_words, -1, np.int8), None
        deepest = np.zeros(n_words, np.int8)
        made = grams(words, sizes, order)
        del words
        for n, (end, keys) in enumerate(made):
            mine = np.flatnonzero(part == n)
            mine = mine[np.argsort(bucket[mine])]
            known = [unpacked(counts.column("counts")[int(i)].as_py(), np.int64) for i in mine]
            known = np.concatenate([np.zeros(0, np.int64), *known])
            here = np.zeros(n_words, np.int64)
            here[end] = elsewhere(keys, row[end], known)
            deepest[end] = n
            del keys, known, end
            some = np.flatnonzero(here)
            above = rest[row[some]] if before is None else before[some - 1]
            logs[some] = np.log(here[some] / above)
            backed[some] = n
            before = here
            del some, above, here
        none = backed < 0  # a word that no other document has
        logs[none] = -np.log(rest[row[none]])
        logs += np.log(BACKOFF) * (deepest - backed)
        return pa.Table.from_arrays(
            [table.column("doc_id"), pa.array(sizes), pa.array(np.bincount(row, logs, len(sizes)))], names=["doc_id", "n_words", "log_score"]
        )

    found = counted(packed_grams(made, order, buckets))
    scored = made.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, f"doc_id {kind}, n_words bigint, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.withColumn("mean_log_score", mean)
