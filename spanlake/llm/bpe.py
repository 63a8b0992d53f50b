"""Byte-level BPE by a tree: halves are encoded, neighbours joined around their border.

A node holds a stretch of text and its ids, encoded as if it stood alone. Joining two
nodes re-encodes a window around the border and keeps the ids outside it. The window
grows until it begins and ends at a cut that no context can move:

* before a space that is followed by a non-space, or
* between a letter and an ASCII character that is no letter.

No alternative of the splitting pattern matches across either, and what it matches on
one side does not depend on the other, so the ids outside the window are those of the
whole text. A node's own edge ends a window too, which makes joining right (only slower)
for texts without such cuts. Decoding concatenates the bytes of ids up the same tree.

Texts up to ``LONG`` characters are trees within one row. Longer ones are cut into rows
of that size, encoded apart, and joined pairwise level by level.

Defined results: a null text is empty; rows are independent of each other, so repeated
ids and rows are kept; further columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from spanlake.llm.pieces import Memory, cached, rank_encoding, ranks
from spanlake.llm.shared import stored, tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF = 1 << 12
WINDOW = 32
LONG = 1 << 16

# Letters are given as ranges that no version of Unicode moves.
CUT = re.compile(
    r" (?=\S)|(?<=[A-Za-zÀ-ÖØ-öø-ɏぁ-ゖ一-龥가-힣])"
    r"(?=[\n!-@\[-`{-~])"
)


class Tree:
    """Encoding and decoding over one vocabulary; ids are little-endian 32-bit integers."""

    def __init__(self, name: str, leaf: int = LEAF, window: int = WINDOW) -> None:
        encoding = rank_encoding(name)
        self.leaf, self.window = leaf, window
        self.encode_leaf = cached(("tree", name), lambda: Memory(
            lambda texts: (np.array(encoding.encode_ordinary(t), "<u4").tobytes() for t in texts)
        ))
        table = cached(("bytes", name), lambda: {i: b for b, i in ranks(name).items()})
        self.table = table.__getitem__

    def encode(self, text: str) -> bytes:
        if len(text) <= self.leaf:
            return self.encode_leaf(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: bytes, right: str, right_ids: bytes) -> bytes:
        """Ids of ``left + right`` from the ids of both."""
        if not left or not right:
            return left_ids + right_ids
        begin, end = self.begin(left, right[0]), self.end(left[-1], right)
        tail, head = left[begin:], right[:end]
        keep = len(left_ids) - len(self.encode_leaf(tail))
        skip = len(self.encode_leaf(head))
        return left_ids[:keep] + self.encode_leaf(tail + head) + right_ids[skip:]

    def begin(self, left: str, after: str) -> int:
        """The last cut of ``left`` in a growing window; 0, its own edge, if there is none."""
        width = self.window
        while True:
            at = max(0, len(left) - width)
            # One character before the window and one after it are what a cut looks at.
            view = left[max(0, at - 1) :] + after
            shift = len(left) - (len(view) - 1)
            cuts = [m.start() + shift for m in CUT.finditer(view)]
            cuts = [c for c in cuts if at <= c < len(left) and c > 0]
            if cuts or at == 0:
                return cuts[-1] if cuts else 0
            width *= 2

    def end(self, before: str, right: str) -> int:
        """The first cut of ``right`` in a growing window, or its own edge."""
        width = self.window
        while True:
            view = before + right[: width + 1]
            for m in CUT.finditer(view):
                if 0 < m.start() - 1 <= width:
                    return m.start() - 1
            if width >= len(right):
                return len(right)
            width *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.table, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _rows(batch: pa.RecordBatch, ids: list[bytes], texts: list[bytes] | None, schema: pa.Schema) -> pa.RecordBatch:
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(ids), np.int32))
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), values).cast(pa.list_(pa.int32()))
    columns = [*batch.columns, lists] + ([pa.array(texts, pa.binary())] if texts is not None else [])
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _short(docs: DataFrame, name: str) -> DataFrame:
    schema = pa.schema([(c, pa.null()) for c in (*docs.columns, "ids", "decoded")])
    place = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [tree.encode(t or "") for t in part.column(place).to_pylist()]
                yield _rows(part, ids, [tree.decode(np.frombuffer(x, "<u4")) for x in ids], schema)

    return docs.mapInArrow(run, _with_results(docs))


def _with_results(docs: DataFrame) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return ", ".join([*fields, "ids array<int>", "decoded binary"])


def _long(docs: DataFrame, name: str, size: int) -> DataFrame:
    """Documents of several rows each, through the levels of the tree."""
    spark = docs.sparkSession
    # The row numbers are of the written rows, so they stay when a task is run again.
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "long-texts")
    n = F.ceil(F.length("text") / size)
    most = numbered.agg(F.max(n)).first()[0]
    if most is None:
        return _short(docs.limit(0), name)
    part = F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", (i * size + 1).cast("int"), size)))
    level = numbered.select("__row", part.alias("place", "text")).repartition("__row", "place")

    @tidy
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(name)
        for batch in batches:
            ids = [tree.encode(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=["__row", "place", "text", "ids"])

    node = "__row bigint, place int, text string, ids binary"
    level = level.mapInArrow(leaves, node)

    def root(table: pa.Table) -> tuple[int, str, bytes]:
        """The least place of a group, its text and the ids of the whole of it."""
        tree = Tree(name)
        rows = sorted(table.select(["place", "text", "ids"]).to_pylist(), key=lambda r: r["place"])
        text, ids = rows[0]["text"], rows[0]["ids"]
        for r in rows[1:]:
            ids = tree.join(text, ids, r["text"], r["ids"])
            text += r["text"]
        return rows[0]["place"], text, ids

    def joined(table: pa.Table) -> pa.Table:
        place, text, ids = root(table)
        return pa.table({
            "__row": table.column("__row").slice(0, 1), "place": pa.array([place // 2], pa.int32()),
            "text": [text], "ids": pa.array([ids], pa.binary()),
        })

    def lists(table: pa.Table) -> pa.Table:
        tree = Tree(name)
        schema = pa.schema([(c, pa.null()) for c in ("__row", "ids", "decoded")])
        ids = root(table)[2]
        batch = table.select(["__row"]).slice(0, 1).combine_chunks().to_batches()[0]
        return pa.Table.from_batches([_rows(batch, [ids], [tree.decode(np.frombuffer(ids, "<u4"))], schema)])

    while most > 2:
        level = level.groupBy("__row", F.expr("place div 2").cast("int").alias("pair")).applyInArrow(joined, node)
        most = (most + 1) // 2

    # The last level gives the lists itself. A step of its own behind it would take a second Python worker
    # in each task, and an executor keeps its workers, with all they remember, for the stages to come.
    roots = level.groupBy("__row").applyInArrow(lists, "__row bigint, ids array<int>, decoded binary")
    return numbered.join(roots, "__row").select(*docs.columns, "ids", "decoded")


def encode(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", long: int = LONG) -> DataFrame:
    """``docs`` plus ``ids array<int>`` and ``decoded binary``, the bytes of those ids."""
    docs = docs.select(*(c for c in docs.columns if c not in ("ids", "decoded")))
    short = F.coalesce(F.length("text"), F.lit(0)) <= long
    return _short(docs.where(short), name).unionByName(_long(docs.where(~short), name, long))
