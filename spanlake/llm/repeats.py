"""Removal of repeated byte strings: ranks of sampled positions, in three fixed steps (no prefix doubling).

Every start of a string of ``LENGTH`` bytes belongs to the smallest hash of 16 bytes in the
256 places from it on, its anchor. Equal strings have their anchor at the same offset, so
it is enough to rank anchors, about one in 90 bytes:

1. Anchors are ranked by the 145 bytes that all strings of an anchor share. Those with a
   rank of their own are done: none of their strings occurs elsewhere.
2. The rest are ranked again by the pair of that rank and all the bytes that their own
   strings cover (401 to 655). Where a pair occurs again, all of the anchor's strings do.
   Only one anchor of each such class goes on, and none if its first rank has one class.
3. What is left, the edges of repeats, is ranked by the full 400 bytes at each of its
   places, within the first rank; a place with a rank of its own is no repeat.

So ranks are refined at growing lengths until they are unique or past the threshold.
Ranks are 64-bit hashes of the bytes, each used within the rank before it. Copies are
counted in each task before the shuffle; the join that hands ranks back can be split by
adaptive execution; a first rank with more than ``HOT`` classes is dealt out by the hash
of each place's 400 bytes instead of in one group. Texts meet the result once, by the
same exchange that cut out the edges.

Defined results: a null text is empty; texts under 400 bytes stay whole, strings never
cross documents; rows that are equal in id and text are documents of their own, and so
copies of each other; further columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from spanlake.llm.shared import UNBASE, byte_values, mix, powers, slices, tidy, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 400
GRAM = 16
HOT = 10_000
EDGE_BYTES = 1 << 20  # of one batch of edges
HELD = 500_000  # anchors that a task holds before it sums them up
SETTLED, EDGE, SPLIT = 1, 2, 4


def window_of(length: int) -> int:
    """Places that an anchor is chosen from; they and the last one's bytes fit in a string."""
    return max(1, min(length - GRAM + 1, (length * 16) // 25))


def leftmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each place the leftmost place of the minimum of the w values from it on."""
    n = len(h)
    size = -(-n // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks, places = padded.reshape(-1, w), np.arange(size).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1)
    new = np.ones(blocks.shape, bool)
    new[:, 1:] = blocks[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, places, 0), axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)
    new = np.ones(blocks.shape, bool)
    new[:, 1:] = blocks[:, ::-1][:, 1:] <= back[:, :-1]
    back_at = np.minimum.accumulate(np.where(new, places[:, ::-1], size), axis=1)[:, ::-1].reshape(-1)
    back, ahead, k = back[:, ::-1].reshape(-1), ahead.reshape(-1), n - w + 1
    return np.where(back[:k] <= ahead[w - 1 : w - 1 + k], back_at[:k], ahead_at[w - 1 : w - 1 + k])


class Hashes:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_values()[data] * powers(len(data)), out=self.sums[1:])
        self.back = powers(len(data) + 1, UNBASE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, place in the buffer, first and last start of each anchor; first rank and class."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    w, gram = window_of(length), min(GRAM, length)
    hashes = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    chosen = leftmost_minima(hashes.of(at, at + gram), w)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(data)) + length <= offsets[1:][row])
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    chosen = chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    first, last = starts[head], starts[np.concatenate([head[1:], [len(starts)]]) - 1]
    place = chosen[head]
    rank = hashes.of(place, place + length - w + 1)
    reach = ((place - first) << 16 | (place - last)).astype(np.uint64)
    return row[first], place, first, last, rank, mix(hashes.of(first, last + length) + mix(reach))


def _keyed(docs: DataFrame) -> DataFrame:
    """Two keys that are equal for rows of equal id and text only, never null."""
    return docs.select(
        F.xxhash64("doc_id", "text").alias("one"), F.xxhash64("text", F.lit(1), "doc_id").alias("two"),
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
    )


def _found(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[dict[str, np.ndarray]]:
    """The anchors of each slice of ``(one, two, text)``."""
    for batch in batches:
        for at, to in slices(batch.column(2)):
            part = batch.slice(at, to - at)
            data, offsets = utf8(part.column(2))
            row, place, first, last, rank, kind = anchors(data, offsets, length)
            one, two = (part.column(i).to_numpy()[row] for i in (0, 1))
            spot = (place - offsets[row]) << 32 | (place - first) << 16 | (place - last)
            yield {"one": one, "two": two, "spot": spot, "rank": rank.view(np.int64), "kind": kind.view(np.int64)}


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _found(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in found.values()], names=list(found))

    return keyed.select("one", "two", "text").mapInArrow(run, "one bigint, two bigint, spot bigint, rank bigint, kind bigint")


def _counted_here(keyed: DataFrame, length: int) -> DataFrame:
    """``(rank, kind, n)`` of the anchors and the least one ``(one, two, spot)``, summed over what a
    task holds, half a million at a time.

    Texts are read and summed in one function: each Python step of a task takes a worker of its own.
    """
    names = ("rank", "kind", "one", "two", "spot")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            values = np.concatenate(held, axis=1)
            order = np.lexsort(values[4::-1])
            values = values[:, order]
            new = np.ones(values.shape[1], bool)
            new[1:] = (values[:2, 1:] != values[:2, :-1]).any(axis=0)
            head = np.flatnonzero(new)
            n = np.diff(np.concatenate([head, [values.shape[1]]]))
            return pa.RecordBatch.from_arrays(
                [pa.array(values[0, head]), pa.array(values[1, head]), pa.array(n), *(pa.array(v) for v in values[2:, head])],
                names=["rank", "kind", "n", "one", "two", "spot"],
            )

        for found in _found(batches, length):
            if len(found["rank"]):
                held.append(np.stack([found[name] for name in names]))
            if sum(h.shape[1] for h in held) > HELD:
                yield summed()
                held = []
        if held:
            yield summed()

    return keyed.select("one", "two", "text").mapInArrow(
        run, "rank bigint, kind bigint, n bigint, one bigint, two bigint, spot bigint"
    )


def _edges(texts: DataFrame, length: int) -> DataFrame:
    """The bytes that the strings of each edge anchor cover, by the rank they are compared in."""
    w = window_of(length)
    names = ["rank", "one", "two", "start", "alone", "bytes"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                text = np.frombuffer(batch.column(2)[at].as_buffer() or b"", np.uint8)
                marks = batch.column(3)[at].values
                flag = marks.field("flag").to_numpy()
                edge = (flag & EDGE) > 0
                if not edge.any():
                    continue
                spot, flag = marks.field("spot").to_numpy()[edge], flag[edge]
                place = spot >> 32
                first, last = place - (spot >> 16 & 0xFFFF), place - (spot & 0xFFFF)
                hashes = Hashes(text)
                rank = hashes.of(place, place + length - w + 1)
                one, two = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                out, held = [], 0
                for r, a, b, f in zip(rank.view(np.int64).tolist(), first.tolist(), last.tolist(), flag.tolist()):
                    parts = [(r, a, b)]
                    if f & SPLIT:  # each place in a group of its own bytes
                        each = np.arange(a, b + 1)
                        own = hashes.of(each, each + length).view(np.int64).tolist()
                        parts = zip(own, each.tolist(), each.tolist())
                    for r, a, b in parts:
                        out.append((r, one, two, a, not f & SETTLED, text[a : b + length].tobytes()))
                        held += b + length - a
                    if held > EDGE_BYTES:
                        yield batch_of(out)
                        out, held = [], 0
                if out:
                    yield batch_of(out)

    return texts.select("one", "two", "text", "marks").mapInArrow(
        run, "rank bigint, one bigint, two bigint, start int, alone boolean, bytes binary"
    )


def _repeated_edges(edges: DataFrame, length: int) -> DataFrame:
    """``(one, two, first, last)``: ranges of starts of edge anchors whose strings occur again."""

    def ranked(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_bytes(batch.column("bytes"))
        hashes = Hashes(data)
        n = np.diff(offsets) - length + 1
        row = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[:-1][row] + start
        key = hashes.of(at, at + length) + mix(batch.column("rank").to_numpy().view(np.uint64))[row]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        again &= batch.column("alone").to_numpy(zero_copy_only=False)[row]
        found = np.flatnonzero(again)
        if not len(found):
            return pa.RecordBatch.from_pylist([], schema=pa.schema([("one", pa.int64()), ("two", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
        begin = np.ones(len(found), bool)
        begin[1:] = (np.diff(found) > 1) | (np.diff(row[found]) > 0)
        head = np.flatnonzero(begin)
        tail = np.concatenate([head[1:], [len(found)]]) - 1
        rows = row[found[head]]
        base = batch.column("start").to_numpy()[rows]
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays([
            batch.column("one").take(take), batch.column("two").take(take),
            pa.array((base + start[found[head]]).astype(np.int32)), pa.array((base + start[found[tail]]).astype(np.int32)),
        ], names=["one", "two", "first", "last"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # sorted by rank; its last rank may go on
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                held.append(batch.slice(at, 2048))
                rank = held[-1].column(0).to_numpy()
                cut = np.flatnonzero(rank[1:] != rank[:-1])
                if len(cut):
                    end = int(cut[-1]) + 1
                    yield ranked(joined([*held[:-1], held[-1].slice(0, end)]))
                    held = [held[-1].slice(end)]
        if held:
            yield ranked(joined(held))

    dealt = edges.repartition("rank").sortWithinPartitions("rank")
    return dealt.mapInArrow(run, "one bigint, two bigint, first int, last int")


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _without(texts: DataFrame, length: int, kind: str) -> DataFrame:
    """Texts without the bytes of their repeated strings."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, to - at) for b in batches for at, to in slices(b.column(1))):
            size, removed, spans, kept = [], [], [], []
            for text, marks, more in zip(part.column(1), part.column(2), part.column(3)):
                data = np.frombuffer(text.as_buffer() or b"", np.uint8)
                step = np.zeros(len(data) + 1, np.int32)
                if marks.is_valid:
                    flag = marks.values.field("flag").to_numpy()
                    spot = marks.values.field("spot").to_numpy()[(flag & SETTLED) > 0]
                    place = spot >> 32
                    np.add.at(step, place - (spot >> 16 & 0xFFFF), 1)
                    np.add.at(step, place - (spot & 0xFFFF) + length, -1)
                if more.is_valid:
                    np.add.at(step, more.values.field("first").to_numpy(), 1)
                    np.add.at(step, more.values.field("last").to_numpy() + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                size.append(len(data))
                removed.append(int(gone.sum()))
                spans.append([{"start": a, "end": b} for a, b in edge.tolist()])
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary()),
            ], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return texts.select("doc_id", "text", "marks", "more").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept)``: byte ranges removed, bytes that stay."""
    keyed = _keyed(docs)
    rows = _anchor_rows(keyed, length)
    by_rank = Window.partitionBy("rank")
    classes = (
        _counted_here(keyed, length).repartition("rank").groupBy("rank", "kind")
        .agg(F.sum("n").alias("n"), F.min(F.struct("one", "two", "spot")).alias("chosen"))
        .withColumn("kinds", F.count("*").over(by_rank))
        .where("n > 1 OR kinds > 1")
    )
    marked = rows.join(classes, ["rank", "kind"]).select(
        "one", "two", "spot",
        (
            F.when(F.col("n") > 1, SETTLED).otherwise(0)
            + F.when((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.struct("one", "two", "spot") == F.col("chosen"))), EDGE).otherwise(0)
            + F.when(F.col("kinds") > hot, SPLIT).otherwise(0)
        ).cast("tinyint").alias("flag"),
    )
    # Rows of equal id and text would meet each other's marks twice: a set, not a list.
    marks = marked.groupBy("one", "two").agg(F.collect_set(F.struct("spot", "flag")).alias("marks"))
    met = keyed.join(marks, ["one", "two"])
    edges = _edges(met, length)
    more = _repeated_edges(edges, length).groupBy("one", "two").agg(
        F.collect_set(F.struct("first", "last")).alias("more")
    )
    texts = keyed.join(marks, ["one", "two"], "left").join(more, ["one", "two"], "left")
    return _without(texts, length, docs.schema["doc_id"].dataType.simpleString())
