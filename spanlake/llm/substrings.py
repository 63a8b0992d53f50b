"""Removal of passages that begin in a document with a smaller id: seed and extend.

A window is ``LENGTH`` consecutive words. A word goes if one of the windows over it stands
in a document with a smaller id too; windows are judged on the input.

1. **Winnowed anchors.** Of the places of a window from which 8 words are hashed, the
   leftmost one with the smallest hash is its anchor. Equal windows choose equal anchors at
   the same offset. The words from the anchor on that all its windows share are its seed.
2. **Join on seeds.** Seeds in documents of one id only are left out. The anchor in the
   smallest id is the seed's reference. An anchor whose whole reach (all the words that its
   windows cover) equals the reference's is settled.
3. **Extend.** Where reaches differ, the reference's words are laid beside each other anchor's
   and compared outwards on both sides. Windows within the stretch that agrees are in the
   reference's document; the stretch is the maximal repeat of the two at this anchor.
4. **The rest.** A window that the reference lacks can only stand at anchors that left the
   reference at the same word. These windows go on by their own hash, and the smallest id
   of each is joined back.
5. Overlapping and touching stretches of a document are united over its anchors, and the
   words in them removed.

No step makes pairs of a group: each anchor meets one reference. References of seeds with
more than ``HOT`` anchors are sent several times, so that no task holds the group; minima are
taken before the shuffle and written, so that both sides of the joins that hand them back are
plain exchanges, whose hot keys adaptive execution splits. Words, seeds
and windows are compared by 64-bit hashes. Nothing is broadcast.

Defined results: a null text has no words; a null id counts as larger than any other, and
such rows do not clear each other; rows of one id never do either, so repeated rows lose and
keep the same; texts of fewer words than a window stay whole; further columns are not looked
at; an empty table gives no rows. A document has to fit in a worker.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from spanlake.llm.repeats import leftmost_minima
from spanlake.llm.shared import UNBASE, mix, powers, segment_hashes, slices, space_words, stored, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 50
GRAM = 8
HOT = 1_000
NO_ID = (1 << 63) - 1  # rank of a null id
SENT_BYTES = 1 << 23  # of one batch of reaches
GONE, REACH, REFERENCE, PAIR = 1, 2, 4, 8

ANCHORS = "one bigint, two bigint, id bigint, spot bigint, seed bigint, kind bigint"
REACHES = "seed bigint, salt int, reference boolean, pair boolean, id bigint, one bigint, two bigint, spot bigint, words binary"
RANGES = "window bigint, id bigint, one bigint, two bigint, first int, last int"


def anchor_places(length: int) -> tuple[int, int]:
    """Words hashed at a place, and the places of a window that its anchor is chosen from."""
    gram = min(GRAM, length)
    return gram, max(1, min(length - gram + 1, (length * 16) // 25))


class Spans:
    """Hashes of ranges of a sequence of word hashes."""

    def __init__(self, words: np.ndarray) -> None:
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(len(words)), out=self.sums[1:])
        self.back = powers(len(words) + 1, UNBASE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, and the rows' bounds."""
    data, offsets = utf8(texts)
    starts, ends, bounds = space_words(data, offsets)
    return segment_hashes(data, starts, ends), bounds


def anchors(words: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, place, first and last window start (all from the first word) of each anchor; its
    seed and the hash of its reach."""
    gram, w = anchor_places(length)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(np.arange(len(words)) + length <= bounds[1:][row])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    spans = Spans(words)
    at = np.arange(len(words) - gram + 1)
    chosen = leftmost_minima(spans.of(at, at + gram), w)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    first, last = starts[head], starts[np.append(head[1:], len(starts)) - 1]
    place = chosen[head]
    reach = ((place - first) << 16 | (place - last)).astype(np.uint64)
    return row[first], place, first, last, spans.of(place, place + length - w + 1), mix(spans.of(first, last + length) + mix(reach))


def keyed(docs: DataFrame) -> DataFrame:
    """Two keys that are equal for rows of equal id and text only, and the rank of the id."""
    return docs.select(
        F.xxhash64("doc_id", "text").alias("one"), F.xxhash64("text", F.lit(1), "doc_id").alias("two"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), "doc_id", "text",
    )


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(3)):
                part = batch.slice(at, to - at)
                words, bounds = word_hashes(part.column(3))
                row, place, first, last, seed, kind = anchors(words, bounds, length)
                spot = (place - bounds[row]) << 32 | (place - first) << 16 | (place - last)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).take(pa.array(row)) for i in range(3)),
                     pa.array(spot), pa.array(seed.view(np.int64)), pa.array(kind.view(np.int64))],
                    names=["one", "two", "id", "spot", "seed", "kind"],
                )

    return docs.select("one", "two", "id", "text").mapInArrow(run, ANCHORS)


def shared_anchors(rows: DataFrame, hot: int) -> DataFrame:
    """Anchors of seeds that stand under several ids, with what is to be done with each."""
    seeds = stored(rows.groupBy("seed").agg(
        F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"),
        F.min("kind").alias("kind_a"), F.max("kind").alias("kind_z"),
    ).where("least < most"), "shared-seeds")
    several = F.col("kind_a") < F.col("kind_z")
    shared = stored(rows.join(seeds, "seed").select(
        "one", "two", "id", "spot", "seed", "kind", "least", "n", several.alias("several"),
    ), "shared-anchors")
    # One kind: no reference is needed. The smallest struct is found without the whole group.
    references = stored(shared.where("several AND id = least").groupBy("seed").agg(
        F.min(F.struct("kind", "one", "two", "spot")).alias("ref")
    ), "seed-references")
    mine = F.struct("kind", "one", "two", "spot")
    same = ~F.col("several") | (F.col("kind") == F.col("ref.kind"))
    flag = (
        F.when(same & (F.col("id") > F.col("least")), GONE).otherwise(0)
        + F.when(~same, REACH).otherwise(0)
        + F.when(F.col("several") & (mine == F.col("ref")), REFERENCE).otherwise(0)
        + F.when(F.col("n") == 2, PAIR).otherwise(0)
    ).cast("tinyint")
    salts = F.ceil(F.col("n") / hot).cast("int")
    return shared.join(references, "seed", "left").select("one", "two", "spot", flag.alias("flag"), salts.alias("salts")).where(
        F.col("flag").bitwiseAND(F.lit(GONE | REACH | REFERENCE)) > 0
    )


def reaches(texts: DataFrame, length: int) -> DataFrame:
    """The words that the windows of each marked anchor cover, laid out from the anchor.

    ``words`` holds 64-bit hashes, as many places to the left as an anchor can have, then
    ``length`` to the right; 0 where the reach ends.
    """
    _, w = anchor_places(length)
    names = [x.split(" ")[0] for x in REACHES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    width = w - 1 + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                marks = batch.column(4)[i].values
                flag = marks.field("flag").to_numpy()
                some = (flag & (REACH | REFERENCE)) > 0
                if not some.any():
                    continue
                words, _ = word_hashes(batch.column(3).slice(i, 1))
                spans = Spans(words)
                spot, flag, salts = marks.field("spot").to_numpy()[some], flag[some], marks.field("salts").to_numpy()[some]
                # A reference goes to every salt of its seed, the others to one.
                times = np.where(flag & REFERENCE, salts, 1)
                one, two, rank = (batch.column(k)[i].as_py() for k in range(3))
                salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                spot, flag, salts = (np.repeat(x, times) for x in (spot, flag, salts))
                reference = (flag & REFERENCE) > 0
                salt = np.where(reference, salt, (one ^ spot) % salts)
                place = spot >> 32
                first, last = place - (spot >> 16 & 0xFFFF), place - (spot & 0xFFFF)
                seed = spans.of(place, place + length - w + 1).view(np.int64)
                step = max(1, SENT_BYTES // (8 * width))
                for a in range(0, len(spot), step):
                    z = slice(a, a + step)
                    at = place[z, None] - (w - 1) + np.arange(width)
                    inside = (at >= first[z, None]) & (at < last[z, None] + length)
                    laid = np.where(inside, words[np.clip(at, 0, len(words) - 1)], np.uint64(0))
                    n = len(laid)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(c, k) for c, k in zip((
                            seed[z], salt[z], reference[z], (flag[z] & PAIR) > 0, np.full(n, rank), np.full(n, one), np.full(n, two),
                            spot[z], [r.tobytes() for r in laid],
                        ), kinds)
                    ], names=names)

    return texts.select("one", "two", "id", "text", "marks").mapInArrow(run, REACHES)


def extended(sent: DataFrame, length: int) -> DataFrame:
    """Window starts of each anchor that lie in its reference's document (``window`` null), and
    the windows beyond, one a row, by their hash."""
    _, w = anchor_places(length)
    width = w - 1 + length
    names = [x.split(" ")[0] for x in RANGES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last reference seen: its words and the rank of its id
        back, forth = powers(w, UNBASE)[::-1], powers(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                reference = batch.column(2).to_numpy(zero_copy_only=False)
                words = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(-1, width)
                ids, spot = batch.column(4).to_numpy(), batch.column(7).to_numpy()
                if held is not None:
                    words, ids = np.vstack([held[0], words]), np.append(held[1], ids)
                    reference, spot = np.append(True, reference), np.append(0, spot)
                skip = len(ids) - batch.num_rows
                upon = np.maximum.accumulate(np.where(reference, np.arange(len(ids)), -1))
                held = words[upon[-1]][None], ids[upon[-1]]
                here = np.flatnonzero(~reference)
                if not len(here):
                    continue
                mine, other = words[here], words[upon[here]]
                equal = (mine == other) & (mine != 0)
                left = np.logical_and.accumulate(equal[:, : w - 1][:, ::-1], axis=1).sum(axis=1)
                right = np.logical_and.accumulate(equal[:, w - 1 :], axis=1).sum(axis=1)
                place, most, least = spot[here] >> 32, spot[here] >> 16 & 0xFFFF, spot[here] & 0xFFFF
                # Offsets of the anchor in windows that the reference has as well.
                lo, hi = np.maximum(least, length - right), np.minimum(most, left)
                found = lo <= hi
                rows = here - skip
                one, two = batch.column(5), batch.column(6)
                taken = found & (ids[here] > ids[upon[here]])
                k = pa.array(rows[taken])
                out = [(
                    pa.nulls(len(k), pa.int64()), pa.array(ids[here][taken]), one.take(k), two.take(k),
                    pa.array((place - hi)[taken].astype(np.int32)), pa.array((place - lo)[taken].astype(np.int32)),
                )]
                # With two anchors under a seed nobody else can have the other windows.
                pair = batch.column(3).to_numpy(zero_copy_only=False)[rows]
                offset = np.arange(w)
                rest = (offset >= least[:, None]) & (offset <= most[:, None]) & ~pair[:, None]
                rest &= ~(found[:, None] & (offset >= lo[:, None]) & (offset <= hi[:, None]))
                r, o = np.nonzero(rest)
                if len(r):
                    sums = np.zeros((len(mine), width + 1), np.uint64)
                    np.cumsum(mine * forth, axis=1, out=sums[:, 1:])
                    begin = w - 1 - o
                    window = mix((sums[r, begin + length] - sums[r, begin]) * back[o])
                    k, start = pa.array(rows[r]), pa.array((place[r] - o).astype(np.int32))
                    out.append((pa.array(window.view(np.int64)), pa.array(ids[here][r]), one.take(k), two.take(k), start, start))
                for arrays in out:
                    yield pa.RecordBatch.from_arrays(list(arrays), names=names)

    dealt = sent.repartition("seed", "salt").sortWithinPartitions("seed", "salt", F.desc("reference"))
    return dealt.mapInArrow(run, RANGES)


def ranges(sent: DataFrame, length: int) -> DataFrame:
    """``(one, two, more)``: ranges of window starts that stand in documents with smaller ids."""
    rows = stored(extended(sent, length), "extended")
    rest = rows.where("window IS NOT NULL")
    least = stored(
        rest.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most"), "shared-windows"
    )
    again = rest.join(least, "window").where("id > least").select("one", "two", "first", "last")
    found = rows.where("window IS NULL").select("one", "two", "first", "last").unionByName(again)
    return found.groupBy("one", "two").agg(F.collect_set(F.struct("first", "last")).alias("more"))


def without(texts: DataFrame, length: int, kind: str) -> DataFrame:
    """Texts without the words under marked windows, joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                data, offsets = utf8(batch.column(1).slice(i, 1))
                starts, ends, _ = space_words(data, offsets)
                step = np.zeros(len(starts) + 1, np.int64)
                marks, more = batch.column(2)[i], batch.column(3)[i]
                if marks.is_valid:
                    flag = marks.values.field("flag").to_numpy()
                    spot = marks.values.field("spot").to_numpy()[(flag & GONE) > 0]
                    np.add.at(step, (spot >> 32) - (spot >> 16 & 0xFFFF), 1)
                    np.add.at(step, (spot >> 32) - (spot & 0xFFFF) + length, -1)
                if more.is_valid:
                    np.add.at(step, more.values.field("first").to_numpy(), 1)
                    np.add.at(step, more.values.field("last").to_numpy() + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                size.append(len(starts))
                removed.append(int(gone.sum()))
                spans.append([{"start": a, "end": b} for a, b in edge.tolist()])
                raw = data.tobytes()
                words = raw.split()  # bytes are split at just the six characters that words lack
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if len(edge) else b" ".join(words))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return texts.select("doc_id", "text", "marks", "more").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string"
    )


def remove_substrings(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_words, n_removed, spans, kept)``: ranges of words removed, text that stays."""
    texts = keyed(docs.select("doc_id", "text"))
    marks = stored(
        shared_anchors(anchor_rows(texts, length), hot).groupBy("one", "two")
        .agg(F.collect_set(F.struct("spot", "flag", "salts")).alias("marks")),
        "anchor-marks",
    )
    wanted: Column = F.exists("marks", lambda m: m["flag"].bitwiseAND(F.lit(REACH | REFERENCE)) > 0)
    more = ranges(reaches(texts.join(marks.where(wanted), ["one", "two"]), length), length)
    met = texts.join(marks, ["one", "two"], "left").join(more, ["one", "two"], "left")
    return without(met, length, docs.schema["doc_id"].dataType.simpleString())
