"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are ``[0-9a-z]`` and non-ASCII characters in a row, A-Z lower-cased. The items'
words make one suffix automaton; a document's words are streamed through it, which gives
the longest match that ends at each word. Where it is ``n`` words or longer, the last
``n`` words are a window of an item; an item with fewer words is one window itself.
Words inside windows are hit. Stretches of words that occur in no item are skipped first.

Items are dealt to shards of at most twice ``SHARD`` words (long items in pieces that
overlap by n - 1 words; pieces that are equal are taken once), and a shard is all that is
broadcast at a time; with several shards the documents pass through one automaton after
the other.

Defined results: a null or empty text has no words and is never hit; an item without
words has no window; repeated items count apart by id, equal ids as one; a null item id
is the id ``null``; repeated documents are kept; the columns that this operator adds
replace those of the same name.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from spanlake.llm.shared import lowered, runs, segment_hashes, slices, stored, tidy, utf8, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
SHARD = 100_000
PIECE = 20_000

ADDED = ("n_words", "n_hit", "items", "hits", "spans")
PAIRS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def item_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes, starts and ends of the words, and the rows' bounds."""
    low = lowered(data)
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = inside[0x61:0x7B] = inside[0x80:] = True
    starts, ends, bounds = runs(inside[low], offsets)
    return segment_hashes(low, starts, ends), starts, ends, bounds


class Automaton:
    """Suffix automaton of several word sequences; a state's ``windows`` are item numbers."""

    def __init__(self, items: list[tuple[int, bool, np.ndarray]], n: int) -> None:
        """``items``: number, whether the sequence is a whole short item, word hashes."""
        self.n = n
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, _, w in items)]))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(k, short, np.searchsorted(self.words, w).tolist()) for k, short, w in items]
        for _, _, ids in sequences:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self._cut: dict[int, int] = {}
        self.windows: dict[int, set[int]] = {}  # by state that holds the n words
        self.whole: dict[int, list[tuple[int, int]]] = {}  # by state: length, short item
        for k, short, ids in sequences:
            for state, length, _ in self.stream(ids):
                if length >= n:
                    self.windows.setdefault(self.of_window(state), set()).add(k)
            if short and ids:
                self.whole.setdefault(state, []).append((len(ids), k))
        self.least = min([n, *(len(ids) for _, short, ids in sequences if short and ids)])
        self._near: dict[int, int] = {}

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state of p's longest word sequence followed by w, cut off from q if q holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """After each word: state and length of the longest match that ends there, and its place."""
        state = length = 0
        for at, w in enumerate(ids):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            yield state, length, at

    def of_window(self, state: int) -> int:
        """The state of the last n words of a match of at least n; walked to once per state."""
        seen = []
        while state not in self._cut and self.length[self.link[state]] >= self.n:
            seen.append(state)
            state = self.link[state]
        state = self._cut.get(state, state)
        for s in seen:
            self._cut[s] = state
        return state

    def near_whole(self, state: int) -> int:
        """The state itself or the next suffix that ends a whole short item; 0 if none."""
        seen = []
        at = state
        while at and at not in self.whole and at not in self._near:
            seen.append(at)
            at = self.link[at]
        at = self._near.get(at, at)
        for s in seen:
            self._near[s] = at
        return at

    def hits(self, ids: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """``(first word, end, items)`` of every window that occurs."""
        for state, length, at in self.stream(ids):
            if length >= self.n:
                yield at + 1 - self.n, at + 1, self.windows.get(self.of_window(state), set())
            if self.whole:
                up = self.near_whole(state)
                while up:
                    for size, k in self.whole[up]:
                        if size <= length:
                            yield at + 1 - size, at + 1, {k}
                    up = self.near_whole(self.link[up])


def item_pieces(benchmark: DataFrame, n: int, size: int = PIECE) -> DataFrame:
    """``(item, short, n, words)``: hashes of the words of each item, in overlapping pieces."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, _, _, bounds = item_words(*utf8(batch.column(1)))
            rows = []
            for i, item in enumerate(batch.column(0).to_pylist()):
                words = hashes[bounds[i] : bounds[i + 1]]
                for at in range(0, max(1, len(words) - n + 1), size):
                    part = words[at : at + size + n - 1]
                    if len(part):
                        rows.append({"item": item, "short": len(words) < n, "n": len(part), "words": part.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("item", pa.string()), ("short", pa.bool_()), ("n", pa.int32()), ("words", pa.binary())
            ]))

    text = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text")
    return text.mapInArrow(run, "item string, short boolean, n int, words binary")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, items: list, shard: int, n: int) -> DataFrame:
    """One automaton over all documents; hits of passes before it are added to."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ADDED]
    before = "hits" in docs.columns
    sent = spark.sparkContext.broadcast([(k, short, words) for k, (_, short, words) in enumerate(items)])
    ids = spark.sparkContext.broadcast([item for item, _, _ in items])
    place = docs.columns.index("text")
    key = uuid.uuid4().hex, shard

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if cache.get("automaton", (None,))[0] != key:
            cache["automaton"] = key, Automaton([(k, s, np.frombuffer(w, np.uint64)) for k, s, w in sent.value], n)
        automaton = cache["automaton"][1]
        for batch in batches:
            for at, to in slices(batch.column(place)):
                yield one(batch.slice(at, to - at), automaton)

    def one(part: pa.RecordBatch, automaton: Automaton) -> pa.RecordBatch:
        data, offsets = utf8(part.column(place))
        hashes, starts, ends, bounds = item_words(data, offsets)
        vocabulary = automaton.words
        found = np.searchsorted(vocabulary, hashes)
        found[found == len(vocabulary)] = 0
        known = vocabulary[found] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        first, last, _ = runs(known, bounds)
        long = last - first >= automaton.least
        spans = [[] for _ in range(part.num_rows)]
        items: list[set[str]] = [set() for _ in spans]
        if before:
            spans = [[(h["start"], h["end"]) for h in x] for x in part.column("hits").to_pylist()]
            items = [set(x) for x in part.column("items").to_pylist()]
        rows = np.searchsorted(bounds, first[long], "right") - 1
        for a, b, row in zip(first[long].tolist(), last[long].tolist(), rows.tolist()):
            for x, y, which in automaton.hits(found[a:b].tolist()):
                shift = a - int(bounds[row])
                spans[row].append((x + shift, y + shift))
                items[row].update(ids.value[k] for k in which)
        out, places = [], []
        for row, each in enumerate(spans):
            each = merged(each)
            out.append([{"start": a, "end": b} for a, b in each])
            chars = []
            if each:
                start, lead = int(offsets[row]), np.cumsum((data[offsets[row] : offsets[row + 1]] & 0xC0) != 0x80)
                for a, b in each:
                    from_, to = int(starts[bounds[row] + a]) - start, int(ends[bounds[row] + b - 1]) - start
                    chars.append({"start": int(lead[from_]) - 1, "end": int(lead[to - 1])})
            places.append(chars)
        added = [
            pa.array(np.diff(bounds), pa.int64()),
            pa.array([sum(b - a for a, b in ((s["start"], s["end"]) for s in x)) for x in out], pa.int64()),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            pa.array(out, PAIRS),
            pa.array(places, PAIRS),
        ]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *added], names=[*names, *ADDED])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    pair = "array<struct<start:int,end:int>>"
    return docs.mapInArrow(
        run, f"{kept}, n_words bigint, n_hit bigint, items array<string>, hits {pair}, spans {pair}"
    )


def match(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """``docs`` plus ``n_words, n_hit, items, hits, spans``.

    ``hits`` are ranges of word numbers, ``spans`` the same in code points of the text,
    ``items`` the sorted ids of the items with a window in the document.
    """
    docs = docs.select(*(c for c in docs.columns if c not in ADDED))
    pieces = stored(item_pieces(benchmark, n, min(PIECE, shard)).distinct(), "benchmark-words")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard))
    dealt = lambda: F.pmod(F.xxhash64("item", "words"), F.lit(shards))
    # Dealt by hash, so a shard may be larger than the mean: then more shards are made.
    while shards > 1 and pieces.groupBy(dealt()).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > 2 * shard + n:
        shards *= 2
    for k in range(shards):
        rows = pieces.where(dealt() == k).select("item", "short", "words").collect()
        if k:
            docs = stored(docs, "decontaminated")
        docs = _pass(docs, [(r.item, r.short, bytes(r.words)) for r in rows], k, n)
    return docs


def contaminated(percent: int = 5) -> Column:
    """Whether hit words make up at least ``percent`` of a matched document."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def cut(text: Column, spans: Column, least: int = 1) -> Column:
    """The text without the spans of at least ``least`` characters."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    long = F.filter(spans, lambda s: s["end"] - s["start"] >= least)
    return F.aggregate(
        long, start,
        lambda acc, s: F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))),
    )
