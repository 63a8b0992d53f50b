"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds its distinct shingles of five words as 64-bit hashes; its signature
has 128 minima, 16 bits each. The first 48 symbols are cut into 12 chunks of four. Two
signatures that differ in at most 23 of the 48 have, by the pigeonhole principle, a chunk
with at most one error, so they agree in that chunk without one of its symbols: each
signature is indexed under the 48 keys (chunk, symbol left out), and pairs that share a
key are met, all of them. At the lowest similarity that links, 0.75, a pair has no such
chunk with probability 0.262**12, one in ten millions; those that agree in fewer than 72
of 128 symbols are let go (one in a million at 0.75).

1. Equal sets become one node, so copies never meet each other.
2. Nodes are joined by key; a key's nodes are dealt to tiles of about ``TILE`` by
   ``TILE``, so no task holds a large bucket. A pair is weighed under its first key only.
3. Nodes with a partner left get their full sets, and pairs are confirmed on those within
   the tiles. Pairs that confirmed links already connect are skipped, so a tile returns a
   forest of links, never all pairs.
4. Links become components by alternating large and small stars.

Nothing is capped: every pair under the threshold is weighed. Defined results: without a
word, or with a null text, a document has an empty set and is linked with nothing; with
fewer than five words its whole sequence is the one shingle; rows with equal ids are
documents of their own that share an id; null ids are passed over in choosing the
smallest, so only a component without other ids has a null one; an empty table gives none.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from spanlake.llm.shared import lowered, mix, segment_hashes, slices, space_words, stored, tidy, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
SYMBOLS, CHUNKS, WIDTH = 128, 12, 4
AGREE = 72
PERCENT = 75
TILE = 512
PAIRS_AT_ONCE = 20_000  # 512 bytes of signatures each


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and n + 1 bounds."""
    low = lowered(data)
    starts, ends, bounds = space_words(low, offsets)
    words = segment_hashes(low, starts, ends)
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    factors = mix(np.arange(WORDS, dtype=np.uint64) + np.uint64(9)) | np.uint64(1)
    # A row of fewer words gives its sequence, marked by its length.
    short = (n > 0) & (n < WORDS)
    first = np.arange(len(words))
    whole = (first + WORDS <= bounds[1:][row]) | (short[row] & (first == bounds[:-1][row]))
    first, row = np.flatnonzero(whole), row[whole]
    keys = np.where(short[row], mix(n[row].astype(np.uint64)), np.uint64(0))
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        keys += np.where(first + k < bounds[1:][row], padded[first + k] * factors[k], np.uint64(0))
    keys = mix(keys)
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    keys, row = keys[new], row[new]
    return keys, np.searchsorted(row, np.arange(len(n) + 1))


def fingerprints(keys: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """12 bytes that tell sets apart; None for an empty one."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys + np.uint64(s)))]) for s in (1, 2)]
    a, b = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
    a, b = mix(a).astype("<u8"), mix(b).astype("<u4")
    return [x.tobytes() + y.tobytes() if n else None for x, y, n in zip(a, b, np.diff(bounds))]


def signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 minima per row; rows of an empty set are zero."""
    seeds = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64))
    out = np.zeros((len(bounds) - 1, SYMBOLS), np.uint16)
    some = np.flatnonzero(np.diff(bounds))
    for at in range(0, len(some), 64):
        rows = some[at : at + 64]
        part = keys[bounds[rows[0]] : bounds[rows[-1] + 1]]
        cuts = bounds[rows] - bounds[rows[0]]
        for k, seed in enumerate(seeds):
            least = np.minimum.reduceat((part ^ seed) * np.uint64(0x9E3779B97F4A7C15), cuts)
            out[rows, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """The index keys of each signature: chunk by chunk, without each of its symbols in turn."""
    n = len(signature)
    symbols = signature[:, : CHUNKS * WIDTH].reshape(n, CHUNKS, WIDTH).astype(np.uint64)
    out = np.zeros((n, CHUNKS, WIDTH), np.uint64)
    for left_out in range(WIDTH):
        key = np.tile(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(left_out + 1), (n, 1))
        for j in range(WIDTH):
            if j != left_out:
                key = mix((key << np.uint64(1)) + mix(symbols[:, :, j] + np.uint64(j << 16)))
        out[:, :, left_out] = key
    return out.reshape(n, -1).view(np.int64)


def first_key(equal: np.ndarray) -> np.ndarray:
    """The number of the first key that two signatures share, from their equal symbols."""
    chunks = equal[:, : CHUNKS * WIDTH].reshape(-1, CHUNKS, WIDTH)
    near = chunks.sum(axis=2) >= WIDTH - 1
    chunk = near.argmax(axis=1)
    return chunk * WIDTH + np.argmin(chunks[np.arange(len(chunks)), chunk], axis=1)


def sketch(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, node, signature)``; node is null for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                keys, bounds = shingle_sets(*utf8(part.column(1)))
                sign = signatures(keys, bounds)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(bounds), pa.int64()),
                    pa.array(fingerprints(keys, bounds), pa.binary()),
                    pa.array([s.tobytes() for s in sign], pa.binary()),
                ], names=["doc_id", "n_shingles", "node", "signature"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles bigint, node binary, signature binary"
    )


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def index(nodes: DataFrame) -> DataFrame:
    """``(key, number, node)``: the 48 keys of each node."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = chunk_keys(_unpacked(part.column(1)))
                each = keys.shape[1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.reshape(-1)),
                    pa.array(np.tile(np.arange(each, dtype=np.int8), len(keys))),
                    part.column(0).take(pa.array(np.repeat(np.arange(len(keys)), each))),
                ], names=["key", "number", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key bigint, number tinyint, node binary")


def tiled(rows: DataFrame, size: int) -> DataFrame:
    """Rows of each key dealt to ``parts`` sides; a row goes to the tiles of its side and each other one."""
    parts = F.ceil(F.col("met") / size).cast("int")
    side = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    return (
        rows.withColumn("parts", parts).withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("tile", F.least("side", "other") * F.col("parts") + F.greatest("side", "other"))
    )


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches as whole (key, tile) groups, with the groups' bounds."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        batch = table.to_batches()[0]
        key, tile = (batch.column(c).to_numpy() for c in ("key", "tile"))
        cut = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
        return batch, np.concatenate([[0], cut, [batch.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key, tile = (held[-1].column(c).to_numpy() for c in ("key", "tile"))
        cut = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))
        if len(cut):
            end = int(cut[-1]) + 1
            yield whole([*held[:-1], batch.slice(0, end)])
            held = [batch.slice(end)]
    if held:
        yield whole(held)


def group_pairs(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows within groups, some at a time: left, right, group."""
    sizes = np.diff(bounds)
    left, right, group, held = [], [], [], 0
    for size in np.unique(sizes[sizes > 1]):
        which = np.flatnonzero(sizes == size)
        for i in range(size - 1):
            # Rows i of all groups of this size with the rows after them.
            step = max(1, PAIRS_AT_ONCE // int(size - 1 - i))
            for at in range(0, len(which), step):
                g = which[at : at + step]
                a = np.repeat(bounds[g] + i, size - 1 - i)
                b = a + np.tile(np.arange(1, size - i), len(g))
                left.append(a), right.append(b), group.append(np.repeat(g, size - 1 - i))
                held += len(a)
                if held >= PAIRS_AT_ONCE:
                    yield np.concatenate(left), np.concatenate(right), np.concatenate(group)
                    left, right, group, held = [], [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right), np.concatenate(group)


def near_pairs(batch: pa.RecordBatch, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs to confirm: of one group, of two sides if it has two, under their first key, near enough."""
    sign = _unpacked(batch.column("signature"))
    side, parts, tile, number = (batch.column(c).to_numpy() for c in ("side", "parts", "tile", "number"))
    across = tile // parts != tile % parts
    for a, b, group in group_pairs(bounds):
        mine = ~across[a] | (side[a] != side[b])
        a, b, group = a[mine], b[mine], group[mine]
        equal = sign[a] == sign[b]
        agree = equal.sum(axis=1)
        near = (agree >= AGREE) & (first_key(equal) == number[a])
        order = np.argsort(-agree[near], kind="stable")
        yield a[near][order], b[near][order], group[near][order]


def partners(rows: DataFrame) -> DataFrame:
    """The rows of tiles that have a pair to confirm there."""
    names = [f.name for f in rows.schema.fields]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in grouped(batches):
            some = np.zeros(batch.num_rows, bool)
            for a, b, _ in near_pairs(batch, bounds):
                some[a] = some[b] = True
            if some.any():
                yield batch.filter(pa.array(some)).select(names)

    dealt = rows.repartition("key", "tile").sortWithinPartitions("key", "tile", "node")
    return dealt.mapInArrow(run, rows.schema)


def confirmed(rows: DataFrame) -> DataFrame:
    """``(one, two)``: confirmed links of each tile, a forest of them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in grouped(batches):
            root = list(range(batch.num_rows))
            values = batch.column("keys")

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            sets: dict[int, np.ndarray] = {}
            one, two = [], []
            for a, b, _ in near_pairs(batch, bounds):
                for x, y in zip(a.tolist(), b.tolist()):
                    if find(x) == find(y):
                        continue
                    for i in (x, y):
                        if i not in sets:
                            sets[i] = np.frombuffer(values[i].as_py(), np.uint64)
                    if linked(sets[x], sets[y]):
                        root[find(x)] = find(y)
                        one.append(x), two.append(y)
            node = batch.column("node")
            if one:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(one)), node.take(pa.array(two))], names=["one", "two"])

    dealt = rows.repartition("key", "tile").sortWithinPartitions("key", "tile", "node")
    return dealt.mapInArrow(run, "one binary, two binary")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two ascending sets share enough."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    place = np.searchsorted(x, y)
    place[place == len(x)] = 0
    both = int((x[place] == y).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, keys)`` of the wanted ``(doc_id, node)``, from the documents' whole texts."""
    ids = wanted.select(F.col("doc_id").alias("__id")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                keys, bounds = shingle_sets(*utf8(part.column(1)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(fingerprints(keys, bounds), pa.binary()),
                    pa.array([keys[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                ], names=["node", "keys"])

    every = texts.mapInArrow(run, "node binary, keys binary")
    return every.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(one, two)``: alternating stars until nothing moves."""
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))).first())

    edges = stored(
        links.select(F.greatest("one", "two").alias("node"), F.least("one", "two").alias("root")).distinct(), "links"
    )
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.col("node"), F.min("root")).alias("least"))
        large = both.join(least, "node").where(F.col("root") > F.col("node")).select(
            F.col("root").alias("node"), F.col("least").alias("root")
        ).where("node <> root").distinct()
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(least, "node").select(
            F.explode(F.array(
                F.struct("node", F.col("least").alias("root")), F.struct(F.col("root").alias("node"), F.col("least").alias("root"))
            )).alias("e")
        ).select("e.*").where("node <> root").distinct()
        edges = stored(small, "links")
    return edges.unionByName(edges.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per document."""
    sketches = stored(sketch(docs), "sketches")
    nodes = sketches.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("signature").alias("signature")
    )
    nodes = stored(nodes, "nodes")
    keys = index(nodes)
    shared = keys.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    met = stored(keys.join(shared, "key"), "met")
    rows = tiled(met.join(nodes.select("node", "signature"), "node"), tile)
    left = stored(partners(rows.select("key", "tile", "number", "parts", "side", "node", "signature")), "partners")
    wanted = nodes.join(left.select("node").distinct(), "node", "left_semi").select("doc_id", "node")
    links = confirmed(left.join(sets_of(docs, wanted), "node"))
    roots = components(links)
    groups = roots.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    linked_nodes = roots.join(groups, "root").select("node", "least")
    named = nodes.select("node", "doc_id").join(linked_nodes, "node", "left").select(
        "node", F.coalesce("least", "doc_id").alias("component_id")
    )
    return sketches.drop("signature").join(named, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
