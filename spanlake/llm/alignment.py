"""Links between the tokens of two tokenizers, and how usual each link is in the corpus.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces) the text, to
which it adds that space itself. Both give the same bytes, cut at different places. Where a
token of A and one of B end at the same byte there is a cut; the tokens between two cuts are
a group, and the two tokens that end at a cut are linked.

**Lockstep merging.** The token ends of a slice of documents are two sorted lists a document.
One NumPy state vector holds a pointer into A and one into B for every lane and advances all
of them in each step: the pointer whose token ends first moves on; where both end together the
step emits a link and moves both. Lanes that are through are compacted away. A lane is a
document, or ``LANE`` bytes of it: both pointers of a lane start at the first token that ends
beyond the lane's first byte, which is the state that the merge of the whole document has
there, so a long document takes many lanes side by side instead of many steps.

**Counts.** Documents are taken in blocks of about ``BLOCK`` bytes of text. A block keeps its
documents' links as numbers into its list of different id pairs. The pairs of all blocks are
counted by key, the highest count of each B id is joined to them (a row an id of B), and every
block gets back the counts of its own pairs. So a pair that all documents hold is one row a
block, and no text or link is shuffled by pair.

Special tokens' strings in a text are plain text. Defined results: texts that are null, empty
or not given back byte for byte by both tokenizers have no tokens, zeros and no groups; rows
of equal ids are aligned apart; further columns are not looked at; an empty table gives no
rows. A document has to fit in a worker; blocks hold one document at least.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from spanlake.llm.pieces import cached
from spanlake.llm.shared import slices, stored
from spanlake.llm.token_ids import library_memory

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LANE = 1 << 10
BLOCK = 1 << 22
BLOCKS = "block bigint, ids binary, digests array<string>, numbers binary, links binary, pairs binary, times binary"


class Vocabulary:
    """Bytes of each id, and ``ids_of(text)`` for texts that stand behind a space."""

    def __init__(self, pieces: list[bytes], ids_of: Callable[[str], np.ndarray]) -> None:
        self.pieces, self.ids_of = pieces, ids_of
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        # Decimal ids with what follows them: inside a side, at the end of A's, at the end of B's.
        self.inside, self.end_a, self.end_b = (np.array([f"{i}{sign}" for i in range(len(pieces))], object) for sign in ",|;")

    def spelt(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones of
    Latin-1 for themselves, the others in order from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level(name: str) -> Vocabulary:
    def make() -> Vocabulary:
        import public_tokenizers
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(public_tokenizers.path(name)).get_vocab()
        table, pieces = byte_of(), [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in table for c in token)
            pieces[i] = bytes(table[c] for c in token) if known else token.encode()
        memory = library_memory(name)
        return Vocabulary(pieces, lambda text: np.frombuffer(memory(" " + text), "<u4").astype(np.int64))

    return cached(("aligned", name), make)


def piece_level(name: str) -> Vocabulary:
    def make() -> Vocabulary:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        return Vocabulary(pieces, lambda text: np.array(model.encode(text, num_threads=1), np.int64))

    return cached(("aligned", name), make)


def merged(
    ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray, lane: int = LANE
) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ends_a`` and ``ends_b`` of the tokens that end together, in order.

    Ends count from the slice's first byte, ascending over its documents; ``bounds`` are the
    documents' borders in bytes.
    """
    size = np.diff(bounds)
    lanes = -(-size // lane)
    base = np.repeat(bounds[:-1], lanes)
    low = base + (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
    high = np.minimum(low + lane, np.repeat(bounds[1:], lanes))
    # The state of every lane: next token of A and of B, and where each has its end.
    a, b = np.searchsorted(ends_a, low, "right"), np.searchsorted(ends_b, low, "right")
    stop_a, stop_b = np.searchsorted(ends_a, high, "right"), np.searchsorted(ends_b, high, "right")
    out_a, out_b = [], []
    while len(a):
        on = (a < stop_a) & (b < stop_b)
        if not on.all():
            a, b, stop_a, stop_b = a[on], b[on], stop_a[on], stop_b[on]
            continue
        end_a, end_b = ends_a[a], ends_b[b]
        together = end_a == end_b
        out_a.append(a[together])
        out_b.append(b[together])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at_a, at_b = np.concatenate(out_a), np.concatenate(out_b)
    order = np.argsort(at_a, kind="stable")
    return at_a[order], at_b[order]


def written(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, one: Vocabulary, two: Vocabulary) -> str:
    """``a1,a2|b1;a3|b2,b3`` of one document; cuts are the places of the linked tokens."""
    size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    out = np.empty(len(a) + len(b), object)
    # A token stands behind the other side's tokens of the groups before it, B's behind its own group's too.
    place_a = np.arange(len(a)) + np.repeat(cut_b + 1 - size_b, size_a)
    place_b = np.arange(len(b)) + np.repeat(cut_a + 1, size_b)
    out[place_a], out[place_b] = one.inside[a], two.inside[b]
    out[place_a[cut_a]], out[place_b[cut_b]] = one.end_a[a[cut_a]], two.end_b[b[cut_b]]
    return "".join(out.tolist())[:-1]


def block_rows(docs: DataFrame, name_a: str, name_b: str, lane: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [x.split(" ")[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        one, two = byte_level(name_a), piece_level(name_b)
        press = zstandard.ZstdCompressor(level=1).compress
        task, number = TaskContext.get().partitionId(), 0  # 2**24 blocks a task
        ids, digests, numbers, keys, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, digests, numbers, keys, held
            pairs, links, times = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True, return_counts=True)
            sink = pa.BufferOutputStream()
            table = pa.Table.from_arrays([pa.chunked_array(ids)], names=["doc_id"]).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            row = [
                task << 24 | number, sink.getvalue().to_pybytes(), digests, press(np.array(numbers, np.int64).tobytes()),
                press(links.astype(np.int32).tobytes()), pairs.tobytes(), times.astype(np.int64).tobytes(),
            ]
            number += 1
            ids, digests, numbers, keys, held = [], [], [], [], 0
            types = [pa.int64(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                tokens = []
                for text in part.column(1).to_pylist():
                    a = b = np.zeros(0, np.int64)
                    if text:
                        a, b, raw = one.ids_of(text), two.ids_of(text), (" " + text).encode()
                        if one.spelt(a) != raw or two.spelt(b) != raw:
                            a = b = np.zeros(0, np.int64)
                    tokens.append((a, b))
                all_a, all_b = (np.concatenate([t[k] for t in tokens]) for k in (0, 1))
                bound_a, bound_b = (np.cumsum([0, *(len(t[k]) for t in tokens)]) for k in (0, 1))
                ends_a, ends_b = np.cumsum(one.sizes[all_a]), np.cumsum(two.sizes[all_b])
                at_a, at_b = merged(ends_a, ends_b, np.append(0, ends_a)[bound_a], lane)
                cuts = np.searchsorted(at_a, bound_a)
                for i, (a, b) in enumerate(tokens):
                    z = slice(cuts[i], cuts[i + 1])
                    text = written(a, b, at_a[z] - bound_a[i], at_b[z] - bound_b[i], one, two) if len(a) else ""
                    digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
                    numbers.append((len(a), len(b), cuts[i + 1] - cuts[i]))
                keys.append(all_a[at_a] << 32 | all_b[at_b])
                ids.append(part.column(0))
                held += to - at + int(ends_a[-1]) if len(ends_a) else to - at
                if held >= BLOCK:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast(kind), "text").mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(block, pair, n)`` of each block, and ``(pair, n, best)`` of the corpus: how many links
    hold the pair, and whether no pair of its B id has more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                pairs, times = (np.frombuffer(x.as_buffer(), np.int64) for x in (pairs, times))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(times)], names=["block", "pair", "n"]
                )

    own = blocks.select("block", "pairs", "times").mapInArrow(run, "block bigint, pair bigint, n bigint")
    counts = own.groupBy("pair").agg(F.sum("n").alias("n"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("highest"))
    best = counts.withColumn("b_id", b_id).join(highest, "b_id").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    return own, best


def align(
    docs: DataFrame, name_a: str = "byte_bpe_50k.json", name_b: str = "piece_bpe_32k.model", lane: int = LANE
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per document."""
    blocks = stored(block_rows(docs, name_a, name_b, lane), "aligned-blocks")
    own, counts = pair_counts(blocks)
    of_block = own.select("block", "pair").join(stored(counts, "pair-counts"), "pair").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("counts")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                ids, digests, numbers, links, known = (batch.column(k)[i] for k in range(5))
                with pa.ipc.open_stream(ids.as_buffer()) as reader:
                    ids = reader.read_all().combine_chunks().column(0).combine_chunks()
                numbers = np.frombuffer(expand(numbers.as_py()), np.int64).reshape(-1, 3)
                links = np.frombuffer(expand(links.as_py()), np.int32)
                n, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if known.is_valid:  # in order of pairs, as the block numbered them
                    n = known.values.field("n").to_numpy()
                    best = known.values.field("best").to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(numbers)), numbers[:, 2])
                sums = [np.zeros(len(numbers), np.int64) for _ in range(2)]
                np.add.at(sums[0], row, best[links])
                np.add.at(sums[1], row, n[links])
                yield pa.RecordBatch.from_arrays([
                    ids, *(pa.array(numbers[:, k].copy()) for k in (0, 1, 2, 2)), *map(pa.array, sums), digests.values,
                ], names=names)

    joined = blocks.select("block", "ids", "digests", "numbers", "links").join(of_block, "block", "left")
    return joined.select("ids", "digests", "numbers", "links", "counts").mapInArrow(
        run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    )
