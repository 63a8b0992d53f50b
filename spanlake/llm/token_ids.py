"""Token ids in a binary format: fixed-size blocks of ids, transposed into planes.

Layout of the folder (Parquet, written with Spark's commit, so lost tasks are run again):

``shard, chunk``     a shard is one task's range of documents, in order; chunks count from 0
``first, n_ids``     position of the chunk's first id in the shard, and its ids (``BLOCK``,
                     the last chunk of a shard fewer)
``docs``             the documents in the chunk: their number in the shard, id, piece
                     number, place and length in the chunk, and whether they end in it
``sizes``            compressed bytes of each plane: the index into ``body``
``body``             the planes, each compressed by zstandard, one after the other

Plane ``b`` of a bit-plane block holds bit ``b`` of each id (``plane="byte"``: byte ``b``),
so the planes of high bits are nearly constant. All but ``body`` is the chunk index;
reading it does not touch the planes.

Defined results: a null text is empty and gives the end id alone; documents with equal
ids are kept, in order of text; null ids come first; an empty table gives no chunk.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanlake.llm.pieces import Memory, cached
from spanlake.llm.shared import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 16
TEXTS = 1 << 23  # bytes of text that are encoded together; one document may be larger
LATIN = "\u0250"
# A word of Latin letters and what follows it: the vocabularies' pattern always ends a piece where letters
# end, and what is no letter here is none there.
LETTERS, BEHIND = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+", "[\\x00-\\x1f!-@\\[-`{-\\x7f].*"
WORD = re.compile(f"({LETTERS})({BEHIND})", re.S)
STRETCH = rf"(?s)\A(?P<word>{LETTERS})(?P<end>(?:{BEHIND})?)\z"  # as Arrow's expressions are written
SPACE = "\u0120"  # how this library's byte-level vocabularies write a space
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that they write as themselves
ALPHABET = {b: chr(b) for b in PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PLAIN)}
TOGETHER = 100
REMEMBERED = 400_000  # stretches, and words of Latin letters, twice
TAILS = 100_000  # remembered ends of stretches, behind a word
DOCS = "array<struct<number:bigint,doc_id:bigint,piece:int,place:int,n:int,ends:boolean>>"
CHUNKS = f"shard int, chunk bigint, first bigint, n_ids int, docs {DOCS}, sizes array<int>, body binary"


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """The planes of 32-bit ids, from the lowest; those above the highest bit are zero."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [raw[:, i].tobytes() for i in range(4)]
    size = -(-int(ids.max(initial=0)).bit_length() // 8)
    planes = []
    for i in range(size):
        byte = np.ascontiguousarray(raw[:, i])
        planes += [np.packbits(byte & np.uint8(1 << k), bitorder="little").tobytes() for k in range(8)]
    return [*planes, *[bytes(-(-len(ids) // 8))] * (32 - len(planes))]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    raw = np.zeros((n, 4), np.uint8)
    for i in range(4):
        byte = np.zeros(n, np.uint8)
        for k, plane in enumerate(planes[8 * i : 8 * i + 8]):
            packed = np.frombuffer(plane, np.uint8)
            if packed.any():
                byte |= np.unpackbits(packed, count=n, bitorder="little") << np.uint8(k)
        raw[:, i] = byte
    return raw.reshape(-1).view("<u4")


class WordMemory(Memory):
    """A memory that remembers the words of a column's stretches apart from what follows them.

    ``words_of`` encodes words of Latin letters with a space in front, ``ends_of`` what follows one.
    """

    def __init__(
        self, encode: Callable[[list[str]], Iterable[bytes]], words_of: Callable[[list[str]], Iterable[bytes]],
        ends_of: Callable[[list[str]], list[bytes]],
    ) -> None:
        super().__init__(encode, REMEMBERED)
        self.words, self.ends_of = Memory(words_of, REMEMBERED), ends_of

    def stretches(self, different: pa.Array, wanted: np.ndarray) -> pa.Array:
        parts = pc.extract_regex(different, STRETCH)
        words, ends = (pc.struct_field(parts, x).dictionary_encode() for x in ("word", "end"))
        coded = [
            pa.array(raw, pa.large_binary()).take(part.indices) for raw, part in (
                (self.words.looked_up(words.dictionary.to_pylist()), words),
                (self.ends_of(ends.dictionary.to_pylist()), ends),
            )
        ]
        out = pc.fill_null(pc.binary_join_element_wise(*coded, pa.scalar(b"", pa.large_binary())), b"")
        rest = wanted & parts.is_null().to_numpy(zero_copy_only=False)
        if rest.any():
            others = self.looked_up(different.filter(pa.array(rest)).to_pylist())
            out = pc.replace_with_mask(out, pa.array(rest), pa.array(others, pa.large_binary()))
        return out


def library_memory(name: str, ordinary: bool = True) -> Callable[[str], bytes]:
    """Encoding by the tokenizers library, ids as little-endian 32-bit integers.

    ``ordinary`` reads the strings of special tokens as any other text; without it they
    give their own ids, as the library does by default. A text that holds such a string is
    encoded whole then, as white space before it is not split like that before a word.
    """

    def make() -> Callable[[str], bytes]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        tokenizer.encode_special_tokens = True

        model, tails = tokenizer.model, {}
        spaced = np.zeros(tokenizer.get_vocab_size(), bool)
        spaced[[i for token, i in tokenizer.get_vocab().items() if token[0] == SPACE]] = True

        def words_of(words: list[str]) -> Iterator[bytes]:
            """Of words of Latin letters, with a space in front: each is one piece of the pattern, so it
            goes to the library's model as it is."""
            spelled = "".join(words).encode().decode("latin-1").translate(ALPHABET)
            for x in spelled.split(SPACE)[1:]:
                ids = [token.id for token in model.tokenize(SPACE + x)]
                yield struct.pack(f"<{len(ids)}I", *ids)

        def ends_of(ends: list[str]) -> list[bytes]:
            if len(tails) > TAILS:
                tails.clear()
            new = [*dict.fromkeys(end for end in ends if end not in tails)]
            for t, x in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                tails[t] = np.array(x.ids, "<u4").tobytes()
            return list(map(tails.__getitem__, ends))

        def encode(texts: list[str]) -> Iterator[bytes]:
            # Stretches that begin with a space and hold no other go together: a call costs
            # more than a word, and a token with a space in front begins the next stretch.
            if len(texts) == 1 or not all(t[0] == " " and t.count(" ") == 1 for t in texts):
                for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                    yield np.array(x.ids, "<u4").tobytes()
                return
            # A word goes to the model once, whatever follows it; what follows is seldom new.
            cut = []
            for t in texts:
                word = t[1:]
                if word.isalpha() and (word.isascii() or max(word) < LATIN):
                    cut.append((word, ""))
                else:
                    found = WORD.fullmatch(word)
                    cut.append(found.groups() if found else (None, t))
            words = dict.fromkeys(word for word, _ in cut if word)
            words = dict(zip(words, words_of([" " + w for w in words])))
            behind = iter(ends_of([end for word, end in cut if word and end]))
            rest = [t for word, t in cut if not word]
            together = ["".join(rest[i : i + TOGETHER]) for i in range(0, len(rest), TOGETHER)]
            pieces = []
            for x in tokenizer.encode_batch_fast(together, add_special_tokens=False):
                ids = np.array(x.ids, "<u4")
                cuts = (4 * np.flatnonzero(spaced[ids])).tolist()
                raw = ids.tobytes()
                pieces += [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]
            others = iter(pieces)
            for word, end in cut:
                yield (words[word] + next(behind) if end else words[word]) if word else next(others)

        memory = WordMemory(encode, words_of, ends_of)
        if ordinary:
            return memory
        default = Tokenizer.from_file(public_tokenizers.path(name))
        special = [t.content for t in default.get_added_tokens_decoder().values() if t.special]

        def whole(text: str) -> bytes:
            if any(x in text for x in special):
                return np.array(default.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return memory(text)

        return whole

    return cached(("library", name, ordinary), make)


def library_columns(name: str, ordinary: bool = True) -> Callable[[pa.Array], list[bytes]]:
    """``library_memory`` for columns of texts."""
    memory = library_memory(name)
    if ordinary:
        return memory.column

    def make() -> list[str]:
        import public_tokenizers
        from tokenizers import Tokenizer

        default = Tokenizer.from_file(public_tokenizers.path(name))
        return [t.content for t in default.get_added_tokens_decoder().values() if t.special]

    special, whole = cached(("special", name), make), library_memory(name, False)

    def column(texts: pa.Array) -> list[bytes]:
        out = memory.column(texts)
        for x in special:
            for i in np.flatnonzero(pc.match_substring(texts, x).to_numpy(zero_copy_only=False)).tolist():
                out[i] = whole(texts[i].as_py())
        return out

    return column


def write_ids(
    docs: DataFrame, folder: str, name: str = "byte_bpe_50k.json", end_id: int = 2,
    plane: str = "bit", block: int = BLOCK, ordinary: bool = True,
) -> None:
    """Encode ``(doc_id, text)`` and write the ids in ascending order of ``doc_id``.

    ``ordinary``: strings of special tokens are ordinary text; see ``library_memory``.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        schema = pa.schema([
            ("shard", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int32()),
            ("docs", pa.list_(pa.struct([
                ("number", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("place", pa.int32()),
                ("n", pa.int32()), ("ends", pa.bool_()),
            ]))),
            ("sizes", pa.list_(pa.int32())), ("body", pa.binary()),
        ])
        encode = library_columns(name, ordinary)
        shard = TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=3)
        chunk = number = 0
        held, filled, inside = [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal chunk, held, filled, inside
            planes = [press.compress(p) for p in to_planes(np.frombuffer(b"".join(held), "<u4"), plane)]
            row = {
                "shard": shard, "chunk": chunk, "first": chunk * block, "n_ids": filled, "docs": inside,
                "sizes": [len(p) for p in planes], "body": b"".join(planes),
            }
            chunk, held, filled, inside = chunk + 1, [], 0, []
            return pa.RecordBatch.from_pylist([row], schema=schema)

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                if batch.num_rows:
                    texts = batch.column(1).fill_null("")
                    for at, to in slices(texts, TEXTS):
                        yield from zip(batch.column(0).slice(at, to - at).to_pylist(), encode(texts.slice(at, to - at)))

        for doc_id, raw in encoded():
            ids = raw + end
            at = piece = 0
            while at < len(ids):
                part = ids[at : at + 4 * (block - filled)]
                at += len(part)
                n = len(part) // 4
                inside.append({
                    "number": number, "doc_id": doc_id, "piece": piece, "place": filled, "n": n,
                    "ends": at == len(ids),
                })
                held.append(part)
                filled += n
                piece += 1
                if filled == block:
                    yield flush()
            number += 1
        if filled:
            yield flush()

    ordered.mapInArrow(run, CHUNKS).write.parquet(folder)


def read_pieces(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """``(shard, number, doc_id, piece, ends, at, ids)``: documents cut at chunk borders.

    ``at`` is the place in the shard, ``ids`` are little-endian 32-bit integers; with
    ``digest`` their number and crc32 come in their place, ``n`` and ``crc``.
    """
    names = ["shard", "number", "doc_id", "piece", "ends", "at", *(("n", "crc") if digest else ("ids",))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ends = np.cumsum(row["sizes"]).tolist()
                planes = [expand.decompress(row["body"][a:b]) for a, b in zip([0, *ends], ends)]
                ids = from_planes(planes, row["n_ids"]).astype("<u4").tobytes()
                docs = row["docs"]
                parts = [ids[4 * d["place"] : 4 * (d["place"] + d["n"])] for d in docs]
                last = [pa.array(parts, pa.binary())] if not digest else [
                    pa.array([d["n"] for d in docs], pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())
                ]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(docs), pa.int32()),
                    pa.array([d["number"] for d in docs], pa.int64()),
                    pa.array([d["doc_id"] for d in docs], pa.int64()),
                    pa.array([d["piece"] for d in docs], pa.int32()),
                    pa.array([d["ends"] for d in docs], pa.bool_()),
                    pa.array([row["first"] + d["place"] for d in docs], pa.int64()),
                    *last,
                ], names=names)

    chunks = spark.read.schema(CHUNKS).parquet(folder)
    return chunks.mapInArrow(
        run, "shard int, number bigint, doc_id bigint, piece int, ends boolean, at bigint, "
        + ("n bigint, crc bigint" if digest else "ids binary"),
    )


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def crc_joined(one: int, two: int, size: int) -> int:
    """crc32 of two stretches of bytes from the crc32 of each and the second's size.

    ``size`` zero bytes behind the first stretch act on its crc as a linear map over bits;
    the map of one zero bit is squared up to the size's binary digits.
    """
    power = [0xEDB88320, *(1 << i for i in range(31))]
    bits = 8 * size
    while bits:
        if bits & 1:
            one = _times(power, one)
        power = [_times(power, row) for row in power]
        bits >>= 1
    return one ^ two


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, crc)`` of every document, from one decoding of its chunks.

    Only numbers are shuffled; the pieces of a document are put together by their sizes.
    """

    def together(pieces: pd.Series) -> pd.Series:
        out = []
        for rows in pieces:
            crc = 0
            for k, r in enumerate(sorted(() if rows is None else rows, key=lambda r: r["piece"])):
                crc = crc_joined(crc, r["crc"], 4 * r["n"]) if k else r["crc"]
            out.append(crc)
        return pd.Series(out, dtype="int64")

    documents = read_pieces(spark, folder, digest=True).groupBy("shard", "number").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
        F.collect_list(F.struct("piece", "n", "crc")).alias("pieces"),
    )
    several = F.size("pieces") > 1
    joined = F.pandas_udf(together, "bigint")(F.when(several, F.col("pieces")))  # null for whole documents
    crc = F.when(several, joined).otherwise(F.col("pieces")[0]["crc"])
    return documents.withColumn("crc", crc).join(shard_starts(spark, folder), "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "crc"
    )


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``(shard, base)``: ids in the shards before each, from the index; one row per shard."""
    totals = spark.read.schema(CHUNKS).parquet(folder).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, ids)``: whole documents and the number of ids before them.

    Only documents that cross a chunk border are brought together; a group is one document.
    """
    pieces = read_pieces(spark, folder)
    whole = (F.col("piece") == 0) & F.col("ends")

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        head = table.slice(0, 1)
        ids = pa.array([b"".join(table.column("ids").to_pylist())], pa.binary())
        return head.select(["shard", "doc_id", "at"]).append_column("ids", ids)

    crossing = pieces.where(~whole).groupBy("shard", "number").applyInArrow(
        together, "shard int, doc_id bigint, at bigint, ids binary"
    )
    documents = pieces.where(whole).select("shard", "doc_id", "at", "ids").unionByName(crossing)
    return documents.join(shard_starts(spark, folder), "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "ids"
    )
