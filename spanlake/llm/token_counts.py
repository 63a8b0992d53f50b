"""Token counts per section from one encoding of the whole document.

A document is encoded once; the bytes of its tokens give each token's span of code
points. Sections are spans too, and are joined with the tokens as intervals: both lie
in order, so the tokens of a section are found by binary search. A token that crosses a
section's border is allocated by ``rule``:

``first``  to sections that hold its first character
``last``   to sections that hold its last character
``most``   to sections that hold more than half of its characters, or exactly half and
           its first character

With sections that neither overlap nor leave gaps each rule allocates every token once.
A character whose bytes are spread over several tokens counts as a character of each.

Defined results: a null or empty text has no section of its own making (sentences); given
sections get 0 tokens there; sections beyond the text are cut to it; null bounds count
as an empty section; a document that no section is given for has one row with a null section,
which no token falls to; equal ids share their sections; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from spanlake.llm.pieces import Memory, cached, rank_encoding, ranks
from spanlake.llm.shared import slices, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULES = ("first", "last", "most")
NONE = -(1 << 62)  # number of the section of a document without any


def length_memory(name: str) -> Memory:
    """A text's tokens as their lengths in bytes, two bytes each."""

    def make() -> Memory:
        encoding = rank_encoding(name)
        table = ranks(name)
        sizes = np.zeros(max(table.values()) + 1, "<u2")
        for token, i in table.items():
            sizes[i] = len(token)
        return Memory(lambda texts: (sizes[encoding.encode_ordinary(t)].tobytes() for t in texts))

    return cached(("lengths", name), make)


def allocate(first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many tokens cross one of its borders.

    ``first`` and ``last`` are the tokens' characters, ascending; sections come in any order.
    """
    end = np.maximum(start, end)
    some = end > start
    by_first = np.searchsorted(first, [start, end])
    by_last = np.searchsorted(last, [start, end])
    # The tokens that cross the start; those that cross the end and not the start too.
    over_start = by_last[0], by_first[0]
    over_end = np.maximum(by_last[1], by_first[0]), np.maximum(by_first[1], by_first[0])
    crossing = over_start[1] - over_start[0] + over_end[1] - over_end[0]
    if rule != "most":
        counts = by_first[1] - by_first[0] if rule == "first" else by_last[1] - by_last[0]
    else:
        counts = np.maximum(0, by_last[1] - by_first[0])  # tokens wholly inside
        for lo, hi in (over_start, over_end):
            n = hi - lo
            section = np.repeat(np.arange(len(n)), n)
            token = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[section]
            a, b = first[token], last[token] + 1
            inside = np.minimum(b, end[section]) - np.maximum(a, start[section])
            mine = (2 * inside > b - a) | ((2 * inside == b - a) & (a >= start[section]))
            counts = counts + np.bincount(section[mine], minlength=len(n))
    return np.where(some, counts, 0), np.where(some, crossing, 0)


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of each sentence of the rows."""
    stop = np.isin(data, [ord(c) for c in ".!?"])
    ends = data == ord("\n")
    ends[1:] |= (data[1:] == ord(" ")) & stop[:-1]
    edges = np.union1d(np.flatnonzero(ends) + 1, offsets)
    return np.searchsorted(offsets, edges[:-1], "right") - 1, edges[:-1], edges[1:]


def count_tokens(
    docs: DataFrame, sections: DataFrame | None = None, rule: str = "first",
    name: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """``(doc_id, section, start, end, n_tokens, n_crossing, doc_tokens)`` per section.

    ``sections``: ``(doc_id, section int, start int, end int)`` in code points; if none
    are given they are the document's sentences, numbered from 0: each ends with a newline,
    or with a space after a full stop, question or exclamation mark. A token such as
    `` The`` begins with that space, so it crosses the border.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    docs = docs.select("doc_id", "text")
    given = sections is not None
    if given:
        each = sections.groupBy(F.col("doc_id").alias("__id")).agg(
            F.array_sort(F.collect_list(F.struct("section", "start", "end"))).alias("sections")
        )
        docs = docs.join(each, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")

    def bounds(values: list[list[dict] | None], lead: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, number, start and end of the given sections, in characters of the slice."""
        none = {"section": NONE, "start": None, "end": None}
        rows = [
            (row, s["section"], *((0, 0) if s["start"] is None or s["end"] is None else (s["start"], s["end"])))
            for row, value in enumerate(values) for s in value or (none,)
        ]
        row, number, start, end = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((), (), (), ())))
        size = np.diff(lead)[row]
        return row, number, lead[row] + np.clip(start, 0, size), lead[row] + np.clip(end, 0, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]
        lengths = length_memory(name)
        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                data, offsets = utf8(part.column(1))
                # Characters before each byte of the slice, and before each row.
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                lead = chars[offsets]
                sizes = [lengths(t or "") for t in part.column(1).to_pylist()]
                ends = np.cumsum(np.frombuffer(b"".join(sizes), "<u2").astype(np.int64))
                first = chars[np.concatenate([[0], ends[:-1]]) + 1] - 1 if len(ends) else ends
                last = chars[ends] - 1
                if given:
                    row, number, start, end = bounds(part.column(2).to_pylist(), lead)
                else:
                    row, start, end = sentences(data, offsets)
                    number = np.arange(len(row)) - np.searchsorted(row, row)
                    start, end = chars[start], chars[end]
                counts, crossing = allocate(first, last, start, end, rule)
                tokens = np.array([len(x) // 2 for x in sizes])[row]
                place = [pa.array(x, pa.int64(), mask=number == NONE) for x in (number, start - lead[row], end - lead[row])]
                ids = part.column(0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, *place, *(pa.array(x, pa.int64()) for x in (counts, crossing, tokens))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"doc_id {kind}, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint",
    )
