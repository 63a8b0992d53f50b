"""Byte-level BPE of whole texts, with a bounded memory of what was encoded before.

The pattern that byte-level vocabularies split text by always cuts before a space that a
non-space follows: letters, digits and symbols end there, and a run of white space gives
up its last character to what follows. So the ids of a text are the ids of the stretches
between such cuts, one after the other. Most stretches are words that were seen before;
each new one is encoded by the library that owns the vocabulary.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from spanlake.llm.shared import worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A cut that is none of those above: a space before white space, or at the end.
ODD = re.compile(r" (?:\s|\Z)")
KEPT = 100_000  # stretches remembered, twice


class Memory:
    """``bytes`` of a text from the bytes of its stretches.

    ``encode`` maps a list of texts to one ``bytes`` each. Two generations of stretches
    are kept, so that memory is bounded and frequent ones stay.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], kept: int = KEPT) -> None:
        self.encode, self.kept = encode, kept
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if ODD.search(text):
            return next(iter(self.encode([text])))
        first, *rest = text.split(" ")
        young = self.young
        try:
            body = b"".join(map(young.__getitem__, rest))
        except KeyError:
            if len(young) > self.kept:
                self.old, self.young = young, {}
                young = self.young
            need = {p for p in rest if p not in young}
            for p in [p for p in need if p in self.old]:
                young[p] = self.old[p]
                need.discard(p)
            need = list(need)
            young.update(zip(need, self.encode([" " + p for p in need])))
            body = b"".join(map(young.__getitem__, rest))
        return next(iter(self.encode([first]))) + body if first else body

    def column(self, texts: pa.Array) -> list[bytes]:
        """``bytes`` of each text of a column without nulls. Different stretches are found for all texts
        at once, so each is looked up once a column and not once a text."""
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        flat, heads, n = parts.flatten(), bounds[:-1], len(texts)
        bounds = bounds - bounds[0]
        inner = np.ones(len(flat), bool)
        inner[heads - parts.offsets[0].as_py()] = False
        coded = flat.filter(pa.array(inner)).dictionary_encode()
        after = bounds - np.arange(n + 1)  # bounds of each text's stretches but its first

        # Texts with a cut that is none of those above are encoded whole.
        odd = begins_odd(coded.dictionary)
        whole = np.zeros(n, bool)
        if odd.any():
            whole[np.searchsorted(after, np.flatnonzero(odd[coded.indices.to_numpy()]), "right") - 1] = True

        bodies = self.stretches(coded.dictionary, ~odd).take(coded.indices)
        places = np.frombuffer(bodies.buffers()[1], np.int64)[: len(bodies) + 1] if len(bodies) else np.zeros(1, np.int64)
        data = memoryview(bodies.buffers()[2] or b"") if len(bodies) else memoryview(b"")
        ends = places[after].tolist()

        first = flat.take(pa.array(heads - parts.offsets[0].as_py())).to_pylist()
        begins = [i for i, p in enumerate(first) if p]
        opening = [b""] * n
        for i, raw in zip(begins, self.encode([first[i] for i in begins]) if begins else ()):
            opening[i] = raw
        out = [x + data[a:b] for x, a, b in zip(opening, ends, ends[1:])]
        for i in np.flatnonzero(whole).tolist():
            out[i] = next(iter(self.encode([texts[i].as_py()])))
        return out

    def stretches(self, different: pa.Array, wanted: np.ndarray) -> pa.Array:
        """``bytes`` of different stretches; empty for those that are not wanted."""
        at = np.flatnonzero(wanted).tolist()
        texts = different.to_pylist()
        out = [b""] * len(texts)
        for i, raw in zip(at, self.looked_up([texts[i] for i in at])):
            out[i] = raw
        return pa.array(out, pa.large_binary())

    def looked_up(self, different: list[str]) -> list[bytes]:
        """``bytes`` of different stretches, given without the space in front."""
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, different))
        need = []
        for i in [i for i, raw in enumerate(found) if raw is None]:
            raw = old.get(different[i])
            if raw is None:
                need.append(i)
            else:
                found[i] = young[different[i]] = raw
        if need:
            for i, raw in zip(need, self.encode([" " + different[i] for i in need])):
                found[i] = young[different[i]] = raw
        return found


def begins_odd(stretches: pa.Array) -> np.ndarray:
    """Which stretches are empty or begin with white space."""
    offsets = np.frombuffer(stretches.buffers()[1], np.int32 if stretches.type == pa.string() else np.int64)
    offsets = offsets[stretches.offset : stretches.offset + len(stretches) + 1]
    data = np.frombuffer(stretches.buffers()[2] or b"", np.uint8)
    out = offsets[1:] == offsets[:-1]
    some = np.flatnonzero(~out)
    first = data[offsets[some]]
    for i in some[(first <= 32) | (first >= 128)].tolist():
        out[i] = stretches[i].as_py()[0].isspace()
    return out


def ranks(name: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def cached(key: tuple, make: Callable):
    """``make()`` once in a Python worker."""
    cache = worker_cache()
    if key not in cache:
        cache[key] = make()
    return cache[key]


def rank_encoding(name: str):
    """The tiktoken encoding of a rank file, once per worker."""

    def make():
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={}
        )

    return cached(("ranks", name), make)
