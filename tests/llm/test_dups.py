"""Near-duplicates and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from samples import FOLD, SCHEMA, WORD, documents, prose, python_steps_apart

from spanlake.llm import near_dups, repeats

DOCS = documents()


def shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(rows):
    """By position: shingles and the smallest id that is reachable."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return sorted(
        ((d, len(s), d if not s else ids.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr
    )


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = near_dups.near_duplicates(df, **more).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


def test_components_of_samples(spark):
    rows = [r[:2] for r in DOCS]
    assert found(spark, rows) == brute_components(rows)


@pytest.mark.parametrize("tile", [512, 4])
def test_families_and_chains(spark, tile):
    """Families of edited copies: hot buckets, links through others, and pairs just apart."""
    rng = random.Random(5)
    rows = []
    for family in range(3):
        words = prose(100 + family, 90).split(" ")
        for _ in range(40):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice("abcdef")
            rows.append((len(rows), " ".join(copy)))
            words = copy if family == 2 else words  # a chain drifts away
    rng.shuffle(rows)
    assert found(spark, rows, tile=tile) == brute_components(rows)


def test_threshold_is_exact(spark):
    """Sets of 12 and 16 that share 12 lie on 0.75 exactly; one shingle less does not link."""
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words[:20])), (2, " ".join(words[:16])), (3, " ".join(words[20:40])), (4, " ".join(words[20:35]))]
    assert found(spark, rows) == [(1, 16, 1), (2, 12, 1), (3, 16, 3), (4, 11, 4)]


def test_no_documents(spark):
    assert found(spark, []) == []


def test_first_shared_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, (500, near_dups.SYMBOLS)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.6, a, rng.integers(0, 3, a.shape)).astype(np.uint16)
    same = near_dups.chunk_keys(a) == near_dups.chunk_keys(b)
    some = same.any(axis=1)
    assert some.any()
    assert (near_dups.first_key(a == b)[some] == same[some].argmax(axis=1)).all()


def brute_removal(rows, length):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2).tolist()
        out.append((doc_id, len(b), int(gone.sum()), edges, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def removed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted((
        (r.doc_id, r.n_bytes, r.n_removed, [[s.start, s.end] for s in r.spans], hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in repeats.remove_repeats(df, **more).collect()
    ), key=repr)


@pytest.mark.parametrize("length,hot", [(400, 50_000), (400, 0), (64, 50_000), (30, 3), (9, 50_000)])
def test_removal(spark, length, hot):
    rows = [r[:2] for r in DOCS]
    assert removed(spark, rows, length=length, hot=hot) == brute_removal(rows, length)


def test_removal_at_the_threshold(spark):
    """Shared stretches of 399 to 402 bytes, at edges and inside, in chains over three texts."""
    rng = random.Random(8)
    noise = lambda n, of="abcdefghij": "".join(rng.choices(of, k=n))
    rows = []
    for size in (399, 400, 401, 402):
        part = noise(size)  # what stands around it shares no letter with the others'
        rows += [(len(rows), noise(50, "KL") + part + noise(70, "MN")), (len(rows) + 1, part + noise(30, "OP")), (len(rows) + 2, noise(20, "QR") + part)]
    long = noise(900)
    rows += [(90, long[:600]), (91, long[300:]), (92, long[150:700]), (93, noise(350))]
    expected = brute_removal(rows, 400)
    assert removed(spark, rows) == expected
    assert {r[0]: r[2] for r in expected}[0] == 0 and {r[0]: r[2] for r in expected}[3] == 400


def test_long_run_sends_few_edges(spark, monkeypatch):
    """Every place of a run is an anchor; of each class one goes on, and batches of edges are bounded."""
    sent = []
    edges = repeats._edges
    monkeypatch.setattr(repeats, "_edges", lambda *a: sent.append(edges(*a)) or sent[-1])
    monkeypatch.setattr(repeats, "EDGE_BYTES", 2000)
    rows = [(1, "a" * 20_000 + prose(31, 300)), (2, prose(32, 200) + " " * 9_000 + prose(33, 200)), (3, "a" * 700)]
    assert removed(spark, rows) == brute_removal(rows, 400)
    assert sent[0].count() < 3000


def test_run_of_megabytes(spark):
    size = 3 << 20
    tail = prose(34, 300)
    got = removed(spark, [(1, "-" * size + tail)])
    assert [(r[0], r[2], r[3]) for r in got] == [(1, size, [[0, size]])]


def test_no_texts(spark):
    assert removed(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame(DOCS, SCHEMA).selectExpr("*", "1 AS rank", "2 AS node", "3 AS kept", "4 AS marks")
    assert near_dups.near_duplicates(df).count() == repeats.remove_repeats(df).count() == len(DOCS)


def test_query_counts_kept_characters(spark):
    """``n_kept`` compares with ``n_chars``, also where a character takes several bytes."""
    from spanlake.llm.queries import QUERIES
    from spanlake.sources.workspace import new_folder

    folder, shared = new_folder(spark, "kept"), prose(35, 120)
    rows = [(1, "é" * 150, "fr", "s", 150), (2, "ü " + shared, "de", "s", 0), (3, shared + " ñ", "es", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_repeats"](spark, folder).collect()}
    assert got[1].n_kept == 150 and got[1].n_bytes == 300
    assert all(r.n_kept == len(r.text) for r in got.values()) and got[2].n_kept < 10


def test_a_task_needs_one_python_worker(spark):
    """Executors keep the workers that their tasks took at once."""
    df = spark.createDataFrame(DOCS, SCHEMA)
    assert python_steps_apart(repeats.remove_repeats(df))
    same = lambda batches: batches
    assert not python_steps_apart(df.select("text").mapInArrow(same, "text string").mapInArrow(same, "text string"))


def test_sums_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HELD", 3)
    rows = [(n, prose(36 + n % 3, 400)) for n in range(9)] + [(20, "b" * 3_000)]
    assert removed(spark, rows) == brute_removal(rows, 400)


def test_freed_memory_goes_back():
    """Executors keep their workers, so what a task's buffers took must not stay with a worker."""
    script = """
import re
import pyarrow as pa
from spanlake.llm.shared import tidy

@tidy
def run(batches):
    for size in batches:
        held = [pa.array(["x" * 100] * size) for _ in range(20)]
        held += [column.take(pa.array(range(0, size, 2))) for column in held]
        yield len(held)

def taken():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10

list(run([10]))
before = taken()
list(run([40_000] * 2))
print(taken() - before)
"""
    root = Path(__file__).resolve().parents[2]
    said = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, check=True)
    assert int(said.stdout) < 25, said.stdout


def test_pairs_at_once_are_few():
    """Two nodes' signatures are compared for some pairs at a time, in a few MB."""
    sizes = [len(a) for a, _, _ in near_dups.group_pairs(np.array([0, 1000, 1003]))]
    assert sum(sizes) == 1000 * 999 // 2 + 3
    assert max(sizes) * near_dups.SYMBOLS * 4 < 16 << 20


def test_python_steps_of_the_pipeline_are_tidy(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from spanlake.llm import bpe, decontam, quality

    steps = []
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, f=kind.mapInArrow: steps.append(run) or f(self, run, *a))
    df = spark.createDataFrame(DOCS, SCHEMA)
    items = spark.createDataFrame([("i", prose(40, 100))], "item_id string, text string")
    made: list[DataFrame] = [quality.judge(df), near_dups.near_duplicates(df), decontam.match(df, items), bpe.encode(df, long=50)]
    assert len(made) == 4 and len(steps) >= 9
    assert not [run for run in steps if not hasattr(run, "__wrapped__")]
