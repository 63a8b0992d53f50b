"""Whitening against numpy's own decomposition."""

from __future__ import annotations

import math

import numpy as np
import pytest

from spanlake.llm import whitening
from spanlake.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    kept = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept], np.int64)
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum(int(n * a - b) ** 2 for a, b in zip(row.tolist(), s.tolist())) for row in x]
    return [k for k, _ in kept], n, deviation, values, y @ axes / np.sqrt(np.maximum(values, 1e-300))


def vectors(n, size, seed=1):
    rng = np.random.default_rng(seed)
    rows = (rng.standard_normal((n, size)) * np.linspace(2, 0.1, size)) @ np.linalg.qr(rng.standard_normal((size, size)))[0]
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(rows)]


def check(got, rows, wanted=8):
    ids, n, deviation, values, whitened = brute(rows)
    assert len(got) == len(ids) * wanted and all(r.n == n for r in got)
    assert all(abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append((r.whitened, int(r.deviation)))
    for component, found in by.items():
        mine = whitened[:, component - 1]
        pairs = [(found[k][0], want, d) for k, want, d in zip(ids, mine, deviation)]
        sign = np.sign(sum(f[0] * w for f, w, _ in pairs))
        assert max(abs(sign * f[0] - w) for f, w, _ in pairs) < 1e-8
        assert all(f[1] == d for f, _, d in pairs)


def test_whitening_with_awkward_rows(spark):
    rows = vectors(300, 20) + [(900, None), (901, [float("nan")] * 20), (902, [1.0, None] * 10), (903, [float("inf")] + [0.0] * 19), (904, [])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA).selectExpr("*", "1 AS n", "2 AS k", "3 AS v", "4 AS component").repartition(5)
    check(whitening.whiten(df).collect(), [r for r in rows if r[1] != []])


def test_query(spark, tmp_path):
    rows = vectors(200, 16, 5) + [(500, None)]
    spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_whitening"](spark, str(tmp_path))
    assert got.schema["deviation"].dataType.simpleString() == "bigint"
    check(got.collect(), rows)


def test_repeated_rows_and_other_lengths(spark):
    rows = vectors(50, 6)
    df = spark.createDataFrame([(k, v, 1) for k, v in [*rows, *rows[:10], (None, rows[0][1]), (99, [1.0, 2.0])]], SCHEMA)
    got = whitening.whiten(df).collect()
    assert len(got) == 61 * 6 and {r.n for r in got} == {61}
    assert sum(r.vec_id == 3 for r in got) == 12 and sum(r.vec_id is None for r in got) == 6


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]])
def test_tables_without_components(spark, rows):
    assert whitening.whiten(spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA)).collect() == []


def test_missing_rank_gives_fewer_components(spark):
    rows = [(i, [float(i), float(-2 * i), 0.25]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_huge_entries_stay_exact(spark):
    rows = [(i, [1e9 * i, -3e8 * i * i, 5.0]) for i in range(40)] + [(99, [3e38, 0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA)).collect()
    _, _, deviation, _, _ = brute(rows[:-1])
    assert {r.vec_id: int(r.deviation) for r in got} == dict(enumerate(deviation))


@pytest.mark.parametrize("kind", ["random", "equal", "clusters", "tridiagonal", "one", "two"])
def test_components(kind):
    rng = np.random.default_rng(2)
    size = {"one": 1, "two": 2}.get(kind, 40)
    values = np.sort(rng.random(size))[::-1] * 10 + 1
    if kind == "equal":
        values[:6] = 20.0
    if kind == "clusters":
        values[:8] = 30 + np.arange(8)[::-1] // 3 + 1e-12 * np.arange(8)[::-1]
        values[8:] = 1
    turn = np.eye(size) if kind == "tridiagonal" else np.linalg.qr(rng.standard_normal((size, size)))[0]
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, axes = whitening.components(matrix)
    assert np.allclose(found, np.sort(values)[::-1][:8], rtol=1e-13, atol=0)
    assert np.abs(axes.T @ axes - np.eye(len(found))).max() < 1e-13
    assert np.abs(matrix @ axes - axes * found).max() < 1e-12 * values.max()


def test_sturm_counts():
    rng = np.random.default_rng(3)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[10] = 0
    true = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    points = np.concatenate([true - 1e-9, true + 1e-9])
    assert whitening.below(d, e, points).tolist() == [*range(30), *range(1, 31)]
