"""Whitening against float64 and exact integers, and refined eigenvectors against wider arithmetic."""

import math
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from tallyloom.llm import queries, whitening

DATA = "/root/testdata/sf0.001"


def jacobi(a):
    """Eigenvalues, falling, and vectors of a small matrix by plain rotations in the widest float."""
    a = np.array(a, np.longdouble)
    n, v = len(a), np.eye(len(a), dtype=np.longdouble)
    for _ in range(30):
        for p in range(n):
            for q in range(p + 1, n):
                if a[p, q] == 0:
                    continue
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.sqrt(theta * theta + 1))
                c = 1 / np.sqrt(t * t + 1)
                s = t * c
                r = np.eye(n, dtype=np.longdouble)
                r[p, p] = r[q, q] = c
                r[p, q], r[q, p] = s, -s
                a, v = r.T @ a @ r, v @ r
    order = np.argsort(-np.diag(a))
    return np.diag(a)[order], v[:, order]


def of_values(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    m = (q * np.array(values)) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("values", [(5, 3, 2, 1, 0.5, 0.1), (1, 1 - 1e-5, 1 - 2e-5, 0.3, 0.2), (1, 1 - 1e-9, 1 - 3e-9, 0.5, 0.5 - 1e-10, 1e-3), (1e9, 7e8, 3, 2, 1), (4, 3, 2, 1, 1e-12)])
def test_vectors_to_double_precision(values):
    m = of_values(values, 1)
    got, x = whitening.refined_eigenvectors(m)
    want, v = jacobi(m)
    assert np.abs(got - want.astype(float)).max() <= 4e-16 * abs(values[0])
    gaps = np.abs(np.subtract.outer(want, want)) + np.diag(np.full(len(want), np.inf))
    for k in range(len(values)):
        sure = 2e-15 + 2e-19 * float(want[0] / gaps[k].min()) * 10
        assert min(np.abs(x[:, k] - v[:, k]).max(), np.abs(x[:, k] + v[:, k]).max()) <= sure, k


@pytest.mark.parametrize("values", [(1, 1, 1, 1), (2, 2, 1, 1, 1, 0), (3, 0, 0, 0), (0, 0, 0)])
def test_equal_values_span_their_space(values):
    m = of_values(values, 2)
    got, x = whitening.refined_eigenvectors(m)
    assert np.allclose(got, values, atol=1e-14)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-14
    assert np.abs(m @ x - x * got).max() < 1e-14


def test_large_matrix_is_as_good_as_float64():
    rng = np.random.default_rng(4)
    m = np.cov(rng.normal(size=(200, 2000)))
    got, x = whitening.refined_eigenvectors(m)
    want = np.linalg.eigvalsh(m)[::-1]
    assert np.abs(got - want).max() < 1e-13
    assert np.abs(m @ x - x * got).max() < 2e-15 * 10
    assert np.abs(x.T @ x - np.eye(200)).max() < 5e-15


def test_packed_vectors_come_back():
    x = np.array([[0, 1, -1], [127, -128, 0], [128, 0, 0], [-129, 5, 5], [1 << 40, 0, -5], [-32769, 1, 1], [1 << 31, 0, 0]], np.int64)
    packed = whitening.pack(x)
    assert [p[0] for p in packed] == [1, 1, 2, 2, 8, 4, 8]
    assert (whitening.unpack(packed, 3) == x).all()


def plain(rows):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = {i_: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i_, (_, v) in enumerate(good)}
    fit = sorted(set(xs.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return good, xs, n, sums, values[::-1], vectors[:, ::-1]


def test_query_against_float64(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    rows += [rows[0], (None, rows[1][1]), (900001, None), (900002, [float("nan")] + rows[0][1][1:]), (900003, [None] + rows[0][1][1:]), (900004, []), (900005, [1.0]), (900006, [float("inf")] * len(rows[0][1]))]
    df = spark.createDataFrame([(*r, "other") for r in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, n STRING")
    got = whitening.op11_whitening(df).collect()
    good, xs, n, sums, values, vectors = plain([r for r in rows if r[0] != 900005])
    assert len(got) == 16 * len(good)
    assert {r["n"] for r in got} == {n} and {r["identity_error"] for r in got} and max(r["identity_error"] for r in got) < 1e-10
    want = {}
    for k, (i, _) in enumerate(good):
        d = [n * a - s for a, s in zip(xs[k], sums, strict=True)]
        want.setdefault(i, []).append((sum(v * v for v in d), (np.array(d) / n) @ vectors / np.sqrt(values)))
    signs = {}
    for r in got:
        c = r["component"]
        dev, w = want[r["vec_id"]][0]
        assert r["deviation"] == dev
        assert abs(r["explained"] - values[c - 1] / values.sum()) < 1e-12
        if abs(w[c - 1]) > 1e-3:
            sign = signs.setdefault(c, np.sign(w[c - 1]) * np.sign(r["whitened"]))
            assert abs(r["whitened"] * sign - w[c - 1]) < 1e-8
    assert whitening.op11_whitening(df.limit(0)).count() == 0
    assert whitening.op11_whitening(df.where("vec_id > 900000")).count() in (0, 2)


def test_huge_equal_and_few(spark):
    schema = "vec_id BIGINT, embedding ARRAY<DOUBLE>"
    same = whitening.op11_whitening(spark.createDataFrame([(k, [0.5, -0.25]) for k in range(5)], schema)).collect()
    assert len(same) == 10 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] == 0 for r in same)
    huge = whitening.op11_whitening(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 4.0])], schema)).collect()
    assert len(huge) == 6 and {r["deviation"] for r in huge if r["vec_id"] != 3} == {None}
    line = whitening.op11_whitening(spark.createDataFrame([(k, [k * 1.0, k * 2.0]) for k in range(9)], schema)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    first = sorted((r["vec_id"], r["whitened"]) for r in line if r["component"] == 1)
    assert abs(sum(w * w for _, w in first) / 9 - 1) < 1e-12


def test_registered_query(spark):
    df = queries.QUERIES["op11_whitening"](spark, DATA)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert df.count() == 16 * spark.read.parquet(f"{DATA}/embeddings.parquet").count()
