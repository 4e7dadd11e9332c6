"""Whitening against exact covariances and a library's eigenvectors."""

import math
from fractions import Fraction

import duckdb
import numpy as np

from tidemark.llm import queries, whitening


def brute(rows, components):
    """Per row (n, deviation, whitened) and the explained shares, with exact sums."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    centred = [[n * r[k] - sums[k] for k in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    white = np.array([[v / n for v in r] for r in centred]) @ basis / np.sqrt(values)
    return n, [sum(v * v for v in r) for r in centred], white, values / np.trace(cov)


def hold(got, rows, components):
    n, deviations, white, explained = brute([v for _, v in rows], components)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    k = min(components, len(rows[0][1]))
    assert len(got) == len(rows) * k and len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-9
    signs = [0.0] * k
    for c in range(k):  # either sign, the same for all rows
        first = max(range(len(rows)), key=lambda i: abs(white[i][c]))
        mine = by[rows[first][0], c + 1][0]["whitened"]
        signs[c] = math.copysign(1, mine * white[first][c])
    for i, (key, _) in enumerate(rows):
        for c in range(k):
            r = by[key, c + 1][0]
            assert (r["n"], r["deviation"]) == (n, deviations[i])
            assert abs(r["whitened"] - signs[c] * white[i][c]) < 1e-6 and abs(r["explained"] / explained[c] - 1) < 1e-9


def test_query(spark, sf):
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    hold(queries.op13_embedding_whitening(spark, sf).collect(), rows, 32)


def test_what_is_dropped_and_many_partitions(spark):
    r = np.random.default_rng(3)
    good = [(k, (r.normal(size=5) * [9, 5, 3, 2, 1] + [1e6, -3, 0, 0, 2]).tolist()) for k in range(400)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [math.nan] * 5), (903, [math.inf, 0.0, 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0]), (906, [1.0] * 7)]
    df = spark.createDataFrame([(i, v, "own", 1) for i, v in good + bad], "vec_id long, embedding array<double>, component string, n int")
    hold(whitening.whiten(df.repartition(70)).collect(), good, 32)
    hold(whitening.whiten(df.repartition(2), components=2).collect(), good, 2)
    one = sorted((tuple(x)[:4] for x in whitening.whiten(df.repartition(70)).collect()))
    assert one == sorted((tuple(x)[:4] for x in whitening.whiten(df.coalesce(1)).collect()))


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3 + [(None, [1.0, 2.0])], schema)).collect()
    assert len(same) == 8 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (4, 0, None, None, 0.0) for r in same)
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 0.0, float(k)]) for k in range(9)], schema)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and abs(line[0]["identity_error"]) < 1e-12
    huge = whitening.whiten(spark.createDataFrame([(1, [1e38]), (2, [-1e38]), (3, [0.5])], schema)).collect()
    assert [r["deviation"] for r in huge if r["vec_id"] == 1] == [None] and len(huge) == 3


def test_symmetric_qr():
    r = np.random.default_rng(1)
    for a in [np.zeros((4, 4)), np.eye(5), np.ones((6, 6)), np.array([[0, 1.0], [1, 0]]), np.array([[2.0]]), *(m @ m.T for m in (r.normal(size=(n, n)) for n in (2, 3, 17, 64)))]:
        values, basis = whitening.symmetric_eigen(a)
        size = max(abs(values).max(), 1)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size * len(a))
        assert np.allclose(basis.T @ basis, np.eye(len(a)), atol=1e-13) and np.allclose(a @ basis, basis * values, atol=1e-13 * size * len(a))


def test_moments_far_from_zero():
    x = np.random.default_rng(2).integers(0, 300, (500, 4)) + 10**9
    parts = [whitening.Moments(4) for _ in range(7)]
    for k, row in enumerate(x):
        parts[k * k % 7].add(row.astype(float))
    total = whitening.Moments(4)
    for p in parts:
        total.merge(p)
    assert total.n == 500 and np.allclose(total.m2 / 500, np.cov((x - 10**9).T, bias=True), rtol=1e-7)
