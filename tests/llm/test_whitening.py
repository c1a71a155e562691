import math

import numpy as np
import pytest

from mailshift.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, id int, vector string, component int, length int"


def brute(vectors, most=32):
    """Whitened rows by a dense eigensolver of the same whole numbers."""
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    n, d = x.shape
    y = x - x.mean(axis=0)
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    whole = x.astype(int).tolist()
    s = [sum(r[k] for r in whole) for k in range(d)]
    return e, u, y @ u / np.sqrt(e), np.trace(y.T @ y / n), [sum((n * v - t) ** 2 for v, t in zip(r, s)) for r in whole]


def test_query_against_a_dense_solver(spark, sf):
    source = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(source)
    e, _, w, trace, deviations = brute([source[k] for k in ids])
    rows = queries.op12_whitening(spark, sf).collect()
    k = min(32, len(ids) - 1)
    assert len(rows) == len(ids) * k
    mine = np.zeros((len(ids), k))
    for r in rows:
        row = ids.index(r.vec_id)
        mine[row, r.component - 1] = r.whitened
        assert r.n == len(ids) and r.deviation == deviations[row] and math.isclose(r.explained, e[r.component - 1] / trace, rel_tol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    for c in range(k):
        assert np.allclose(mine[:, c], w[:, c], atol=1e-6) or np.allclose(mine[:, c], -w[:, c], atol=1e-6)


@pytest.mark.parametrize("kind", ["random", "graded", "deficient", "equal", "one", "none", "indefinite"])
def test_components_against_a_dense_solver(kind):
    pick = np.random.default_rng(3)
    a = {"random": np.cov(pick.standard_normal((300, 40)).T), "graded": np.cov((pick.standard_normal((500, 12)) * np.logspace(0, 4, 12)).T),
         "deficient": np.cov(pick.standard_normal((9, 20)).T), "equal": np.diag([5.0, 5, 5, 2, 1, 1, 0]), "one": np.array([[3.0]]), "none": np.zeros((4, 4)),
         "indefinite": np.array([[0.0, 2], [2, 0]])}[kind]
    values, vectors = whitening.leading_components(a, 32)
    told = np.linalg.eigvalsh(a)[::-1]
    told = told[told > 1e-9 * max(abs(told).max(), 1e-300)][:32]
    values, vectors = values[: len(told)], vectors[:, : len(told)]
    assert np.allclose(values, told, rtol=1e-10)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * max(abs(a).max(), 1)) and np.allclose(vectors.T @ vectors, np.eye(len(told)), atol=1e-12)


def test_counts_are_those_of_the_spectrum():
    pick = np.random.default_rng(4)
    for n in (1, 2, 5, 30):
        a = pick.standard_normal((n, n))
        a = a + a.T
        told = np.linalg.eigvalsh(a)
        for shift in [*pick.uniform(told[0] - 1, told[-1] + 1, 20), 0.0]:
            assert whitening.eigenvalues_above(a, shift) == (told > shift).sum()
    assert whitening.eigenvalues_above(np.zeros((3, 3)), 0.0) == 0


def test_hard_rows(spark):
    pick = np.random.default_rng(6)
    fine = [(k, [float(v) for v in pick.standard_normal(4)]) for k in range(50)]
    fine += [fine[0], (None, fine[1][1])]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan")] * 4), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, []), (106, [3e38, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(k, v, 1, "x", 2, 3) for k, v in fine + odd], SCHEMA)
    rows = whitening.whitened(table, whitening.fit_whitening(table)).collect()
    assert len(rows) == 4 * len(fine) and {r.vec_id for r in rows} == {k for k, _ in fine}
    single = np.float32([v for _, v in fine])
    e, _, w, trace, deviations = brute(single)
    assert sorted(r.deviation for r in rows if r.component == 1) == sorted(deviations)
    assert np.allclose(sorted(abs(r.whitened) for r in rows if r.component == 1), sorted(abs(w[:, 0])), atol=1e-9)
    assert rows[0].identity_error < 1e-9 and rows[0].n == len(fine)


def test_too_little_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)], [(1, [])]):
        table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        out = whitening.whitened(table, whitening.fit_whitening(table))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [5e8, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whitened(table, whitening.fit_whitening(table)).collect()}
    exact = brute([v for _, v in rows])[4]
    assert got == {k: e if e < 2**63 else None for k, e in zip((1, 2, 3), exact)}
