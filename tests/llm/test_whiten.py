"""Whitening against a direct eigendecomposition, and the updates it is made of."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from minutebook.llm import whiten


def spectrum(rows):
    s = whiten.Spectrum(rows.shape[1])
    for r in rows:
        s.add(r)
    return s


@pytest.mark.parametrize("kind", ["plain", "low rank", "repeated", "equal eigenvalues", "one"])
def test_rank_one_updates_give_the_spectrum(kind):
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(400, 24)))
    if kind == "low rank":
        x = np.floor(9 * rng.normal(size=(400, 3))) @ np.floor(5 * rng.normal(size=(3, 24)))
    elif kind == "repeated":
        x[100:] = x[0]
    elif kind == "equal eigenvalues":
        x = np.concatenate([np.eye(24), -np.eye(24)]) * 256
    elif kind == "one":
        x = x[:1]
    want = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    size = max(1.0, np.abs(want).max())
    a, b = spectrum(x), spectrum(x[: len(x) // 3])
    b.combine(spectrum(x[len(x) // 3:]))
    for s in (a, b):
        assert np.abs(s.vectors * s.values @ s.vectors.T - want).max() < 1e-11 * size
        assert np.abs(s.vectors.T @ s.vectors - np.eye(24)).max() < 1e-11
        assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0)) and (np.diff(s.values) >= 0).all()


def test_secular_roots_lie_between_the_poles():
    d, z, rho = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0]), np.array([1e-3, 2.0, 1e-6, 0.5]), 3.0
    roots, away = whiten.secular_roots(d, z, rho)
    assert (np.diag(away) < 0).all() and (np.diag(away, 1) > 0).all() and (roots >= d).all()
    terms = rho * z * z / away
    assert (np.abs(1 + terms.sum(axis=1)) <= 1e-14 * (1 + np.abs(terms).sum(axis=1))).all()


def expected(rows, n_components=4):
    out = {}
    for size in {len(v) for _, v in rows}:
        mine = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in rows if len(v) == size]
        fit = np.array(sorted({tuple(x) for _, x in mine}))
        n, sums = len(fit), fit.sum(axis=0)
        cov = (fit - sums / n).T @ (fit - sums / n) / n
        values, vectors = np.linalg.eigh(cov)
        for i, x in mine:
            for c in range(min(n_components, size)):
                e = values[-1 - c]
                out.setdefault((i, c + 1), []).append((n, int(((n * x - sums) ** 2).sum()), abs((x - sums / n) @ vectors[:, -1 - c]) / np.sqrt(e),
                                                       e / np.trace(cov)))
    return out


def test_whitened_rows_equal_a_direct_solution(spark):
    rng = np.random.default_rng(6)
    mixing = rng.normal(size=(12, 12))
    rows = [(i, [float(v) for v in (mixing @ rng.normal(size=12)).astype(np.float32)]) for i in range(700)]
    rows += [(2000 + i, rows[3][1]) for i in range(300)] + [(5, rows[6][1]), (3000, [-0.0] * 12), (3001, [0.001] * 12)]
    rows += [(4000 + i, [float(v) for v in rng.integers(-9, 9, 3)]) for i in range(20)]
    odd = [(9000, None), (9001, []), (9002, [1.0] * 11 + [None]), (9003, [float("nan")] * 12), (9004, [float("inf")] * 12)]
    table = spark.createDataFrame(rows + odd + [(None, rows[0][1])], "vec_id long, embedding array<float>").repartition(4)
    table = table.withColumn("x", F.lit(1)).withColumn("dim", F.lit("a")).withColumn("component", F.lit(2))
    got = whiten.whiten(table).collect()
    want = expected(rows)
    assert sum(r.vec_id is None for r in got) == 4
    found = {}
    for r in got:
        if r.vec_id is not None:
            found.setdefault((r.vec_id, r.component), []).append(r)
        assert r.identity_error <= 1e-9
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in want.items()}
    for k, mine in found.items():
        for r, w in zip(sorted(mine, key=lambda r: abs(r.whitened)), sorted(want[k], key=lambda w: w[2])):
            assert r.n == w[0] and abs(abs(r.whitened) - w[2]) < 1e-8 and abs(r.explained / w[3] - 1) < 1e-9
        assert sorted(r.deviation for r in mine) == sorted(w[1] for w in want[k])
    # One sign for all rows: opposite sides stay opposite.
    first = {r.vec_id: r.whitened for r in got if r.component == 1 and r.vec_id is not None and r.vec_id < 700}
    values, vectors = np.linalg.eigh(np.cov(np.array([np.floor(256 * np.array(v)) for _, v in rows[:700]]).T))
    side = np.array([np.floor(256 * np.array(v)) for _, v in rows[:700]]) @ vectors[:, -1]
    mine = np.array([first[i] for i in range(700)])
    assert abs(np.corrcoef(side, mine)[0, 1]) > 0.99


def test_vectors_without_variance_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    same = whiten.whiten(spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(3)], schema)).collect()
    assert len(same) == 12 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, 0.0, 0.0, 0.0) for r in same)
    assert whiten.whiten(spark.createDataFrame([], schema)).count() == 0
    flat = whiten.whiten(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], schema)).collect()
    assert all(r.whitened == 0 and abs(r.explained) < 1e-12 for r in flat if r.component == 2) and len(flat) == 10
    huge = whiten.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], schema)).collect()
    assert len(huge) == 4
