"""Vectors, conversations, licenses and components on small tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from minutebook.llm import chat, queries, topk, vectors
from minutebook.llm.common import components


def test_components_of_chains_stars_and_repeats(spark):
    links = [(k, k + 1) for k in range(60)] + [(200, 100 + k) for k in range(30)] + [(5, 5), (7, 3), (3, 7), (900, 901)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[100 + k] == 100 for k in range(30)) and got[200] == 100
    assert got[901] == 900 and components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    rows = []
    for k in range(500):
        c = centers[k % 12] if k % 3 else rng.normal(size=16)
        rows.append((k, [float(v) for v in (c + rng.normal(size=16) * 0.09).astype(np.float32)], k % 2, "x"))
    rows += [(1000 + k, rows[1][1], 1, "y") for k in range(5)] + [(1003, rows[1][1], 1, "y")]
    odd = [(2000, None, 1, "z"), (2001, [0.0] * 16, 1, "z"), (2002, [1.0] * 15 + [None], 1, "z"), (2003, [float("nan")] * 16, 1, "z"),
           (2004, rows[1][1], None, "z"), (None, rows[1][1], 1, "z"), (2050, [1.0, 2.0], 1, "z"), (2100, [], 1, "z"),
           (2150, [float("inf")] * 16, 1, "z")]
    return rows + odd


def test_all_links_of_a_dense_label_are_found(spark):
    """20,000 vectors of mean cosine 0.9 in one label, 300 pairs of cosine 0.981 among them; production parameters."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    mean = unit(rng.normal(size=64))
    off = lambda n: unit((r := rng.normal(size=(n, 64))) - (r @ mean)[:, None] * mean)
    x = 0.9 ** 0.5 * mean + 0.1 ** 0.5 * off(20_000)
    side = off(300)
    side = unit(side - (side * x[:300]).sum(axis=1, keepdims=True) * x[:300])
    x[10_000:10_300] = 0.981 * x[:300] + (1 - 0.981 ** 2) ** 0.5 * side
    x = x.astype(np.float32)
    table = pa.table({"vec_id": np.arange(20_000), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32())),
                      "label": np.ones(20_000, np.int32)})
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(spark.createDataFrame(table)).collect()}
    exact, wide = np.zeros(20_000, int), unit(x.astype(np.float64))
    for k in range(0, 20_000, 2000):
        exact[k:k + 2000] = (wide[k:k + 2000] @ wide.T >= 0.98).sum(axis=1) - 1
    assert exact.sum() >= 600 and [got[k][0] for k in range(20_000)] == exact.tolist()
    assert all(got[10_000 + k][1] == got[k][1] for k in range(300))


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("options", [dict(), dict(block=32), dict(passes=12, window=24, block=32)])
def test_vector_links_equal_brute_force(spark, cloud, options, monkeypatch):
    if "passes" in options:
        monkeypatch.setattr(vectors, "DIRECT", 20)
    # Two vectors of one id far apart, each with a neighbor of its own; very long vectors.
    far = [(3000, [1.0] + [0.0] * 15, 5, "w"), (3000, [0.0] * 15 + [1.0], 5, "w"), (3001, [1.0, 0.05] + [0.0] * 14, 5, "w"),
           (3002, [0.0] * 14 + [0.05, 1.0], 5, "w"), (3100, [1e200] + [0.0] * 15, 6, "v"), (3101, [1e200] + [1.0] * 15, 6, "v")]
    rows = cloud + far
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component string")
    got = vectors.near_duplicate_vectors(table, **options).collect()
    good = [(i, np.array(v, np.float64) / max(map(abs, v)), l) for i, v, l, _ in rows if usable(v) and any(v) and i is not None and l is not None]
    links = {n: set() for n in range(len(good))}
    for a, (i, v, l) in enumerate(good):
        for b, (j, w, m) in enumerate(good):
            if a != b and l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[a].add(b)
    least = {n: good[n][0] for n in links}
    while True:
        new = {n: min([least[n]] + [least[m] for m in links[n]]) for n in links}
        if new == least:
            break
        least = new
    alone = [i for i, v, l, _ in rows if not (usable(v) and any(v) and i is not None and l is not None)]
    want = [(good[n][0], len(links[n]), least[n], good[n][0] == least[n]) for n in links] + [(i, 0, i, None if i is None else True) for i in alone]
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted(want, key=str)
    assert vectors.near_duplicate_vectors(table.limit(0), **options).count() == 0


def test_wide_groups_and_hard_labels_have_a_plan():
    passes, window = vectors.pass_plan(100_000, 1.0, [1600.0, 25.0, 1.0], 0.98)
    assert 5 < passes < 40 and window == 64
    work = [n * np.prod(vectors.pass_plan(n, 0.1, [n / 64, n / 4096, 1.0], 0.98)) for n in (40_000, 80_000)]
    assert 0 < work[1] <= 2.2 * work[0]
    assert vectors.pass_plan(100_000, 0.005, [9e4, 8e4, 7e4], 0.98) == (0, 0)  # all within reach of each other
    assert vectors.pass_plan(1_000, 1.0, [20.0, 1.0, 1.0], 0.98) == (0, 0)


@pytest.mark.parametrize("copies", [1, 2, 20])
def test_rows_of_the_query_id_take_no_place_of_others(spark, copies):
    """A query id on several rows near its own vector; all others lie on the other side."""
    own = [(50, [10.0 + 0.01 * i, 0.0]) for i in range(copies)]
    rows = own + [(1000 + i if i % 50 else 999, [-10.0, 0.1 * i]) for i in range(44)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in (dict(), dict(pivots=2), dict(pivots=30, split=10)):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_products(table, **options).collect())
        whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
        want = []
        for q in sorted({i for i, _ in whole if i % 50 == 0}):
            best = sorted((-int(a @ x), j) for a in {tuple(v) for i, v in whole if i == q} for j, x in whole if j != q for a in [np.array(a)])[:5]
            want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
        assert got == sorted(want) and sum(g[0] == 50 for g in got) == 5


@pytest.mark.parametrize("sizes", [dict(), dict(pivots=7, group=3, split=60)])
def test_top_products_equal_brute_force(spark, cloud, sizes):
    table = spark.createDataFrame(cloud, "vec_id long, embedding array<float>, label int, grp string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_products(table, **sizes).collect())
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v, _, _ in cloud if usable(v) and i is not None]
    want = []
    for i, q in {i: q for i, q in good if i % 50 == 0}.items():
        best = sorted((-int(q @ x), j) for j, x in good if j != i and len(x) == len(q))[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_products(table.limit(0)).count() == 0


def test_far_candidates_are_not_sent(spark):
    """Two tight clusters on opposite sides: the plan sends each query group its own cluster only."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.array([1.0] + [0.0] * 7) + rng.normal(size=(200, 8)) * 0.01,
                        np.array([-1.0] + [0.0] * 7) + rng.normal(size=(200, 8)) * 0.01])
    x = np.floor(256 * x)
    cells = topk._Cells(x[[0, 250]], float((x ** 2).sum(axis=1).max()))
    far, ask = cells.of_candidates(x), cells.of_queries(x)
    home = far.argmin(axis=1)
    summary = [{"cell": c, "queries": 3, "reach": ask[home == c, c].max(), "id": None, "far": None} for c in (0, 1)]
    summary += [{"cell": c, "queries": None, "reach": None, "id": 10 * c + i, "far": d}
                for c in (0, 1) for i, d in enumerate(np.sort(far[home == c, c])[:6].tolist())]
    plan = topk._Plan(cells, summary, 5, 400, 3, 100, 0)
    assert len(plan.groups) == 2
    for g, (cell,) in enumerate(plan.groups):
        own = far[np.arange(400), home]
        need = (own >= plan.inner[cell, home]) & (own <= plan.outer[cell, home])
        assert need[home == cell].all() and not need[home != cell].any()


def test_preference_pairs_by_hand(spark):
    kinds = "conv_id long, turn int, role string, text string, pair string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi", "p"), (1, 1, "assistant", "good", "p"), (2, 0, None, None, "p"), (3, 0, "user", "x", "p"),
                                    (None, 0, "user", "lost", "p"), (4, 1, "assistant", "b", "p"), (4, 0, "user", "a<|im_end|>", "p")], kinds)
    rejected = spark.createDataFrame([(1, 0, "user", "hi", "p"), (1, 1, "assistant", "bad!", "p"), (2, 0, None, None, "p"),
                                      (4, 0, "user", "a<|im_end|>", "p"), (4, 1, "assistant", "b", "p"), (4, 2, "user", "more", "p")], kinds)
    got = {r.conv_id: r for r in chat.preference_pairs(chosen, rejected).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].prefix_turns == 1 and got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert got[1].chosen == "<|im_start|>assistant\ngood<|im_end|>\n"
    [span] = got[1].rejected_spans
    assert got[1].rejected[span.start:span.end] == "bad!<|im_end|>"
    assert got[2].prompt == "<|im_start|>user\n<|im_end|>\n" and got[2].chosen == got[2].rejected == "" and not got[2].chosen_spans
    assert got[3].prompt == "" and got[3].rejected == "" and got[3].chosen.startswith("<|im_start|>user\nx")
    assert got[4].prefix_turns == 2 and "a< |im_end|>" in got[4].prompt and got[4].chosen == ""
    assert chat.preference_pairs(chosen.limit(0), rejected.limit(0)).count() == 0
    assert chat.preference_pairs(chosen, chat.with_other_answer(chosen)).count() == 4


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = db.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted(tuple(r[i] for i in at) for r in cursor.fetchall())
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want and want
