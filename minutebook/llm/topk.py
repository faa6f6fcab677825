"""Exact top-k inner products by a Voronoi join.

Inner products become distances: with m the largest norm, every candidate x
gets one more component sqrt(m^2 - |x|^2) and every query a zero, so a larger
product is a smaller distance.  Queries and candidates belong to the cell of
their nearest pivot.  From summaries of the cells alone -- the largest
distance of a query to its pivot, the least distances of candidates of k + 1
different ids to theirs -- the triangle inequality bounds the distance of the
k-th neighbor of every query of a cell: of k + 1 ids at most one is the
query's own, however many rows share it.  The bound gives the ring of each
other cell in which candidates can matter.  Only those are sent to the group of the queries,
where products of whole blocks give the answer.  Bounds are widened by more
than rounding can lose, so ties stay in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minutebook.llm.common import materialize, ship

ship(__name__)

MOST_PIVOTS, GROUP, SPLIT = 512, 16384, 16384


def _rows(column) -> np.ndarray:
    """Whole-number vectors of equal length as a matrix; in floats if sums stay exact there."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = chunk.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(chunk), -1) if len(chunk) else np.zeros((0, 1), np.int64)
    return x.astype(np.float64) if x.size == 0 or int(np.abs(x).max()) ** 2 * x.shape[1] < 1 << 52 else x


class _Cells:
    """Pivots of one vector length; distances of candidates and of queries to them."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots.astype(np.float64), most
        self.lift = np.sqrt(np.maximum(0, most - (self.pivots ** 2).sum(axis=1)))
        self.slack = 1e-6 * np.sqrt(most) + 1e-9

    def of_candidates(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        lift = np.sqrt(np.maximum(0, self.most - (x ** 2).sum(axis=1)))
        return np.sqrt(np.maximum(0, 2 * self.most - 2 * (x @ self.pivots.T + lift[:, None] * self.lift)))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(0, (x ** 2).sum(axis=1)[:, None] + self.most - 2 * x @ self.pivots.T))


def _summaries(cells: dict[int, _Cells], k: int):
    """Of each cell: queries and their reach, and the candidates of least distance, one of an id and k + 1 ids."""
    names = ["dim", "cell", "queries", "reach", "id", "far"]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64())

    def run(parts):
        for part in parts:
            dims, asks, out = part.column("dim").to_numpy(), part.column("asks").to_numpy(zero_copy_only=False), []
            ids = part.column("id").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _rows(part.column("vec").take(pa.array(at)))
                far, ask = cells[dim].of_candidates(x), asks[at]
                home = far.argmin(axis=1)
                wide = cells[dim].of_queries(x[ask])
                ask_home = wide.argmin(axis=1)
                for c in np.unique(np.concatenate([home, ask_home])).tolist():
                    mine = wide[ask_home == c, c]
                    if len(mine):
                        out.append((dim, c, len(mine), float(mine.max()), None, None))
                    inside = np.flatnonzero(home == c)
                    inside = inside[np.argsort(far[inside, c], kind="stable")]
                    _, first = np.unique(ids[at[inside]], return_index=True)
                    near = inside[np.sort(first)[:k + 1]]
                    out.extend((dim, c, None, None, int(i), float(d)) for i, d in zip(ids[at[near]], far[near, c]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)
    return run


class _Plan:
    """Groups of query cells of one vector length, and the rings of candidate cells that each needs."""

    def __init__(self, cells: _Cells, summary: list, k: int, count: int, group: int, split: int, first: int):
        n = len(cells.pivots)
        apart = np.sqrt(np.maximum(0, 2 * cells.most - 2 * (cells.pivots @ cells.pivots.T + np.outer(cells.lift, cells.lift))))
        reach, asked = np.zeros(n), np.zeros(n, np.int64)
        for s in summary:
            if s["queries"]:
                reach[s["cell"]], asked[s["cell"]] = s["reach"], s["queries"]
        near = [s for s in summary if s["id"] is not None]
        ids, cell, least = (np.array([s[c] for s in near]) for c in ("id", "cell", "far"))
        self.inner, self.outer = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        for i in np.flatnonzero(asked):
            bounds = reach[i] + apart[i, cell] + least
            order = np.argsort(bounds, kind="stable")
            heads = np.sort(np.unique(ids[order], return_index=True)[1])  # of each id its least bound
            limit = bounds[order[heads[k]]] if len(heads) > k else np.inf
            self.inner[i] = apart[i] - reach[i] - limit - cells.slack
            self.outer[i] = apart[i] + reach[i] + limit + cells.slack
        self.splits = max(1, -(-count // split))
        # Neighboring cells share a group; a cell of too many queries is dealt to several.
        self.first, self.parts, self.groups = np.full(n, -1), np.ones(n, np.int64), []
        at, held = first, 0
        order = [int(i) for i in np.argsort(apart[0], kind="stable") if asked[i]]
        for i in order:
            if held and held + asked[i] > group:
                at, held = at + 1, 0
            self.first[i], self.parts[i] = at, -(-asked[i] // group)
            for part in range(self.parts[i]):
                while len(self.groups) <= at - first + part:
                    self.groups.append([])
                self.groups[at - first + part].append(i)
            held += asked[i]
            if self.parts[i] > 1:
                at, held = at + int(self.parts[i]), 0
        self.base, self.next = first, first + len(self.groups)


def _deal(cells: dict[int, _Cells], plans: dict[int, _Plan], queries: bool):
    names = ["grp", "split", "id", "vec"]

    def run(parts):
        for part in parts:
            dims, mark = part.column("dim").to_numpy(), part.column("mark").to_numpy()
            rows, groups, splits = [], [], []
            for dim in np.unique(dims).tolist():
                plan, at = plans[dim], np.flatnonzero(dims == dim)
                x = _rows(part.column("vec").take(pa.array(at)))
                if queries:
                    home = cells[dim].of_queries(x).argmin(axis=1)
                    group = plan.first[home] + mark[at] % plan.parts[home]
                    for s in range(plan.splits):
                        rows.append(at)
                        groups.append(group)
                        splits.append(np.full(len(at), s))
                else:
                    far = cells[dim].of_candidates(x)
                    home = far.argmin(axis=1)
                    own = far[np.arange(len(at)), home]
                    for g, members in enumerate(plan.groups):
                        need = ((own >= plan.inner[np.ix_(members)][:, home]) & (own <= plan.outer[np.ix_(members)][:, home])).any(axis=0)
                        rows.append(at[need])
                        groups.append(np.full(need.sum(), plan.base + g))
                        splits.append(mark[at[need]] % plan.splits)
            if rows:
                at, group, split = (np.concatenate(v) for v in (rows, groups, splits))
                for lo in range(0, len(at), 20_000):
                    some = pa.array(at[lo:lo + 20_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group[lo:lo + 20_000].astype(np.int32)), pa.array(split[lo:lo + 20_000].astype(np.int32)),
                         part.column("id").take(some), part.column("vec").take(some)], names)
    return run


def _solve(k: int):
    def run(asks: pa.Table, data: pa.Table) -> pa.Table:
        out = ([], [], [])
        if asks.num_rows and data.num_rows:
            data = data.sort_by("id")
            q, x = _rows(asks.column("vec")), _rows(data.column("vec"))
            if q.dtype != x.dtype:
                q, x = q.astype(np.int64), x.astype(np.int64)
            ask_ids, ids = asks.column("id").to_numpy(), data.column("id").to_numpy()
            step = max(1, (1 << 22) // len(ids))
            for lo in range(0, len(q), step):
                score = q[lo:lo + step] @ x.T
                for r, row in enumerate(score):
                    other = ids != ask_ids[lo + r]
                    last = len(row) - k - int((~other).sum())  # rows of the query's own id may be among the best
                    near = np.flatnonzero((row >= np.partition(row, last)[last]) & other if last > 0 else other)
                    near = near[np.argsort(-row[near], kind="stable")[:k]]
                    out[0].extend([ask_ids[lo + r]] * len(near))
                    out[1].extend(ids[near].tolist())
                    out[2].extend(int(v) for v in row[near])
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), out)})
    return run


def top_products(table: DataFrame, k: int = 5, query_step: int = 50, scale: int = 256, id_col: str = "vec_id",
                 vector_col: str = "embedding", pivots: int | None = None, group: int = GROUP, split: int = SPLIT) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` candidates of highest inner product of each query.

    Components are floor(scale * x) with x as double; queries are the rows
    whose id is divisible by ``query_step``, candidates all rows of another
    id.  Ties go to the smaller id; fewer than ``k`` candidates give fewer
    rows.  Vectors that are null, empty or hold null or non-finite components
    and rows without id take no part; vectors of different lengths are not
    compared.  A row that occurs twice is two candidates but one query; a
    query id with several vectors has its scores pooled.  ``pivots`` follow
    the square root of the number of vectors, up to ``MOST_PIVOTS``.
    """
    spark = table.sparkSession
    vec = F.col(vector_col)
    sound = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size(vec) > 0)
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = (table.where(F.coalesce(sound, F.lit(False)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), whole.alias("vec"))
            .withColumn("dim", F.size("vec")).withColumn("asks", F.col("id") % query_step == 0)
            .withColumn("mark", F.xxhash64("id").bitwiseAND(F.lit(0x7FFFFFFF))))
    base = materialize(rows, "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    # One row for each vector length, and at most ``pivots`` vectors of it.
    sizes = {r["dim"]: r for r in base.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("most")).collect()}
    nth = F.row_number().over(Window.partitionBy("dim").orderBy("mark", "id"))
    chosen: dict[int, list] = {}
    wanted = {d: pivots or min(MOST_PIVOTS, max(16, round(r["n"] ** 0.5))) for d, r in sizes.items()}
    for r in base.select("dim", "vec", "mark", "id").withColumn("nth", nth).where(F.col("nth") <= max(wanted.values(), default=1)).collect():
        if r["nth"] <= wanted[r["dim"]]:
            chosen.setdefault(r["dim"], []).append(r["vec"])
    cells = {d: _Cells(np.array(v), float(sizes[d]["most"])) for d, v in chosen.items()}
    partial = materialize(base.select("dim", "vec", "asks", "id").mapInArrow(
        _summaries(cells, k), "dim int, cell int, queries long, reach double, id long, far double"), "summaries")
    # k + 1 rows and one more for each pivot, whatever the number of vectors.
    close = F.row_number().over(Window.partitionBy("dim", "cell").orderBy("far", "id"))
    near = (partial.where("id is not null").groupBy("dim", "cell", "id").agg(F.min("far").alias("far"))
            .withColumn("close", close).where(F.col("close") <= k + 1).drop("close"))
    wide = partial.where("queries is not null").groupBy("dim", "cell").agg(F.sum("queries").alias("queries"), F.max("reach").alias("reach"))
    summary: dict[int, list] = {}
    for r in wide.unionByName(near, allowMissingColumns=True).collect():
        summary.setdefault(r["dim"], []).append(r)
    plans, first = {}, 0
    for d in sorted(summary):
        plans[d] = _Plan(cells[d], summary[d], k, sizes[d]["n"], group, split, first)
        first = plans[d].next
    kind = "grp int, split int, id long, vec array<long>"
    sent = base.select("dim", "mark", "id", "vec").mapInArrow(_deal(cells, plans, False), kind)
    asked = base.where("asks").select("dim", "mark", "id", "vec").dropDuplicates(["id", "vec"]).mapInArrow(_deal(cells, plans, True), kind)
    local = asked.groupBy("grp", "split").cogroup(sent.groupBy("grp", "split")).applyInArrow(
        _solve(k), "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
