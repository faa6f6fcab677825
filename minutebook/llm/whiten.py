"""Whitening of embeddings by an incremental eigendecomposition.

Every task keeps the spectrum -- mean, eigenvalues, eigenvectors of the
scatter matrix -- of the vectors it has seen.  One more vector changes the
scatter by a centred rank-one term, and the new spectrum follows from the
secular equation: its roots lie between the old eigenvalues, its vectors are
those of a diagonal matrix plus a rank-one term.  Entries without weight and
equal eigenvalues are deflated, and the weights are recomputed from the roots,
so eigenvectors stay orthogonal.  Two spectra are combined by adding the terms
of one, and the difference of the means, to the other; tasks' spectra fold in
a tree of small groups.  A last pass over all vectors projects them on the
basis found, and the eigenproblem of that projection (Rayleigh-Ritz) removes
what rounding has left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutebook.llm.common import materialize, ship

ship(__name__)

EPS = float(np.finfo(float).eps)
FAN = 16


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z_j^2 / (d_j - x)), rho > 0, d rising: (roots, matrix of d_j - root_i to full precision).

    Each root is sought as an offset from its nearer pole, by interpolation
    with the two poles around it; steps that leave the bracket are halved.
    """
    k = len(d)
    w = rho * z * z
    gap = np.append(d[1:] - d[:-1], w.sum())
    middle = d + gap / 2
    with np.errstate(divide="ignore"):
        right = 1 + (1 / (d - middle[:, None])) @ w < 0
    right[-1] = False
    origin = np.where(right, np.append(d[1:], d[-1]), d)
    apart = d - origin[:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    high[-1] = gap[-1]
    x = (low + high) / 2
    rows = np.arange(k)
    mine, after = (rows[:, None] >= rows).astype(float), np.minimum(rows + 1, k - 1)
    for _ in range(80):
        away = apart - x[:, None]
        # All sums have the same weights, so they are products with them: of the poles up to the root, and of all.
        inverse = 1 / away
        below = inverse * mine
        left, left_slope = below @ w, (below * inverse) @ w
        over, over_slope = inverse @ w - left, (inverse * inverse) @ w - left_slope
        over[-1] = over_slope[-1] = 0.0
        value = 1 + left + over
        done = np.abs(value) <= EPS * (k + 4) * (1 + np.abs(left) + np.abs(over))
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        done |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        a, b = away[rows, rows], away[rows, after]
        s, t = a * a * left_slope, b * b * over_slope
        c = value - a * left_slope - b * over_slope
        p, q = c * (a + b) + s + t, a * b * value
        root = np.sqrt(np.maximum(0, p * p - 4 * q * c))
        with np.errstate(all="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step[-1] = a[-1] + s[-1] / c[-1]
        new = x + step
        with np.errstate(invalid="ignore"):
            inside = (new > low) & (new < high)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return origin + x, apart - x[:, None]


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (rising values, vectors as columns) of q diag(d) q' + rho v v'."""
    z = v @ q
    size = rho * float(z @ z)
    if not size > 0:
        return d, q
    least = 8 * EPS * max(float(d[-1]), size)
    close = np.flatnonzero(d[1:] - d[:-1] <= least)
    if len(close):  # equal eigenvalues: turn their vectors until one of them has all the weight
        q = q.copy()
        for i in close:
            r = float(np.hypot(z[i], z[i + 1]))
            if r > 0:
                c, s = z[i + 1] / r, z[i] / r
                q[:, [i, i + 1]] = np.stack([c * q[:, i] - s * q[:, i + 1], s * q[:, i] + c * q[:, i + 1]], axis=1)
                z[i], z[i + 1] = 0.0, r
    live = rho * np.abs(z) * np.sqrt(size / rho) > least
    if not live.any():
        return d, q
    at, e = d[live], z[live]
    roots, away = secular_roots(at, e, rho)
    k = len(at)
    # Weights for which the roots found are exact: vectors made of them are orthogonal.
    ratio = -away.T
    rows = np.arange(k)
    base = np.where(rows[:, None] > rows, at, np.append(at[1:], 0.0)) - at[:, None]
    base[:, -1] = rho
    weight = np.sqrt(np.abs(np.prod(ratio / base, axis=1))) * np.where(e < 0, -1.0, 1.0)
    inner = weight / away
    inner /= np.sqrt((inner * inner).sum(axis=1, keepdims=True))
    values, vectors = d.copy(), q.copy()
    values[live], vectors[:, live] = roots, q[:, live] @ inner.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, mean and eigendecomposition of the scatter of vectors of one length."""

    def __init__(self, size: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(size), np.zeros(size), np.eye(size)

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        self.n += 1
        self.values, self.vectors = rank_one(self.values, self.vectors, off, (self.n - 1) / self.n)
        self.mean = self.mean + off / self.n

    def combine(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        n = self.n + other.n
        if n:
            off = other.mean - self.mean
            self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n * other.n / n)
            self.mean, self.n = self.mean + off * (other.n / n), n


def _matrix(column) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix of whole numbers."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), -1)


_STATE = "part int, n long, high array<long>, low array<long>, mean array<double>, vals array<double>, vecs array<double>"


def _state(part: int, n: int, high, low, s: Spectrum) -> list:
    return [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([high], pa.list_(pa.int64())), pa.array([low], pa.list_(pa.int64())),
            *(pa.array([v], pa.list_(pa.float64())) for v in (s.mean, s.values, s.vectors.ravel()))]


_STATE_NAMES = ["part", "n", "high", "low", "mean", "vals", "vecs"]


def _decompose(parts):
    """The spectrum of a task's vectors, and their exact sums in two halves."""
    from pyspark import TaskContext
    found = None
    for part in parts:
        if part.num_rows:
            x = _matrix(part.column("x"))
            if found is None:
                found, high, low = Spectrum(x.shape[1]), np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)
            high, low = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
            for row in x.astype(np.float64):
                found.add(row)
    if found is not None:
        yield pa.RecordBatch.from_arrays(_state(TaskContext.get().partitionId(), found.n, high, low, found), _STATE_NAMES)


def _combined(table: pa.Table) -> pa.Table:
    whole, high, low = None, 0, 0
    for row in table.sort_by("part").to_pylist():
        one = Spectrum(len(row["mean"]))
        one.n, one.mean, one.values = row["n"], np.array(row["mean"]), np.array(row["vals"])
        one.vectors = np.array(row["vecs"]).reshape(len(row["mean"]), -1)
        if whole is None:
            whole, first = one, row["part"]
        else:
            whole.combine(one)
        high, low = high + np.array(row["high"]), low + np.array(row["low"])
    return pa.Table.from_arrays(_state(first, whole.n, high, low, whole), _STATE_NAMES)


def _summed(table: pa.Table) -> pa.Table:
    rows = table.sort_by("part").to_pylist()
    total = np.sum([r["sums"] for r in rows], axis=0)
    return pa.table({"part": pa.array([rows[0]["part"]], pa.int32()), "sums": pa.array([total], pa.list_(pa.float64()))})


def folded(states: DataFrame, fold, kind: str, name: str) -> dict | None:
    """One row from one row for each task: groups of ``FAN`` are folded until one is left."""
    states = materialize(states, name)
    left = states.count()
    while left > 1:
        groups = -(-left // FAN)
        states = materialize(states.groupBy(F.pmod("part", F.lit(groups)).alias("_g")).applyInArrow(fold, kind)
                             .withColumn("part", F.pmod("part", F.lit(groups)).cast("int")), name)
        left = states.count()
    row = states.first()
    return row.asDict() if row else None


def _projected(mean: np.ndarray, basis: np.ndarray):
    """Sums of products of the centred vectors' coordinates in the basis, and of the coordinates."""
    def run(parts):
        from pyspark import TaskContext
        products, sums = np.zeros((basis.shape[1],) * 2), np.zeros(basis.shape[1])
        for part in parts:
            if part.num_rows:
                y = (_matrix(part.column("x")).astype(np.float64) - mean) @ basis
                products += y.T @ y
                sums += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([np.append(products.ravel(), sums)], pa.list_(pa.float64()))], ["part", "sums"])
    return run


class Whitening:
    """What whitened values are made of: number and sums of the fit list, components as columns, their variances."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, trace: float, error: float):
        self.n, self.sums, self.components, self.values, self.trace, self.error = n, sums, components, values, trace, error
        self.mean = np.array([s / n for s in sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if most ** 2 * x.shape[1] < 1 << 62:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        found = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [f if f < 1 << 63 else None for f in found]

    def scale(self) -> np.ndarray:
        return np.array([1 / np.sqrt(v) if v > 0 else 0.0 for v in self.values])


def fit(spectra_of: DataFrame, most: int) -> Whitening | None:
    """The first ``most`` components of the distinct vectors ``x`` of one length."""
    state = folded(spectra_of.select("x").mapInArrow(_decompose, _STATE), _combined, _STATE, "spectra")
    if state is None:
        return None
    n, size = state["n"], len(state["mean"])
    sums = [(h << 32) + l for h, l in zip(state["high"], state["low"])]
    mean = np.array([s / n for s in sums])
    kind = "part int, sums array<double>"

    def covariance(basis: np.ndarray, name: str) -> np.ndarray:
        got = np.array(folded(spectra_of.select("x").mapInArrow(_projected(mean, basis), kind), _summed, kind, name)["sums"])
        k = basis.shape[1]
        off = got[k * k:] / n
        return got[:k * k].reshape(k, k) / n - np.outer(off, off)

    basis, _ = np.linalg.qr(np.array(state["vecs"]).reshape(size, -1)[:, ::-1])
    small = covariance(basis, "projected")
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1], basis @ turn[:, ::-1]
    vectors /= np.sqrt((vectors ** 2).sum(axis=0))
    kept = min(most, size)
    trace = float(np.trace(small))
    values = np.where(values > size * EPS * max(values[0], 0.0), values, 0.0)[:kept]
    made = Whitening(n, sums, vectors[:, :kept], values, trace, 0.0)
    live = values > 0
    if live.any():
        white = covariance((made.components * made.scale())[:, live], "whitened")
        made.error = float(np.abs(white - np.eye(len(white))).max())
    return made


def _apply(model: Whitening, id_name: str):
    def run(parts):
        k = len(model.values)
        explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
        for part in parts:
            x = _matrix(part.column("x")) if part.num_rows else np.zeros((0, len(model.sums)), np.int64)
            white = ((x.astype(np.float64) - model.mean) @ model.components) * model.scale()
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                part.column(id_name).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(rows), model.n), pa.int64()), pa.array(model.deviations(x), pa.int64()).take(pa.array(rows)),
                pa.array(white.ravel(), pa.float64()), pa.array(np.tile(explained, len(x)), pa.float64()),
                pa.array(np.full(len(rows), model.error), pa.float64())],
                [id_name, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(table: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    An entry c counts as the whole number floor(scale * c); the components are
    those of the covariance of all different vectors, each once, numbered by
    falling variance.  Vectors that are null or empty or hold a null or
    non-finite entry are dropped; null and repeated ids are carried along and
    each row has its own results.  Vectors of different lengths are
    whitened apart, each length with its own mean and components, the lengths
    one after the other.  A component whose variance is no more than rounding,
    as of equal vectors, gives 0 for whitened and explained and does not count
    for identity_error.  A deviation that a long cannot hold is null.  An
    empty table gives none.  Other columns are not looked at.

    The driver sees one spectrum at a time: the square of the vector length.
    """
    vec = F.col(vector_col)
    sound = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size(vec) > 0)
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = (table.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("_id"), whole.alias("x")).withColumn("dim", F.size("x")))
    kind = rows.schema["_id"].dataType.simpleString()
    distinct = materialize(rows.groupBy("dim", "x").agg(F.lit(1).alias("one")).select("dim", "x"), "vectors")
    out = None
    for dim in sorted(r["dim"] for r in distinct.select("dim").distinct().collect()):
        model = fit(distinct.where(F.col("dim") == dim), components)
        made = rows.where(F.col("dim") == dim).select("_id", "x").mapInArrow(
            _apply(model, "_id"), f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
        out = made if out is None else out.union(made)
    if out is None:
        out = table.sparkSession.createDataFrame(
            [], f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("_id", id_col)
