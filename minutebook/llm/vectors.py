"""Near-duplicate vectors by sorted projection passes.

A pass orders the vectors of a label lexicographically by concatenated random
hashes and compares each with the ``window`` vectors that follow it.  A hash
is the random direction, of 32 and their opposites, nearest to the vector
after the label's mean is taken off, so vectors that share a large common part
are told apart by the rest.  Pairs that reach the cosine join components, and
the links inside a component are then counted exactly, block by block, so a
group of near copies wider than any window loses nothing and a link found in
several passes counts once.

How many passes and how wide a window a label needs follows from its own
hashes: the sizes of the groups that one, two and three hashes leave, and how
often a pair of just the least cosine, its common part taken off, shares a
hash.  Windows are used where they are expected to lose fewer than ``miss`` of
such pairs for work in proportion to that of comparing all; small labels and
labels in which hashes cannot tell vectors apart are compared whole, which is
the exact way for what windows cannot decide.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minutebook.llm.common import components, materialize, partitions, ship

ship(__name__)

BLOCK, SLICE = 4096, 1024
DIRECT = 1024  # labels up to this size are compared whole
UNIT = 4096  # neighbors in a sorted pass that one group holds; windows are no wider
DIRECTIONS, HASHES = 32, 3
PASS_COST = 400  # comparisons that are as dear as sorting and sending a vector once
PATIENCE = 4  # passes may cost so many times as much as comparing all: their work grows with the label, not its square
MISS = 1e-4


def _matrix(column) -> np.ndarray:
    """Vectors of equal length as unit rows in double precision, however large or small their entries."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(chunk), -1) if len(chunk) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row the first row that links reach from it."""
    root, seen = np.arange(len(near)), ~near.any(axis=1)
    for i in np.flatnonzero(~seen):
        if not seen[i]:
            seen[i] = True
            front = np.array([i])
            while len(front):
                found = np.flatnonzero(near[front].any(axis=0) & ~seen)
                seen[found] = True
                root[found] = i
                front = found
    return root


def _compare(least: float):
    """Members of each unit that have links in it: how many, and the first member that they reach."""
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("unit", "ascending"), ("own", "ascending"), ("id", "ascending")])
        unit = part.column("unit").to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])
        ids, copies, own = (part.column(c).to_numpy() for c in ("id", "copies", "own"))
        alike = part.column("alike").to_numpy(zero_copy_only=False)
        links, root = np.zeros(len(ids), np.int64), ids.copy()
        for lo, hi in zip(cut[:-1], cut[1:]):
            x = _matrix(part.column("vec").slice(lo, hi - lo))
            n = hi - lo
            rows = n if alike[lo] else int(np.searchsorted(own[lo:hi], own[lo], "right"))
            other = 0 if alike[lo] else rows
            near = np.zeros((n, n), bool)
            for first in range(0, rows, SLICE):
                last = min(rows, first + SLICE)
                near[first:last, other:] = x[first:last] @ x[other:].T >= least
            if alike[lo]:
                np.fill_diagonal(near, False)
            near |= near.T
            for first in range(0, n, SLICE):
                links[lo:hi][first:first + SLICE] = near[first:first + SLICE].astype(np.float64) @ copies[lo:hi]
            root[lo:hi] = ids[lo:hi][_forest(near)]
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "links": links[some], "root": root[some]})
    return run


@cache
def shared_hash(cosine: float) -> float:
    """How often two vectors of this cosine have the same nearest direction; measured on fixed random draws."""
    rng = np.random.default_rng(17)
    x, z = rng.normal(size=(2, 4000, DIRECTIONS))
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * z
    a, b = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1)
    rows = np.arange(len(x))
    return float(((a == b) & (x[rows, a] * y[rows, a] > 0)).mean())


def pass_plan(n: int, spread: float, groups: list[float], cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(passes, window) for a label of n vectors, (0, 0) if comparing all is much cheaper.

    ``spread`` is the mean square distance of unit vectors from their mean,
    ``groups`` the mean size of the group a vector is in after 1, 2, 3 hashes.
    """
    best, cheapest = (0, 0), PATIENCE * n / 2
    rest = 1 - (1 - cosine) / spread if spread > 0 else -1.0
    if n <= DIRECT or rest <= 0:
        return best
    p, sizes = shared_hash(round(rest, 3)), [float(n), *groups]
    for window in (64, 128, 256, 512, 1024, 2048, UNIT):
        level = max(i for i, size in enumerate(sizes) if size >= min(window, n))
        luck = min(1.0, window / sizes[level])
        q = p ** level * luck if level == HASHES else p ** (level + 1) + (p ** level - p ** (level + 1)) * luck
        passes = max(1, int(np.ceil(np.log(miss) / np.log1p(-min(q, 1 - 1e-9))))) if q > 0 else 1 << 30
        cost = passes * (1.5 * window + PASS_COST)
        if cost < cheapest:
            best, cheapest = (passes, window), cost
    return best


def _directions(size: int, number: int) -> np.ndarray:
    return np.random.default_rng([29, size, number]).normal(size=(size, HASHES * DIRECTIONS))


def _hashes(parts):
    """A row for each vector and pass of its label: the concatenated hashes."""
    names = ["label", "dim", "pass", "key", "node"]
    for part in parts:
        dims, passes = part.column("dim").to_numpy(), part.column("passes").to_numpy()
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            some = part.take(pa.array(at))
            off = _matrix(some.column("vec")) - some.column("mean").flatten().to_numpy().reshape(len(at), -1)
            for t in range(int(passes[at].max())):
                mine = np.flatnonzero(passes[at] > t)
                y = (off[mine] @ _directions(dim, t)).reshape(len(mine), HASHES, DIRECTIONS)
                best = np.abs(y).argmax(axis=2)
                sign = np.take_along_axis(y, best[:, :, None], axis=2)[:, :, 0] > 0
                symbol = best * 2 + sign
                key = np.zeros(len(mine), np.int64)
                for h in range(HASHES):
                    key = key * (2 * DIRECTIONS) + symbol[:, h]
                rows = pa.array(mine)
                yield pa.RecordBatch.from_arrays([
                    some.column("label").take(rows), some.column("dim").take(rows), pa.array(np.full(len(mine), t, np.int32)),
                    pa.array(key), some.column("node").take(rows)], names)


def _sums(parts):
    """Sums of the unit vectors of each label of a batch."""
    for part in parts:
        dims, out = part.column("dim").to_numpy(), []
        labels = part.column("label").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            x = _matrix(part.column("vec").take(pa.array(at)))
            names, code = np.unique(labels[at].astype(str), return_inverse=True)
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(names)))
            sums = np.add.reduceat(x[order], starts, axis=0)
            out.extend((n, dim, s) for n, s in zip(names.tolist(), sums))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()),
                                          pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["label", "dim", "sums"])


def _planned(cosine: float, miss: float, passes: int | None, window: int | None):
    def run(parts):
        for part in parts:
            found = []
            for r in part.to_pylist():
                if passes is None or window is None:
                    found.append(pass_plan(r["n"], r["spread"], [r["g1"], r["g2"], r["g3"]], cosine, miss))
                else:
                    found.append((passes, min(window, UNIT)))
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), part.column("mean"),
                                              pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32())],
                                             ["label", "dim", "mean", "passes", "window"])
    return run


def _lowest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Lets the rows that links a-b connect have one root, the least of theirs."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (root[a], root[b], a, b):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _windows(cosine: float):
    """Links of each unit's rows with the rows that follow them, as a forest."""
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        nodes, window, dims, turns = (part.column(c).to_numpy() for c in ("node", "window", "dim", "pass"))
        labels = part.column("label").to_numpy(zero_copy_only=False)
        new = (labels[1:] != labels[:-1]) | (turns[1:] != turns[:-1]) | (dims[1:] != dims[:-1])
        cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(nodes)]])
        root = np.arange(len(nodes))
        for lo, hi in zip(cut[:-1], cut[1:]):
            x, w = _matrix(part.column("vec").slice(lo, hi - lo)), int(window[lo])
            for i in range(0, hi - lo, w):
                near = x[i:i + w] @ x[i:i + 2 * w].T >= cosine
                a, b = np.nonzero(np.triu(near, 1))
                if len(a):
                    root = _lowest(len(root), lo + i + a, lo + i + b, root)
        some = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": nodes[some], "b": nodes[root[some]]})
    return run


def _window_links(nodes: DataFrame, plans: DataFrame, cosine: float) -> DataFrame:
    """Links that the passes of the planned labels find: (a, b), as forests of small stretches."""
    spark = nodes.sparkSession
    hashed = nodes.join(plans, ["label", "dim"]).select("label", "dim", "vec", "mean", "passes", "node").mapInArrow(
        _hashes, "label string, dim int, pass int, key long, node long")
    order = ["label", "dim", "pass", "key", "node"]
    number = F.monotonically_increasing_id()
    ordered = materialize(hashed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(
        "label", "dim", "pass", "node", F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "ordered")
    # One number for each range partition.
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("part", F.coalesce(earlier, F.lit(0)).alias("before"))
    placed = (ordered.join(F.broadcast(before), "part").join(plans.select("label", "dim", "window"), ["label", "dim"])
              .withColumn("pos", F.col("before") + F.col("row")).withColumn("unit", F.expr(f"pos div {UNIT}")))
    early = F.col("pos") % UNIT < F.col("window")
    units = placed.withColumn("unit", F.explode(F.when(early, F.array("unit", F.col("unit") - 1)).otherwise(F.array("unit"))))
    with_vectors = units.select("unit", "pos", "label", "dim", "pass", "window", "node").join(nodes.select("node", "vec"), "node")
    return with_vectors.groupBy("unit").applyInArrow(_windows(cosine), "a long, b long")


def _plans(nodes: DataFrame, sizes: DataFrame, cosine: float, miss: float, passes: int | None, window: int | None) -> DataFrame:
    """(label, dim, mean, passes, window) of the labels that passes serve better than comparing all."""
    large = nodes.join(sizes.where(F.col("members") > DIRECT), ["label", "dim"])
    sums = large.select("label", "dim", "vec").mapInArrow(_sums, "label string, dim int, sums array<double>")
    means = (sums.select("label", "dim", F.posexplode("sums").alias("at", "x")).groupBy("label", "dim", "at").agg(F.sum("x").alias("x"))
             .groupBy("label", "dim").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs")).join(sizes, ["label", "dim"])
             .select("label", "dim", F.col("members").alias("n"), F.transform("xs", lambda s: s["x"] / F.col("members")).alias("mean")))
    means = materialize(means.withColumn("spread", 1 - F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)), "means")
    trial = large.join(means.select("label", "dim", "mean"), ["label", "dim"]).withColumn("passes", F.lit(1)).select(
        "label", "dim", "vec", "mean", "passes", "node").mapInArrow(_hashes, "label string, dim int, pass int, key long, node long")
    step = 2 * DIRECTIONS
    level = F.explode(F.array(*[F.struct(F.lit(h + 1).alias("h"), F.expr(f"key div {step ** (HASHES - 1 - h)}").alias("k")) for h in range(HASHES)]))
    square = F.col("c").cast("double") * F.col("c")
    groups = (trial.select("label", "dim", level.alias("l")).groupBy("label", "dim", "l.h", "l.k").agg(F.count("*").alias("c"))
              .groupBy("label", "dim").agg(*(F.sum(F.when(F.col("h") == h, square)).alias(f"s{h}") for h in range(1, HASHES + 1))))
    known = means.join(groups, ["label", "dim"]).select(
        "label", "dim", "mean", "n", "spread", *((F.col(f"s{h}") / F.col("n")).alias(f"g{h}") for h in range(1, HASHES + 1)))
    planned = known.mapInArrow(_planned(cosine, miss, passes, window), "label string, dim int, mean array<double>, passes int, window int")
    return materialize(planned.where("passes > 0"), "plans")


def _exact(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(id, links, root) of all links inside each group; members: (grp, dim, node, vec, copies).

    Groups of up to ``block`` vectors are packed several to a task; larger
    ones are dealt to blocks by hash, each pair of blocks a task of its own.
    """
    sizes = materialize(members.groupBy("grp", "dim").agg(F.count("*").alias("members")), "sizes")
    packed = sizes.where(F.col("members") <= block).agg(F.sum("members")).first()[0] or 0
    placed = (members.join(sizes, ["grp", "dim"]).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
              .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    units = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.col("node").alias("id"), "vec", "copies", "own", "blocks", (F.col("own") == F.col("with")).alias("alike"),
        F.concat_ws("/", "dim", F.least("own", "with"), F.greatest("own", "with"), "grp").alias("unit"))
    bin_ = F.pmod(F.xxhash64("unit"), F.lit(max(1, -(-packed // SLICE)))).cast("string")
    return materialize(units.withColumn("bin", F.when(F.col("blocks") > 1, F.col("unit")).otherwise(bin_)).drop("blocks")
                       .groupBy("bin").applyInArrow(_compare(cosine), "id long, links long, root long"), "links")


def near_duplicate_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                           cosine: float = 0.98, passes: int | None = None, window: int | None = None, block: int = BLOCK,
                           miss: float = MISS) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null; a link is a
    cosine of ``cosine`` or more in double precision.  n_links counts the
    other vectors linked directly, component_id is the least id reachable by
    links, kept tells whether it is the vector's own.  Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without label
    or id, link with nothing.  Every row is a vector of its own, also where
    ids repeat: rows of one id need not be linked.  Equal vectors are
    folded before the comparison and counted after it; vectors of different
    lengths never link.  Other columns are not looked at.

    ``passes`` and ``window``, given together, replace the plan that each label
    of more than ``DIRECT`` vectors gets from its hashes.
    """
    kind = table.schema[vector_col].dataType.simpleString()
    vec = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    sound = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"),
                        F.coalesce(sound, F.lit(False)).alias("sound"))
    usable = rows.where("sound and id is not null and label is not null").select("id", "label", "vec")
    nodes = materialize(usable.groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
                        .select("label", "vec", "least", "copies", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("node")), "vectors")
    sizes = materialize(nodes.groupBy("label", "dim").agg(F.count("*").alias("members")), "sizes")
    plans = _plans(nodes, sizes, cosine, miss, passes, window)
    near = components(_window_links(nodes, plans, cosine))
    in_label = F.concat(F.lit("l/"), "label")
    whole = nodes.join(plans.select("label", "dim"), ["label", "dim"], "left_anti").withColumn("grp", in_label)
    linked = nodes.join(near, "node").withColumn("grp", F.concat(F.lit("c"), F.col("component").cast("string"), F.lit("/"), "label"))
    columns = ["grp", "dim", "node", "vec", "copies"]
    found = _exact(materialize(whole.select(*columns).union(linked.select(*columns)), "members"), cosine, block)
    classes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_node = materialize(nodes.drop("dim").join(classes, "node", "left").join(counted, F.col("node") == F.col("id"), "left").select(
        "label", "vec", "least", "copies", F.coalesce("component", "node").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "nodes")
    lowest = per_node.groupBy("component").agg(F.min("least").alias("component_id"))
    known = per_node.join(lowest, "component")
    # A hash narrows the join key; the vectors themselves decide.
    left = rows.withColumn("mark", F.when(F.col("sound"), F.xxhash64("label", "vec")))
    right = known.select(F.xxhash64("label", "vec").alias("mark_"), F.col("label").alias("label_"), F.col("vec").alias("vec_"),
                         "component_id", "links")
    joined = left.join(right, (F.col("mark") == F.col("mark_")) & (F.col("label") == F.col("label_")) & (F.col("vec") == F.col("vec_"))
                       & F.col("id").isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), (component == F.col("id")).alias("kept"))
