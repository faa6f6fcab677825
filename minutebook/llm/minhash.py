"""Near-duplicate texts by DartMinHash signatures.

A text is the multiset of its runs of ``n`` words (texts of fewer words: the
one run of all their words).  The k-th copy of a run is an element region of
weight one.  Hashed darts fall into every region as a Poisson process over
rank: a dart has a rank and one of the signature's coordinates.  Each
coordinate keeps its dart of least rank, so two texts agree in a coordinate
with exactly their weighted Jaccard similarity.  Only darts below a rank
limit, set by the total weight of the text, are ever drawn; the rare texts
with an empty coordinate draw again below twice the limit.

Signatures are cut into bands.  Texts that share a band are joined under the
least of them, which gives candidate clusters without listing pairs.  Inside a
cluster, exact similarities come from products of blocks of the region
matrix.  Members of large clusters first meet their band leaders; what these
links leave outside the largest class is cut into blocks and compared with
every block of the cluster, one pair of blocks to a group.  Only a forest of
the verified links leaves a unit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutebook.llm import wordhash as W
from minutebook.llm.common import components, materialize, ship, text_bytes

ship(W.__name__)
ship(__name__)

U = np.uint64
BANDS, ROWS = 36, 6
BLOCK = 1024
LEADERS = 4  # for large clusters, compared first; the rest of the cluster is compared after them


def _regions(texts: list[bytes], n: int):
    """(doc, region, total weight per text) of all texts; region hashes hold the copy number."""
    t = W.Texts(texts)
    counts = np.diff(t.bounds)
    runs = W.hash_runs(t.words, n)
    whole = t.room()[:len(runs)] >= n
    short = np.flatnonzero((counts > 0) & (counts < n))
    value = np.concatenate([runs[whole], W.sequence_hash(t.words, t.bounds[short], t.bounds[short + 1])])
    doc = np.concatenate([t.doc[:len(runs)][whole], short]).astype(np.int64)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (value[1:] == value[:-1])
    at = np.arange(len(doc))
    copy = at - np.maximum.accumulate(np.where(same, 0, at))
    again = copy > 0
    value[again] = W.mix(value[again] + copy[again].astype(U) * U(0xD1342543DE82EF95))
    return doc, value, np.bincount(doc, minlength=len(texts))


def signatures(texts: list[bytes], n: int = 5, size: int = BANDS * ROWS) -> np.ndarray:
    """(texts, size) dart numbers; all zero for a text without words."""
    doc, region, weight = _regions(texts, n)
    out = np.zeros((len(texts), size), U)
    todo = weight > 0
    limit = np.where(todo, size * (np.log(size) + 2.0) / np.maximum(weight, 1), 0.0)
    while todo.any():
        use = todo[doc]
        d, r = doc[use], region[use]
        rank = np.zeros(len(d))
        ranks, keys, darts, throw = [], [], [], 0
        while len(d):
            throw += 1
            h = W.mix(r + U(throw * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((h >> U(11)).astype(np.float64) + 1.0) * 2.0 ** -53)
            hit = rank <= limit[d]
            d, r, rank, h = d[hit], r[hit], rank[hit], h[hit]
            dart = W.mix(h ^ U(0xA0761D6478BD642F))
            ranks.append(rank)
            keys.append(d * size + (dart % U(size)).astype(np.int64))
            darts.append(dart | U(1))
        ranks, keys, darts = (np.concatenate(x) for x in (ranks, keys, darts))
        order = np.lexsort((darts, ranks))[::-1]
        found = np.zeros(len(texts) * size, U)
        found[keys[order]] = darts[order]  # the last one written has the least rank
        found = found.reshape(len(texts), size)
        done = todo & (found != 0).all(axis=1)
        out[done] = found[done]
        todo &= ~done
        limit *= 2
    return out


def _sign(n: int, bands: int, rows: int):
    def run(parts):
        salt = W.mix(np.arange(1, bands + 1, dtype=U))
        for part in parts:
            texts = part.column("_body").to_pylist()
            for first, some in W.batches(texts):
                s = signatures(some, n, bands * rows).reshape(len(some), bands, rows)
                keys = np.zeros((len(some), bands), U)
                for r in range(rows):
                    keys = W.mix(keys * U(0x9E3779B97F4A7C15) + s[:, :, r])
                keys ^= salt
                full = (s[:, 0, 0] != 0)
                flat = pa.array(keys.astype(np.int64).ravel() if len(keys) else [], pa.int64())
                sizes = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                if not full.all():
                    flat = pa.array(keys[full].astype(np.int64).ravel(), pa.int64())
                same = [xxhash.xxh3_128_digest(b" ".join(t.split())) for t in some]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").slice(first, len(some)), pa.array(same, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(sizes), flat)], ["_id", "same", "bands"])
    return run


def _forest(n: int, similarity: float):
    """Exact components of each unit of work among the rows of one bin."""
    share = similarity / (1 + similarity)

    def solve(docs: np.ndarray, regions: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
        order = np.argsort(regions, kind="stable")
        r, d = regions[order], docs[order]
        new = np.concatenate([[True], r[1:] != r[:-1]])
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        keep = sizes[group] > 1
        column = (np.cumsum(sizes > 1) - 1)[group[keep]]
        d = d[keep]
        shared = np.zeros((count, count), np.float64)
        width = max(1, (1 << 22) // count)
        cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            if lo < hi:
                matrix = np.zeros((count, width), np.float32)
                matrix[d[lo:hi], column[lo:hi] - i * width] = 1
                shared += matrix @ matrix.T
        need = share * (weight[:, None] + weight[None, :]) - 1e-9
        root = np.arange(count)
        linked = (shared >= need) & (shared > 0)
        seen = np.zeros(count, bool)
        for i in range(count):
            if not seen[i]:
                seen[i] = True
                front = np.array([i])
                while len(front):
                    near = np.flatnonzero(linked[front].any(axis=0) & ~seen)
                    seen[near] = True
                    root[near] = i
                    front = near
        return root

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("unit", "ascending"), ("_id", "ascending")])
        unit = part.column("unit").to_numpy()
        ids = part.column("_id").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])
        bodies, a, b = part.column("_body"), [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo > 1:
                doc, region, weight = _regions(bodies.slice(lo, hi - lo).to_pylist(), n)
                root = solve(doc, region, weight, hi - lo)
                other = np.flatnonzero(root != np.arange(hi - lo))
                a.append(ids[lo:hi][other])
                b.append(ids[lo:hi][root[other]])
        empty = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty)})
    return run


def _led(candidates: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """(node, unit, bin): texts of large clusters with the band leaders they share most bands with, in units of ``block``."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("shared", (-F.col("b")).alias("lead"))), asc=False), 1, LEADERS)
    pairs = (candidates.join(large.select(F.col("node").alias("a")), "a").groupBy("a").agg(best.alias("best"))
             .select("a", F.explode("best.lead").alias("lead")).select("a", (-F.col("lead")).alias("lead")))
    pieces = pairs.groupBy("lead").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"))
    dealt = pairs.join(pieces, "lead").select(
        "a", F.concat_ws("-", "lead", F.pmod(F.xxhash64("a", F.lit(7)), F.col("pieces"))).alias("unit"), "lead")
    units = dealt.select(F.col("a").alias("node"), "unit").union(dealt.select("lead", "unit").distinct())
    return units.select("node", "unit", F.col("unit").alias("bin"))


def _left_over(led: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """(node, unit, bin): pairs of blocks that hold every pair of texts of a large cluster, but for those inside its largest known class.

    Every unit is a group of its own, so a task holds two blocks at a time, however large the cluster.
    """
    joined = components(led).select("node", F.col("component").alias("class"))
    known = large.join(joined, "node", "left").withColumn("class", F.coalesce("class", "node"))
    counts = known.groupBy("component", "class").agg(F.count("*").alias("n"))
    main = counts.groupBy("component").agg(F.max(F.struct("n", "class")).alias("main")).select("component", "main.*")
    split = (known.join(main.withColumnRenamed("class", "main"), "component").where("n < members")
             .withColumn("rest", F.col("class") != F.col("main"))
             .withColumn("rests", F.ceil((F.col("members") - F.col("n")) / block).cast("int"))
             .withColumn("mains", F.ceil(F.col("n") / block).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int")))
    rest_block = F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("with")
    main_block = F.explode(F.sequence(F.lit(0), F.col("mains") - 1)).alias("with")
    left = split.where("rest")
    units = (left.select("node", "component", "own", rest_block)
             .select("node", F.concat_ws("-", "component", F.lit("r"), F.least("own", "with"), F.greatest("own", "with")).alias("unit"))
             .union(left.select("node", "component", "own", main_block)
                    .select("node", F.concat_ws("-", "component", F.lit("m"), "own", "with")))
             .union(split.where("not rest").select("node", "component", "own", rest_block)
                    .select("node", F.concat_ws("-", "component", F.lit("m"), "with", "own"))))
    return units.select("node", "unit", F.col("unit").alias("bin"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                    similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id_col, class_id) of every row: texts are of one class if links join them.

    Two texts are linked if their word sequences are equal or the weighted
    Jaccard similarity of their runs of ``n`` words is ``similarity`` or more;
    class_id is the least id of the class.  Band candidates find a pair of
    exactly that similarity with probability 1 - (1 - s^rows)^bands, 0.99998
    by default; every link is verified exactly.  Null and empty texts (or
    texts of white space alone) are linked with nothing, and rows without id
    keep a null class.  Rows that repeat an id form one text each and share
    the class of their id.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows_in = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_body"))
    signed = materialize(rows_in.where("_id is not null").mapInArrow(
        _sign(n, bands, rows), "_id long, same binary, bands array<long>"), "signatures")
    solid = signed.where(F.size("bands") > 0)
    copies = solid.groupBy("same").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"))
    copy_links = (solid.join(copies.where("copies > 1").select("same", "rep"), "same")
                  .where("_id <> rep").select(F.col("_id").alias("a"), F.col("rep").alias("b")))
    alone = solid.join(copies.select("same", F.col("rep").alias("_id")), ["same", "_id"], "left_semi")
    banded = alone.select("_id", F.explode("bands").alias("band"))
    leaders = (banded.groupBy("band").agg(F.min("_id").alias("lead"), F.max("_id").alias("last"))
               .where("lead < last").select("band", "lead"))
    candidates = materialize(banded.join(leaders, "band").where("_id <> lead")
                             .groupBy(F.col("_id").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("shared")), "candidates")
    clusters = components(candidates)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    placed = materialize(clusters.join(sizes, "component"), "clusters")

    def compare(units: DataFrame) -> DataFrame:
        # A shuffle join at every size: what a broadcast saves on small inputs would not last.
        return (rows_in.join(units.withColumnRenamed("node", "_id").hint("merge"), "_id")
                .groupBy("bin").applyInArrow(_forest(n, similarity), "a long, b long"))

    small = placed.where(F.col("members") <= block)
    bins = max(1, -(-small.count() // (2 * block)))
    whole = small.select("node", F.col("component").cast("string").alias("unit"),
                         F.pmod(F.xxhash64(F.col("component").cast("string")), F.lit(bins)).cast("string").alias("bin"))
    forest, large = compare(whole), placed.where(F.col("members") > block)
    if not large.isEmpty():
        led = materialize(compare(_led(candidates, large, block)), "led")
        forest = forest.union(led).union(compare(_left_over(led, large, block)))
    classes = components(forest.union(copy_links))
    named = docs.select(F.col(id_col)).join(classes.select(F.col("node").alias("_node"), F.col("component").alias("_class")),
                      F.col(id_col) == F.col("_node"), "left")
    return named.select(F.col(id_col), F.coalesce("_class", F.col(id_col)).alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` whose id is the least of its class, columns unchanged.

    Rows without words or without id stay; rows that repeat an id stay or go together.
    """
    classes = near_duplicates(docs, id_col, **options)
    gone = classes.where(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs[id_col] == gone["_gone"], "left_anti")
