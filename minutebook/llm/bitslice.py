"""Ranked lexical search over bit-sliced Bloom signatures.

The index.  A text's signature is a Bloom filter of its terms: one entry for
a term, and one more for each level of ``LEVELS`` that its frequency reaches.
Texts with about as many entries form a block of at most 1,024; a block is
stored by bit position, so a slice holds one bit of all its texts.  The slices
of a term, ANDed, mark every text that holds it, and a few more.  The index
also counts the texts that hold each term, all texts and all terms.

The search.  For each block, the marks of every query term at every level,
weighted and summed, bound the scores of its texts from above: a text marked
at one level but not at the next has a frequency below the next.  The sums are
whole numbers, so bounds are exact.  The texts of the highest bounds are scored
exactly first; the k-th best of them is a score to reach.  Then every text
whose bound reaches it, the smaller id deciding ties, is scored exactly from
its whole text.  Only what provably stays behind k others is left out.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minutebook.llm import wordhash as W
from minutebook.llm.common import materialize, ship, text_bytes

ship(W.__name__)
ship(__name__)

BITS, HASHES = 12, 4  # bits and positions of an entry
BLOCK_TEXTS, BLOCK_CELLS = 1_024, 1 << 24
HELD_TEXTS, HELD_TERMS = 1 << 14, 1 << 21  # what a task gathers before it forms blocks
CHUNK_TERMS, SLAB = 8_192, 2_048  # query terms of one run over the index, and of one product
LEVELS = np.unique([round(2 ** (k / 2)) for k in range(0, 62)] + [3])
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(body: bytes) -> list[bytes]:
    """Terms in order: runs of letters and digits of ASCII and of everything beyond it, A-Z in lower case."""
    return body.translate(TERM_BYTES).split()


def _entries(terms: np.ndarray, level: int | np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Bit positions of terms at a level: one row for each of the HASHES positions."""
    x = W.mix(terms + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return np.stack([((a + np.uint64(i) * b) % np.asarray(width, np.uint64)).astype(np.int64) for i in range(HASHES)])


class _Held:
    """Terms and frequencies of the texts a task has read and not yet put into blocks."""

    def __init__(self):
        self.ids, self.lengths, self.terms, self.counts, self.sizes, self.total = [], [], [], [], [], 0

    def add(self, ids: pa.Array, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Takes texts in; returns their different terms and the number of these texts that hold each."""
        t = W.Texts([b.translate(TERM_BYTES) for b in bodies])
        order = np.lexsort((t.words, t.doc))
        words, docs = t.words[order], t.doc[order]
        first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (docs[1:] != docs[:-1])]) if len(words) else [])
        counts = np.diff(np.append(first, len(words)))
        words, docs = words[first], docs[first]
        self.terms.append(words)
        self.counts.append(counts)
        self.sizes.append(np.bincount(docs, minlength=len(bodies)))
        self.lengths.append(np.diff(t.bounds))
        self.ids.append(ids)
        self.total += len(words)
        return np.unique(words, return_counts=True)

    def full(self) -> bool:
        return self.total >= HELD_TERMS or sum(map(len, self.lengths)) >= HELD_TEXTS

    def blocks(self):
        """(ids, lengths, width, greatest frequency, slices) of blocks of texts with about as many entries."""
        if not self.ids:
            return
        ids = pa.concat_arrays(self.ids)
        terms, counts, sizes, lengths = map(np.concatenate, (self.terms, self.counts, self.sizes, self.lengths))
        reached = np.searchsorted(LEVELS, counts, "right")
        starts = np.cumsum(sizes) - sizes
        sums = np.concatenate([[0], np.cumsum(reached)])
        entries = sums[starts + sizes] - sums[starts]
        order = np.argsort(entries, kind="stable")
        order = order[lengths[order] > 0]
        at = 0
        while at < len(order):
            most = 2 * entries[order[at]] + 16
            stop = at
            while stop < len(order) and stop - at < BLOCK_TEXTS and entries[order[stop]] <= most and (
                    stop - at < 8 or (stop - at) * BITS * entries[order[stop]] <= BLOCK_CELLS):
                stop += 1
            mine = order[at:stop]
            width = int(max(64, BITS * entries[mine[-1]]))
            pick = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in mine])
            text = np.repeat(np.arange(len(mine)), sizes[mine])
            times = reached[pick]
            term, text = np.repeat(terms[pick], times), np.repeat(text, times)
            ends = np.cumsum(times)
            level = LEVELS[np.arange(len(term)) - np.repeat(ends - times, times)]
            cells = np.zeros((width, -(-len(mine) // 8) * 8), bool)
            for position in _entries(term, level, width):
                cells[position, text] = True
            yield ids.take(pa.array(mine)), lengths[mine], width, int(counts[pick].max()), np.packbits(cells, axis=1).tobytes()
            at = stop


_INDEX = "ids array<{}>, lengths array<long>, width int, most long, slices binary, terms array<long>, holders array<long>"
_NAMES = ["ids", "lengths", "width", "most", "slices", "terms", "holders"]


def _index(parts):
    def block(ids, lengths, width, most, slices):
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([lengths.tolist()], pa.list_(pa.int64())),
            pa.array([width], pa.int32()), pa.array([most], pa.int64()), pa.array([slices], pa.binary()),
            pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))], _NAMES)

    def counted(terms, holders, kind):
        if not terms:
            return
        every, where = np.unique(np.concatenate(terms), return_inverse=True)
        sums = np.bincount(where, np.concatenate(holders)).astype(np.int64)
        for lo in range(0, len(every), 1 << 16):
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, pa.list_(kind)), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()),
                pa.nulls(1, pa.binary()), pa.array([every[lo:lo + (1 << 16)].view(np.int64)], pa.list_(pa.int64())),
                pa.array([sums[lo:lo + (1 << 16)]], pa.list_(pa.int64()))], _NAMES)

    held, terms, holders, size, kind = _Held(), [], [], 0, None
    for part in parts:
        ids, bodies = part.column("_id"), part.column("_body").to_pylist()
        kind = ids.type
        for at, some in W.batches(bodies, 4 << 20):
            new, n = held.add(ids.slice(at, len(some)), some)
            terms.append(new)
            holders.append(n)
            size += len(new)
            if held.full():
                for b in held.blocks():
                    yield block(*b)
                held = _Held()
            if size > 1 << 22:
                yield from counted(terms, holders, kind)
                terms, holders, size = [], [], 0
    for b in held.blocks():
        yield block(*b)
    yield from counted(terms, holders, kind)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored index of every whole text: rows of blocks and rows of term counts; null and empty texts have no terms.

    Terms are known by 64-bit hashes.  One pass over the texts, no exchange.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_body"))
    return materialize(rows.mapInArrow(_index, _INDEX.format(rows.schema["_id"].dataType.simpleString())), "slices")


class _Queries:
    """Items of one run: their terms with weights, and the totals that scores need."""

    def __init__(self, items: list[tuple], holders: dict[int, int], texts: int, length: int):
        self.texts, self.length = texts, length
        self.weights, hashes = [], {}
        for _, words in items:
            mine = {}
            for word, h in words:
                if h in holders:
                    mine[word] = math.floor(1000 * math.log((2 * texts + 2) / (2 * holders[h] + 1)))
                    hashes[h] = len(hashes) if h not in hashes else hashes[h]
            self.weights.append(mine)
        self.terms = np.array(list(hashes), np.int64).view(np.uint64)
        sums = max([sum(w.values()) for w in self.weights], default=0)
        self.matrix = np.zeros((len(items), len(hashes)), np.float32 if sums < 1 << 24 else np.float64)
        for i, (_, words) in enumerate(items):
            for word, h in words:
                if h in hashes:
                    self.matrix[i, hashes[h]] = self.weights[i][word]

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        return 50 + 50 * lengths * self.texts // max(1, self.length)

    def score(self, item: int, counts: Counter, length: int) -> int:
        m = 50 + 50 * length * self.texts // max(1, self.length)
        return sum(w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 20 * m)) for t, w in self.weights[item].items() if t in counts)

    def bounds(self, lengths: np.ndarray, width: int, most: int, slices: bytes) -> np.ndarray:
        """No score of an item (row) for a text (column) of the block is above this."""
        n = len(lengths)
        grid = np.frombuffer(slices, np.uint8).reshape(width, -1)
        m = 20 * self.damping(lengths)
        worth = lambda f: 1_000_000_000 * f // (1000 * f + m)
        out = np.zeros((len(self.matrix), n), np.int64)
        for lo in range(0, len(self.terms), SLAB):
            terms, weights, held = self.terms[lo:lo + SLAB], self.matrix[:, lo:lo + SLAB], None
            for k, level in enumerate(LEVELS):
                at = _entries(terms, level, width)
                marks = grid[at[0]] & grid[at[1]] & grid[at[2]] & grid[at[3]]
                if held is not None:
                    marks &= held
                some = np.flatnonzero(marks.any(axis=1)) if level <= most else []
                if not len(some):
                    break
                terms, weights, held = terms[some], weights[:, some], marks[some]
                sums = weights @ np.unpackbits(held, axis=1, count=n).astype(weights.dtype)
                below = min(most, LEVELS[k + 1] - 1) if k + 1 < len(LEVELS) else most
                out += (worth(np.int64(below)) - worth(np.int64(level - 1))) * np.rint(sums).astype(np.int64)
        return out


def _blocks(part):
    for ids, lengths, width, most, slices in zip(part.column("ids"), part.column("lengths"), part.column("width").to_pylist(),
                                                 part.column("most").to_pylist(), part.column("slices")):
        yield ids.values, lengths.values.to_numpy(), width, most, slices.as_buffer()


def _highest(queries: _Queries, k: int):
    """Of each item, the k texts of highest bound among all blocks of a task."""
    def run(parts):
        best = [(np.zeros(0, np.int64), None)] * len(queries.weights)
        kind = None
        for part in parts:
            kind = part.schema.field("ids").type.value_type
            for ids, lengths, *block in _blocks(part):
                bound = queries.bounds(lengths, *block)
                top = np.argpartition(-bound, k - 1, axis=1)[:, :k] if len(lengths) > k else np.tile(np.arange(len(lengths)), (len(bound), 1))
                for i in range(len(bound)):
                    mine = top[i][bound[i, top[i]] > 0]
                    if len(mine):
                        values, names = best[i]
                        values = np.concatenate([values, bound[i, mine]])
                        taken = ids.take(pa.array(mine))
                        names = taken if names is None else pa.concat_arrays([names, taken])
                        keep = np.argsort(-values, kind="stable")[:k]
                        best[i] = values[keep], names.take(pa.array(keep))
        some = [i for i, (v, _) in enumerate(best) if len(v)]
        if some:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(some, [len(best[i][0]) for i in some]), pa.int32()), pa.concat_arrays([best[i][1] for i in some]),
                pa.array(np.concatenate([best[i][0] for i in some]))], ["item", "_id", "bound"])
    return run


def _reaching(queries: _Queries, goals: list[tuple[int, object]], whole_ids: bool):
    """Every text of a block whose bound reaches the goal of an item."""
    score = np.array([g for g, _ in goals], np.int64)
    last = np.array([i if i is not None else np.iinfo(np.int64).max for _, i in goals], np.int64) if whole_ids else None

    def run(parts):
        for part in parts:
            for ids, lengths, *block in _blocks(part):
                bound = queries.bounds(lengths, *block)
                reach = bound >= np.maximum(1, score)[:, None]
                if whole_ids:
                    own = ids.to_numpy(zero_copy_only=False) if not ids.null_count else ids.fill_null(np.iinfo(np.int64).min).to_numpy()
                    reach &= (bound > score[:, None]) | (own[None, :] <= last[:, None])
                item, text = np.nonzero(reach)
                for lo in range(0, len(item), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(item[lo:lo + (1 << 16)], pa.int32()),
                                                      ids.take(pa.array(text[lo:lo + (1 << 16)]))], ["item", "_id"])
    return run


def _scores(queries: _Queries):
    def run(parts):
        for part in parts:
            rows, items, scores = [], [], []
            for row, (body, mine) in enumerate(zip(part.column("_body"), part.column("items").to_pylist())):
                found = terms_of(body.as_py())
                counts, length = Counter(found), len(found)
                for item in mine:
                    score = queries.score(item, counts, length)
                    if score > 0:
                        rows.append(row)
                        items.append(item)
                        scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), part.column("_id").take(pa.array(rows, pa.int64())),
                                              pa.array(scores, pa.int64())], ["item", "_id", "score"])
    return run


def _item_terms(parts):
    for part in parts:
        words, hashes = [], []
        for body in part.column("_body").to_pylist():
            mine = sorted(set(terms_of(body)))
            words.append(mine)
            hashes.append(W.Texts(mine).words.view(np.int64).tolist() if mine else [])
        yield pa.RecordBatch.from_arrays([part.column("item_id"), part.column("_body"), pa.array(words, pa.list_(pa.binary())),
                                          pa.array(hashes, pa.list_(pa.int64()))], ["item_id", "_body", "words", "hashes"])


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", index: DataFrame | None = None, chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """item_col, rank (from 1), id_col, score: the ``k`` texts of highest score above 0 of each item.

    Scores are those of the docstring of ``oracles.SEARCH``: whole numbers from
    term frequencies, lengths and the numbers of texts that hold a term.
    Equal scores go by ascending id, null ids last; every row is a text of its
    own, also if it repeats another.  A null or empty item finds nothing;
    equal items count once, and an item id with several texts has a ranking
    for each.  Empty tables give none.  Other columns are not looked at.

    Items are taken in runs of about ``chunk_terms`` terms, chosen by hash;
    a run's terms, weights and goals go to all tasks, and their number is
    bounded by ``chunk_terms`` and one item.  Texts are fetched by id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_body"))
    id_kind = rows.schema["_id"].dataType.simpleString()
    whole_ids = id_kind in ("bigint", "int", "smallint", "tinyint")
    index = build_index(docs, id_col, text_col) if index is None else index
    totals = index.where("width is not null").agg(
        F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    asked = items.select(F.col(item_col).alias("item_id"), text_bytes(item_text).alias("_body")).distinct()
    item_kind = asked.schema["item_id"].dataType
    asked = materialize(asked.mapInArrow(_item_terms, f"item_id {item_kind.simpleString()}, _body binary, words array<binary>, "
                                                      "hashes array<long>").where(F.size("words") > 0), "items")
    terms = asked.agg(F.sum(F.size("words"))).first()[0] or 0
    runs = -(-terms // chunk_terms)
    dealt = asked.withColumn("run", F.pmod(F.xxhash64("item_id", "_body"), F.lit(max(1, runs))))
    found = [_run(spark, rows, index, dealt.where(F.col("run") == r), totals, k, id_kind, whole_ids, item_kind)
             for r in range(runs)] if totals[0] else []
    found = [f for f in found if f is not None]
    if not found:
        kind = f"`{item_col}` {item_kind.simpleString()}, rank int, `{id_col}` {id_kind}, score long"
        return spark.createDataFrame([], kind)
    whole = found[0]
    for other in found[1:]:
        whole = whole.union(other)
    return whole.select(F.col("item_id").alias(item_col), "rank", F.col("_id").alias(id_col), "score")


def _run(spark, rows: DataFrame, index: DataFrame, asked: DataFrame, totals, k: int, id_kind: str, whole_ids: bool, item_kind):
    """The ranking of one bounded run of items."""
    items = [(r["item_id"], list(zip(map(bytes, r["words"]), r["hashes"]))) for r in asked.select("item_id", "words", "hashes").collect()]
    if not items:
        return None
    wanted = asked.select(F.explode("hashes").alias("term")).distinct()
    counts = (index.where("terms is not null").select(F.explode(F.arrays_zip("terms", "holders")).alias("x")).select("x.terms", "x.holders")
              .join(F.broadcast(wanted), F.col("terms") == F.col("term")).groupBy("term").agg(F.sum("holders").alias("n")))
    queries = _Queries(items, {r["term"]: r["n"] for r in counts.collect()}, *totals)
    if not len(queries.terms):
        return None
    blocks = index.where("width is not null").select("ids", "lengths", "width", "most", "slices")
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))

    def scored(pairs: DataFrame, few: bool) -> DataFrame:
        each = pairs.groupBy("_id").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumnRenamed("_id", "_key")
        match = F.col("_id").eqNullSafe(F.col("_key"))
        with_text = rows.join(F.broadcast(each) if few else each, match).select("_id", "_body", "items")
        return with_text.mapInArrow(_scores(queries), f"item int, _id {id_kind}, score long")

    # At most k ids for each item of the run: few by construction.
    first = blocks.mapInArrow(_highest(queries, k), f"item int, _id {id_kind}, bound long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), "_id"))
    seeds = materialize(first.withColumn("place", place).where(F.col("place") <= k).select("item", "_id"), "seeds")
    tried = scored(seeds, True).withColumn("rank", rank).where(F.col("rank") == k).select("item", "score", "_id")
    goals = [(0, None)] * len(items)
    for r in tried.collect():
        goals[r["item"]] = (r["score"], r["_id"])
    pairs = materialize(blocks.mapInArrow(_reaching(queries, goals, whole_ids), f"item int, _id {id_kind}"), "candidates")
    best = scored(pairs, False).withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], _names_schema(item_kind))
    return materialize(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "_id", "score"), "found")


def _names_schema(item_kind):
    from pyspark.sql.types import IntegerType, StructField, StructType
    return StructType([StructField("item", IntegerType()), StructField("item_id", item_kind)])
