"""Removal of passages that stand earlier in the corpus, by relative Lempel-Ziv parsing.

Every text is parsed against an index of the whole corpus: from a word on, the
longest stretch that also stands earlier becomes a factor, and parsing goes on
behind it.  Factors of at least ``window`` words are duplicate spans.  Where a
factor ends, the phrases that reach over its end are looked up as well, so a
passage whose halves come from two places is not lost.

The index is spread over many blocks and never held in one place:

1. Texts are dealt to segments.  Each text names its seeds: of every
   ``window`` consecutive words the run of ``seed`` words with the least hash,
   so equal phrases name equal seeds.  Seed hashes go, packed, to index blocks
   by hash; a block returns to each segment the seeds that stand elsewhere too.
   The same blocks find whole texts that equal one of a smaller id.
2. Only phrases of ``window`` words around such seeds can be repeated.  Their
   hashes (80 bit) go to the reference blocks with their place.  A segment sends
   each phrase once.  A block finds the first place of every phrase and returns
   all other places with the diagonal on which the reference lies.
3. Each segment parses its texts: phrases that follow each other on one
   diagonal form a factor; a change of diagonal ends it.

A phrase or a text that a third of all rows contain costs one entry for each
segment, not for each row.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutebook.llm import wordhash as W
from minutebook.llm.common import partitions, ship, text_bytes

ship(W.__name__)
ship(__name__)

U = np.uint64
FLUSH = 8 << 20
NONE = np.iinfo(np.int64).min  # stands for a null id: before all others
SEEDS = "block int, seeds binary, homes binary, texts binary, ids binary, text_homes binary"
KNOWN = "seg int, seeds binary, copies binary"
PHRASES = "block int, seg int, hashes binary, checks binary, places binary, starts binary, ids binary, known binary"
FOUND = "seg int, places binary, diagonals binary, copies binary"


def _least_seed(words: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Least hash of the seeds in each window; windows may run over the ends of texts."""
    runs = W.hash_runs(words, seed)
    count = max(0, len(words) - window + 1)
    least = runs[:count].copy()
    for k in range(1, window - seed + 1):
        np.minimum(least, runs[k:k + count], out=least)
    return least


def _seed_starts(words: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Whether each window's first least seed starts at another word than that of the window before."""
    runs = W.hash_runs(words, seed)
    count = max(0, len(words) - window + 1)
    least, at = runs[:count].copy(), np.arange(count)
    for k in range(1, window - seed + 1):
        less = runs[k:k + count] < least
        np.copyto(least, runs[k:k + count], where=less)
        np.copyto(at, np.arange(k, k + count), where=less)
    new = np.ones(count, bool)
    new[1:] = at[1:] != at[:-1]
    return new


def _raw(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _ids(column) -> np.ndarray:
    return _raw(column.combine_chunks().fill_null(NONE) if isinstance(column, pa.ChunkedArray) else column.fill_null(NONE))


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _name_seeds(window: int, seed: int, blocks: int):
    def pack(hashes, homes, texts, ids, text_homes):
        h, s = np.concatenate(hashes), np.concatenate(homes)
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        third = np.zeros(len(h), bool)
        third[2:] = (h[2:] == h[:-2]) & (s[2:] == s[:-2])
        h, s = h[~third], s[~third]
        t = np.frombuffer(b"".join(texts), U).reshape(-1, 2)
        i, o = np.concatenate(ids), np.concatenate(text_homes)
        seed_block, text_block = (h % U(blocks)).astype(np.int32), (t[:, 0] % U(blocks)).astype(np.int32)
        order, text_order = np.argsort(seed_block, kind="stable"), np.argsort(text_block, kind="stable")
        every = np.arange(blocks + 1)
        cut = np.searchsorted(seed_block[order], every)
        text_cut = np.searchsorted(text_block[text_order], every)
        columns = [h[order], s[order], t[text_order], i[text_order], o[text_order]]
        cuts = [cut, cut, text_cut, text_cut, text_cut]
        used = [b for b in range(blocks) if cut[b] < cut[b + 1] or text_cut[b] < text_cut[b + 1]]
        return pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32())] + [pa.array([x[c[b]:c[b + 1]].tobytes() for b in used], pa.binary())
                                            for x, c in zip(columns, cuts)],
            ["block", "seeds", "homes", "texts", "ids", "text_homes"])

    def run(parts):
        held, size = ([], [], [], [], []), 0
        for part in parts:
            bodies, ids = part.column("_body").to_pylist(), _ids(part.column("_id"))
            segs = _raw(part.column("seg")).astype(np.uint32)
            for first, some in W.batches(bodies):
                t = W.Texts(some)
                least = _least_seed(t.words, window, seed)
                inside = t.room()[:len(least)] >= window
                before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
                named = inside & (_seed_starts(t.words, window, seed) | ~before)
                held[0].append(least[named])
                held[1].append(segs[first:first + len(some)][t.doc[:len(named)][named]])
                held[2].extend(xxhash.xxh3_128_digest(x) for x in some)
                held[3].append(ids[first:first + len(some)])
                held[4].append(segs[first:first + len(some)])
                size += len(t.data)
                if size >= FLUSH:
                    yield pack(*held)
                    held, size = ([], [], [], [], []), 0
        if held[2]:
            yield pack(*held)
    return run


def _index_seeds(part: pa.Table) -> pa.Table:
    """For each segment its seeds that stand in two places, and the digests of its texts that equal one of a smaller id, with that id."""
    h, s = _joined(part.column("seeds"), U), _joined(part.column("homes"), np.uint32)
    order = np.lexsort((s, h))
    h, s = h[order], s[order]
    same = h[1:] == h[:-1]
    shared = np.zeros(len(h), bool)
    shared[1:] |= same
    shared[:-1] |= same
    h, s = h[shared], s[shared]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    h, s = h[new], s[new]
    order = np.argsort(s, kind="stable")
    h, s = h[order], s[order]
    t = _joined(part.column("texts"), U).reshape(-1, 2)
    i, o = _joined(part.column("ids"), np.int64), _joined(part.column("text_homes"), np.uint32)
    order = np.lexsort((i, t[:, 1], t[:, 0]))
    t, i, o = t[order], i[order], o[order]
    first = np.ones(len(i), bool)
    first[1:] = (t[1:] != t[:-1]).any(axis=1)
    least = i[np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))] if len(i) else i
    later = i != least
    t, least, o = t[later], least[later], o[later]
    order = np.argsort(o, kind="stable")
    t, least, o = t[order], least[order], o[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1]).any(axis=1)
    known, o = np.column_stack([t, least.view(U)])[new], o[new]
    segs = np.unique(np.concatenate([s, o]))
    cut, text_cut = np.searchsorted(s, np.append(segs, 1 << 32)), np.searchsorted(o, np.append(segs, 1 << 32))
    return pa.table({
        "seg": pa.array(segs.astype(np.int32), pa.int32()),
        "seeds": pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
        "copies": pa.array([known[a:b].tobytes() for a, b in zip(text_cut[:-1], text_cut[1:])], pa.binary())})


def _sorted(part: pa.Table) -> tuple[np.ndarray, list[bytes], list[int]]:
    """Ids and texts of a segment in the order in which places are counted, and that order."""
    ids, bodies = _ids(part.column("_id")), part.column("_body").to_pylist()
    order = sorted(range(len(bodies)), key=lambda k: (ids[k], bodies[k]))
    return ids[order], [bodies[k] for k in order], order


def _look_up(window: int, seed: int, blocks: int):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(
                ("block", "seg", "hashes", "checks", "places", "starts", "ids", "known"),
                [pa.int32()] * 2 + [pa.binary()] * 6)})
        ids, bodies, _ = _sorted(docs)
        seg = docs.column("seg")[0].as_py()
        seeds = np.sort(_joined(known.column("seeds"), U))
        copies = _joined(known.column("copies"), U).reshape(-1, 3)
        least_id = dict(zip((x.tobytes() for x in copies[:, :2]), copies[:, 2].view(np.int64).tolist()))
        copy = np.array([i > least_id.get(xxhash.xxh3_128_digest(x), i) for i, x in zip(ids.tolist(), bodies)], bool)
        for k in range(1, len(ids)):
            copy[k] |= ids[k] == ids[k - 1] and bodies[k] == bodies[k - 1]
        found, starts, base = ([], [], []), [], 0
        for first, some in W.batches(bodies):
            t = W.Texts(some)
            starts.append(base + t.bounds[:-1])
            least = _least_seed(t.words, window, seed)
            near = np.searchsorted(seeds, least)
            use = (t.room()[:len(least)] >= window) & ~copy[first:first + len(some)][t.doc[:len(least)]]
            use &= seeds[np.minimum(near, len(seeds) - 1)] == least if len(seeds) else False
            found[0].append(W.hash_runs(t.words, window)[use])
            found[1].append(W.hash_runs(t.words, window, 1)[use].astype(np.uint16))
            found[2].append((np.flatnonzero(use) + base).astype(np.uint32))
            base += len(t.words)
        h, c, p = (np.concatenate(x) for x in found)
        order = np.lexsort((p, c, h))
        h, c, p = h[order], c[order], p[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        head = p[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))] if len(p) else p
        local = np.stack([p[~new], (p - head)[~new]], axis=1).astype(np.uint32)
        h, c, p = h[new], c[new], p[new]
        block = (h % U(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        h, c, p = h[order], c[order], p[order]
        cut = np.searchsorted(block[order], np.arange(blocks + 1))
        home = seg % blocks
        used = [b for b in range(blocks) if cut[b] < cut[b + 1] or b == home]
        starts = np.concatenate(starts).astype(np.uint32)
        rows = {"block": used, "seg": [seg] * len(used)}
        for name, x in (("hashes", h), ("checks", c), ("places", p)):
            rows[name] = [x[cut[b]:cut[b + 1]].tobytes() for b in used]
        rows["starts"], rows["ids"] = [], []
        for b in used:  # only the texts that have a phrase in the block
            own = np.unique(np.searchsorted(starts, p[cut[b]:cut[b + 1]], "right") - 1)
            own = own[own >= 0]
            rows["starts"].append(starts[own].tobytes())
            rows["ids"].append(ids[own].tobytes())
        mine = np.uint32(local.shape[0]).tobytes() + local.tobytes() + np.flatnonzero(copy).astype(np.uint32).tobytes()
        rows["known"] = [mine if b == home else b"" for b in used]
        return pa.table(rows, schema=pa.schema(
            [("block", pa.int32()), ("seg", pa.int32())]
            + [(n, pa.binary()) for n in ("hashes", "checks", "places", "starts", "ids", "known")]))
    return run


def _first_places(part: pa.Table) -> pa.Table:
    """Places whose phrase also stands earlier, for each segment; what a segment knew itself goes back to it."""
    segs = _raw(part.column("seg"))
    hashes, checks, places, ids, begins = [], [], [], [], []
    for h, c, p, s, i in zip(*(part.column(n).to_pylist() for n in ("hashes", "checks", "places", "starts", "ids"))):
        p, s, i = np.frombuffer(p, np.uint32), np.frombuffer(s, np.uint32), np.frombuffer(i, np.int64)
        hashes.append(np.frombuffer(h, U))
        checks.append(np.frombuffer(c, np.uint16))
        places.append(p)
        at = np.searchsorted(s, p, "right") - 1
        ids.append(i[at])
        begins.append(s[at])
    sizes = [len(p) for p in places]
    h, c, p, i, s = (np.concatenate(x) for x in (hashes, checks, places, ids, begins))
    seg = np.repeat(segs, sizes).astype(np.int32)
    order = np.lexsort((p, seg, i, c, h))
    h, c, p, i, s, seg = (x[order] for x in (h, c, p, i, s, seg))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    offset = (p[head].astype(np.int64) - s[head]).astype(U)
    diagonal = W.mix(W.mix(i[head].astype(U)) + (p.astype(U) - offset)).astype(np.uint32)
    p, seg, diagonal = p[~new], seg[~new], diagonal[~new]
    order = np.argsort(seg, kind="stable")
    p, seg, diagonal = p[order], seg[order], diagonal[order]
    own = np.unique(seg)
    cut = np.searchsorted(seg, np.append(own, np.iinfo(np.int32).max))
    rows = {"seg": own.tolist(), "places": [p[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])],
            "diagonals": [diagonal[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], "copies": [b""] * len(own)}
    for home, known in zip(segs.tolist(), part.column("known").to_pylist()):
        if known:
            n = int(np.frombuffer(known[:4], np.uint32)[0])
            local = np.frombuffer(known[4:4 + 8 * n], np.uint32).reshape(-1, 2)
            rows["seg"].append(home)
            rows["places"].append(np.ascontiguousarray(local[:, 0]).tobytes())
            rows["diagonals"].append(W.mix(local[:, 1].astype(U)).astype(np.uint32).tobytes())
            rows["copies"].append(known[4 + 8 * n:])
    return pa.table(rows, schema=pa.schema([("seg", pa.int32()), ("places", pa.binary()),
                                            ("diagonals", pa.binary()), ("copies", pa.binary())]))


def _parse(window: int, with_text: bool, carried: int):
    names = ["_id", "n_words", "n_removed", "kept_sha256", "starts", "lengths"] + ["kept_text"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.string()] * with_text
    others = [f"c{i}" for i in range(carried)]

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows, order = [], []
        if docs.num_rows:
            ids, bodies, order = _sorted(docs)
            none = docs.column("_none").take(pa.array(order)).to_pylist()
            places, diagonals = _joined(found.column("places"), np.uint32), _joined(found.column("diagonals"), np.uint32)
            rising = np.argsort(places, kind="stable")
            places, diagonals = places[rising].astype(np.int64), diagonals[rising]
            copies = set(_joined(found.column("copies"), np.uint32).tolist())
            begin = np.ones(len(places), bool)
            begin[1:] = (places[1:] != places[:-1] + 1) | (diagonals[1:] != diagonals[:-1])
            begin = np.flatnonzero(begin)
            factor_at = places[begin]
            factor_end = places[np.append(begin[1:], len(places)) - 1] + window if len(places) else factor_at
            base = 0
            for k, (doc, body) in enumerate(zip(ids.tolist(), bodies)):
                words = body.split()
                n = len(words)
                lo, hi = np.searchsorted(factor_at, [base, base + n])
                at, end = factor_at[lo:hi] - base, factor_end[lo:hi] - base
                if k in copies and n >= window:
                    at, end = np.array([0]), np.array([n])
                if len(at):
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, end, -1)
                    stays = np.cumsum(step[:n]) == 0
                    left = list(compress(words, stays.tolist()))
                else:
                    left = words
                base += n
                text = b" ".join(left)
                row = [None if doc == NONE else doc, n, n - len(left), sha256(text).hexdigest(), at.tolist(), (end - at).tolist()]
                if with_text:
                    row.append(None if none[k] else (text if len(at) else body).decode())
                rows.append(row)
        made = [pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
        kept = [docs.column(c).take(pa.array(order, pa.int64())) for c in others] if docs.num_columns else []
        return pa.table(made + kept, names=names + others)
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                   seed: int = 8, segment_rows: int = 1500, with_text: bool = False,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per text: id_col, n_words, n_removed, kept_sha256, spans and, if asked for, kept_text.

    A word is removed if a window of ``window`` consecutive words that covers
    it also starts earlier: in a text of smaller id, or earlier in its own.
    ``spans`` are the factors (start and length in words; those of different
    sources may overlap); ``kept_text`` is the text itself where nothing was
    removed, else the kept words joined by one space.  ``keep`` names further
    columns to carry along.  Null texts count as empty: no words, nothing
    removed, a null kept_text.  A null id stands before all others.
    Rows that repeat an id count as texts one after the other in a fixed
    order; of equal rows all but one lose their windows.  Other columns are
    not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    blocks = partitions(spark)
    segments = max(1, -(-docs.count() // segment_rows))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_body"),
                       F.col(text_col).isNull().alias("_none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))
    extra = "".join(f", c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))
    rows = rows.withColumn("seg", F.pmod(F.xxhash64("_id", "_body"), F.lit(segments)).cast("int"))
    plain = rows.drop("_none", *(f"c{i}" for i in range(len(keep))))
    seeds = plain.mapInArrow(_name_seeds(window, seed, blocks), SEEDS)
    known = seeds.groupBy("block").applyInArrow(_index_seeds, KNOWN)
    phrases = plain.groupBy("seg").cogroup(known.groupBy("seg")).applyInArrow(_look_up(window, seed, blocks), PHRASES)
    found = phrases.groupBy("block").applyInArrow(_first_places, FOUND)
    schema = "_id long, n_words long, n_removed long, kept_sha256 string, starts array<long>, lengths array<long>"
    parsed = rows.groupBy("seg").cogroup(found.groupBy("seg")).applyInArrow(
        _parse(window, with_text, len(keep)), schema + ", kept_text string" * with_text + extra)
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"))
    return parsed.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_sha256", spans.alias("spans"),
                         *(["kept_text"] * with_text), *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)))
