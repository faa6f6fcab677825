"""Ranked search against brute force, and the bounds that decide what is scored."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from minutebook.llm import bitslice

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranking(docs, items, k):
    bags = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs)]
    texts, length = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    held = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in bags:
            m = 100 - 50 + (50 * n * texts) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * texts + 2) / (2 * held[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(300)] + ["Ünï", "ÜNÏ", "Mixed", "mixed", "a1"]
    share = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, text(int(rng.integers(1, 80)))) for i in range(400)]
    docs += [(1000 + i, "copied w250 text w250, w251!") for i in range(200)] + [(1000, "copied w250 text w250, w251!")] * 3
    docs += [(None, "w250 no id"), (5, None), (6, ""), (7, "... !!"), (8, text(20_000)), (9, "a\x00b w299"), (9, "other row w299 w299")]
    items = [(1, "W250 and w251"), (2, text(40)), (3, None), (4, "?!"), (5, "absent words only"), (6, "w299"), (6, "mixed Ünï"), (7, text(30)),
             (1, "W250 and w251"), (None, "w1 w2 w3"), (8, "copied")]
    return docs, items


@pytest.mark.parametrize("options", [dict(), dict(k=3), dict(chunk_terms=12, k=7)])
def test_ranking_equals_brute_force(spark, corpus, options):
    docs, items = corpus
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("_id", F.lit(1)).withColumn("item", F.lit(2))
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("score", F.lit(1)).withColumn("doc_id", F.lit(3))
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in bitslice.search(table, asked, **options).collect()), key=str)
    assert got == ranking(docs, items, options.get("k", 50))


def test_empty_tables(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id string, text string")
    items = spark.createDataFrame(corpus[1], "item_id int, text string")
    assert bitslice.search(docs.limit(0), items).count() == 0 == bitslice.search(docs, items.limit(0)).count()
    assert bitslice.search(docs.where("text is null"), items).count() == 0
    some = bitslice.search(docs, items)  # ids that are no numbers
    assert some.count() == len(ranking(*corpus, 50)) and dict(some.dtypes) == {"item_id": "int", "rank": "int", "doc_id": "string", "score": "bigint"}


def test_bounds_hold_and_leave_most_texts_out(corpus):
    docs, items = corpus
    held = bitslice._Held()
    held.add(pa.array(range(len(docs))), [(t or "").encode() for _, t in docs])
    bags = [Counter(x.encode() for x in terms(t)) for _, t in docs]
    words = sorted({x for _, t in items for x in terms(t)})
    hashes = dict(zip(words, bitslice.W.Texts([w.encode() for w in words]).words.view(np.int64).tolist()))
    # A text of one word each: the hash of a word does not depend on its surroundings.
    holders = Counter(w for c in bags for w in c)
    known = {h: holders[w.encode()] for w, h in hashes.items() if holders[w.encode()]}
    asked = [(i, [(w.encode(), hashes[w]) for w in sorted(set(terms(t)))]) for i, t in items]
    queries = bitslice._Queries(asked, known, sum(bool(c) for c in bags), sum(sum(c.values()) for c in bags))
    above = equal = 0
    for ids, lengths, *block in held.blocks():
        bound = queries.bounds(lengths, *block)
        for col, d in enumerate(ids.to_pylist()):
            for i in range(len(items)):
                score = queries.score(i, bags[d], int(lengths[col]))
                assert bound[i, col] >= score
                above += bound[i, col] > score
                equal += bound[i, col] == score
    assert equal > 0.8 * (above + equal)
