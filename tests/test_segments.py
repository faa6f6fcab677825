"""An index kept by batches equals one built anew."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from minutebook.operators import fulltext as ft
from minutebook.operators.segments import SegmentedIndex

SCHEMA = "id long, title string, body string"


def content(postings):
    return sorted((r.term, r.doc_id, r.tf, tuple(r.positions)) for r in postings.collect())


def test_batches_equal_a_rebuild(spark, tmp_path):
    rng, docs = random.Random(5), {}
    index = SegmentedIndex(spark, str(tmp_path), "id", ["title", "body"], fan=2)
    word = lambda: rng.choice(["tax", "vote", "park", "road", "Ünïon", "x"])
    for batch in range(5):
        rows = [(i, word(), " ".join(word() for _ in range(rng.randint(0, 4)))) for i in rng.sample(range(40), 12 if batch else 30)]
        gone = rng.sample(range(40), 6)
        for i in gone:
            docs.pop(i, None)
        docs.update({r[0]: r for r in rows})
        before = set(glob.glob(f"{tmp_path}/data/*"))
        index.apply(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(g,) for g in gone], "id long"), partitions=1,
                    source="feed", batch_id=batch)
        assert before <= set(glob.glob(f"{tmp_path}/data/*"))  # nothing stored was written again in place
    whole = spark.createDataFrame(list(docs.values()), SCHEMA)
    assert content(index.postings()) == content(ft.build_postings(whole, "id", ["title", "body"]))
    lengths = ft.document_lengths(whole, "id", ["title", "body"])
    assert sorted(map(tuple, index.lengths().collect())) == sorted(map(tuple, lengths.collect()))
    assert index.totals().first() == ft.corpus_totals(lengths).first()
    assert len(index.segments()) < 5
    found = ft.search(index.postings(), index.lengths(), "tax -vote", index.totals())
    want = ft.search(ft.build_postings(whole, "id", ["title", "body"]), lengths, "tax -vote")
    rounded = lambda df: sorted((r.doc_id, round(r.score, 9)) for r in df.collect())
    assert rounded(found) == rounded(want)
    again = SegmentedIndex(spark, str(tmp_path), "id", ["title", "body"], fan=2)
    again.apply(whole.limit(1).withColumn("title", F.lit("zzz")), source="feed", batch_id=4)
    assert again.postings().where("term = 'zzz'").count() == 0  # a repeated batch


def test_a_batch_writes_its_own_segment_only_and_terms_reach_the_files(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path), "id", ["body"], fan=4)
    index.apply(spark.range(200).select("id", F.lit("common words here").alias("body")), partitions=2)
    old = {f: len(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/data/*/postings/*.parquet")}
    index.apply(spark.createDataFrame([(5, "rare")], "id long, body string"), partitions=1)
    new = set(glob.glob(f"{tmp_path}/data/*/postings/*.parquet")) - set(old)
    assert sum(spark.read.parquet(f).count() for f in new) == 1
    plan = index.postings().where("term = 'rare'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(term,rare)") == 2
    assert index.postings().where("term = 'common'").count() == 199
    index.apply(deleted=spark.range(300))
    assert index.postings().count() == 0 == index.lengths().count()


def test_what_cannot_be_indexed_is_refused(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path), "id", ["body"])
    with pytest.raises(ValueError, match="nothing was indexed"):
        index.postings()
    with pytest.raises(ValueError, match="more than once"):
        index.apply(spark.createDataFrame([(1, "a"), (1, "b")], "id long, body string"))
    assert index.segments() == []
