"""Changes found by bucket digests equal a join of everything."""

import random

from pyspark.sql import functions as F

from minutebook.operators import reports

SCHEMA = "id long, a string, b string"


def test_changes_equal_a_full_comparison(spark):
    rng = random.Random(8)
    old = {i: (rng.choice(["x", "y", None]), rng.choice(["x", None])) for i in range(300)}
    new = dict(old)
    for i in rng.sample(range(300), 12):
        new[i] = (new[i][1], new[i][0])  # null and value change places
    del new[7]
    new[900] = (None, "z")
    before = spark.createDataFrame([(i, *v) for i, v in old.items()], SCHEMA)
    after = spark.createDataFrame([(i, *v) for i, v in new.items()], SCHEMA).withColumn("extra", F.lit(1))
    none = (None, None)
    want = sorted(((i, c, o, n) for i in {*old, *new} for c, o, n in zip("ab", old.get(i, none), new.get(i, none)) if o != n), key=str)
    for buckets in (1, 16, 1024):
        got = reports.changes(before, after, ["a", "b"], buckets=buckets)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert reports.changes(before, before, ["a", "b"]).count() == 0
    report = {r.column: r.n for r in reports.change_report(before, after, ["a", "b"]).collect()}
    assert report["(checked rows)"] == 300 and report["(changed rows)"] == len({w[0] for w in want})


def test_only_differing_buckets_are_joined(spark):
    before = spark.range(10_000).select("id", F.lit("x").alias("a"), F.lit(None).cast("string").alias("b"))
    after = before.withColumn("a", F.when(F.col("id").isin(5, 4321), "y").otherwise(F.col("a")))
    assert 1 <= reports.changed_buckets(before, after, ["a", "b"]).count() <= 2
    twice = before.unionByName(before.where("id = 5"))
    assert reports.changed_buckets(before, twice, ["a"]).count() == 1  # a row that is there once more
    assert {r.id for r in reports.changes(before, after, ["a", "b"]).collect()} == {5, 4321}
