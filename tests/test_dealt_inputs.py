"""Shared inputs are dealt out by size: a task's share does not grow with the tables."""

import math

from minutebook.plans import fixtures


def test_parts_grow_with_the_lines(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    lines = fixtures.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(fixtures, "LINES", 500)
    for name in ("item_sponsors", "fx_sp"):
        made = fixtures._derived(spark, sf, name)
        assert made.rdd.getNumPartitions() == math.ceil(lines / 500), name


def test_an_item_lies_in_one_part(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(fixtures, "LINES", 500)
    made = fixtures._derived(spark, "/root/testdata/sf0.001", "item_sponsors")
    each = made.select("id", F.spark_partition_id().alias("part")).distinct()
    assert each.count() == made.select("id").distinct().count() and made.count() == made.distinct().count()
