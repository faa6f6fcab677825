"""Unions and distinct sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_numbers(df: DataFrame, number: str = "number") -> DataFrame:
    return df.where(F.coalesce(number, F.lit("")) != "").select(number).distinct()


def keyed_union(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones of the same key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def keyed_union_report(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    seen = old.select(key).distinct().withColumn("_old", F.lit(True))
    return (new.join(seen, key, "left")
            .groupBy(F.when(F.col("_old"), "updated").otherwise("new").alias("outcome"))
            .agg(F.count("*").alias("n")))


def id_set(*lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct whole numbers from several inputs; comments and other text are dropped."""
    every = reduce(DataFrame.unionByName, [l.select(F.col(value).cast("string").alias("v")) for l in lines])
    text = F.trim("v")
    return (every.where(text.rlike(r"^[+-]?\d+$"))
            .select(text.try_cast("bigint").alias("id")).where(F.col("id").isNotNull()).distinct())
