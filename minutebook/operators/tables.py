"""Intermediate tables in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from minutebook.session import scratch_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a plan reads the same intermediate result several times.  The
    table survives the loss of executors, is read column by column, and its
    size is known to the optimizer, which then broadcasts only what fits.
    Texts take about half the room under zstandard that they take by default.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
