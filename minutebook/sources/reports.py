"""Report and list writers, managed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutebook import schemas


def write_report(df: DataFrame, columns, json_path: str, csv_path: str) -> None:
    """The same rows as JSON and as CSV in a fixed column order."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(json_path)
    (df.select(*columns).write.mode("overwrite")
     .option("header", True).option("escape", '"').option("multiLine", True).csv(csv_path))


def read_report_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", True).csv(path))


def write_values(df: DataFrame, column: str, text_path: str, json_path: str) -> None:
    """A sorted value list as text and as JSON; part files keep the global order."""
    values = df.select(F.col(column).cast("string").alias("value")).orderBy("value")
    values.write.mode("overwrite").text(text_path)
    values.write.mode("overwrite").json(json_path)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project onto the declared schema; absent columns become NULL."""
    have = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.TABLES[table].fields])


def write_table(df: DataFrame, table: str, path: str, mode: str = "overwrite") -> None:
    conform(df, table).write.mode(mode).parquet(path)


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[table]).parquet(path)
