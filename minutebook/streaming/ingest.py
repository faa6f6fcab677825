"""Incremental ingest, upserts, de-duplication and roll-ups.

Every job runs on ``availableNow``: it takes what is new since its checkpoint
and stops, so the same code serves a schedule or a long-running query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from minutebook import schemas
from minutebook.sources.keyed import KeyedTable
from minutebook.sources.meetings import explode_items


def run(writer, checkpoint: str, path: str | None = None) -> None:
    stream = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (stream.start(path) if path else stream.start()).awaitTermination()


def meeting_stream(spark: SparkSession, path: str, files_per_batch: int = 1000, lines: bool = False) -> DataFrame:
    """Items of meeting files as they arrive, one document per file or, with ``lines``, one record per line."""
    raw = (spark.readStream.schema(schemas.MEETING).option("multiLine", not lines)
           .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
           .json(path))
    return explode_items(raw)


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str,
                  files_per_batch: int = 1000, lines: bool = False) -> None:
    """Append new meeting files to the item table, partitioned by year."""
    items = meeting_stream(spark, source, files_per_batch, lines) \
        .withColumn("year", F.substring("date", 1, 4).try_cast("int"))
    run(items.writeStream.format("parquet").outputMode("append").partitionBy("year"), checkpoint, target)


def since_high_watermark(rows: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rows above the highest key stored so far (all rows for an empty table)."""
    top = stored.agg(F.max(key)).scalar()
    return rows.where(top.isNull() | (F.col(key) > top))


class DeltaTable:
    """A table kept as what each batch brought, folded when it is read.

    Every batch of every stream is one partition ``source=.../batch=...``.
    Repeating a batch after a failure overwrites its own partition only, so
    results do not change; a second stream or a new checkpoint has another
    ``source`` and hides nothing.  Batches write no more than they bring.
    :meth:`compact` folds a table into a new one for fast reading.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType,
                 fold: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.schema, self.fold = spark, root.rstrip("/"), schema, fold

    def deltas(self) -> DataFrame:
        """All rows ever written, with source and batch."""
        kind = StructType(self.schema.fields).add("source", "string").add("batch", "long")
        try:
            return self.spark.read.schema(kind).parquet(self.root)
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], kind)

    def read(self) -> DataFrame:
        return self.fold(self.deltas())

    def write(self, rows: DataFrame, source: str, batch: int) -> None:
        (rows.select(*self.schema.names).withColumn("source", F.lit(source)).withColumn("batch", F.lit(batch))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("source", "batch").parquet(self.root))

    def compact(self, target: str) -> DeltaTable:
        """A new table that holds the folded rows as one batch; later streams go on there."""
        smaller = DeltaTable(self.spark, target, self.schema, self.fold)
        smaller.write(self.read(), "compacted", -1)
        return smaller


def stream_source(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query when its checkpoint was made."""
    kept = spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()
    return kept["id"]


def _append(stream: DataFrame, table: DeltaTable, checkpoint: str,
            prepare: Callable[[DataFrame], DataFrame]) -> None:
    def write(batch: DataFrame, batch_id: int) -> None:
        table.write(prepare(batch), stream_source(batch.sparkSession, checkpoint), batch_id)
    run(stream.writeStream.foreachBatch(write), checkpoint)


def newest_by_id(fields: list[str], seq: str = "seq") -> Callable[[DataFrame], DataFrame]:
    """Fold for upserts: of each id the row of the highest ``seq``, in whichever batch it came."""
    def fold(deltas: DataFrame) -> DataFrame:
        return (deltas.groupBy("id").agg(F.max_by(F.struct(*fields, seq), F.struct(seq, "batch")).alias("_new"))
                .select("id", "_new.*"))
    return fold


def upsert_stream(stream: DataFrame, table: DeltaTable, checkpoint: str, seq: str = "seq") -> None:
    """Insert or update by id; rows without id are skipped, within a batch the highest ``seq`` is kept."""
    rest = [c for c in table.schema.names if c != "id"]
    _append(stream, table, checkpoint, lambda batch: (
        batch.where(F.coalesce("id", F.lit(0)) != 0).groupBy("id")
        .agg(F.max_by(F.struct(*rest), seq).alias("_new")).select("id", "_new.*")))


def upsert_keyed_stream(stream: DataFrame, table: KeyedTable, order: str, checkpoint: str) -> None:
    """Keep a keyed table current: of each key the row of highest ``order``; rows without a complete key are skipped.

    A batch rewrites the buckets it touches and no others, reading costs the
    same however many batches there were, and a repeated batch changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table.keep_newest(batch.dropna(subset=table.key), order, source=stream_source(batch.sparkSession, checkpoint), batch_id=batch_id)
    run(stream.writeStream.foreachBatch(write), checkpoint)


def rollup_stream(stream: DataFrame, ts: str, keys: list[str], width: str, late: str,
                  target: str, checkpoint: str) -> None:
    """Counts per tumbling window and key, appended once the watermark has passed."""
    counts = (stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
              .agg(F.count("*").alias("n"))
              .select(F.col("window.start").alias("period"), *keys, "n"))
    run(counts.writeStream.format("parquet").outputMode("append"), checkpoint, target)


def summed(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Fold for counts: the sum over all batches, late rows included."""
    return lambda deltas: deltas.groupBy(*keys).agg(F.sum("n").alias("n"))


def rollup_table_stream(stream: DataFrame, table: DeltaTable, keys: list[str], checkpoint: str) -> None:
    """Roll-up by any key, always up to date: each batch adds its counts."""
    _append(stream, table, checkpoint, lambda batch: batch.groupBy(*keys).agg(F.count("*").alias("n")))


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str, late: str, target: str,
                  checkpoint: str) -> None:
    """First row per key; state is dropped once the watermark passes it."""
    fresh = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    run(fresh.writeStream.format("parquet").outputMode("append"), checkpoint, target)


def first_by_key(key: str, fields: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Fold that keeps of each key the row that came first."""
    def fold(deltas: DataFrame) -> DataFrame:
        return (deltas.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct("batch", "source")).alias("_r"))
                .select(key, "_r.*"))
    return fold


def skip_seen_stream(stream: DataFrame, table: DeltaTable, key: str, checkpoint: str) -> None:
    """Store one row for each key that a batch brings and the table did not hold before it."""
    rest = [c for c in table.schema.names if c != key]
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        source = stream_source(spark, checkpoint)
        own = (F.col("source") == source) & (F.col("batch") >= batch_id)
        one = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")
        table.write(one.join(table.deltas().where(~own).select(key), key, "left_anti"), source, batch_id)

    run(stream.writeStream.foreachBatch(write), checkpoint)
