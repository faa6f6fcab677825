"""Streams into keyed tables: ingest with rejects and progress, live roll-ups, ids seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minutebook import schemas
from minutebook.operators.rollups import period_of
from minutebook.sources.keyed import KeyedTable
from minutebook.sources.meetings import CORRUPT, explode_items
from minutebook.streaming.ingest import DeltaTable, run, stream_source

# --- ingest -----------------------------------------------------------------

REJECT = T.StructType([T.StructField("file_name", T.StringType()), T.StructField(CORRUPT, T.StringType())])
DAY = T.StructType([T.StructField("date", T.StringType()), T.StructField("items", T.LongType()), T.StructField("batch", T.LongType())])


class MeetingStore:
    """Where meeting files go: ``items``, ``rejects`` and ``days``, the ledger of days tried."""

    def __init__(self, spark: SparkSession, root: str):
        root = root.rstrip("/")
        kind = T.StructType([T.StructField("date", T.StringType()), T.StructField("pos", T.IntegerType()), *schemas.ITEM.fields])
        everything = lambda rows: rows.drop("source", "batch")
        self.items = DeltaTable(spark, f"{root}/items", kind, everything)
        self.rejects = DeltaTable(spark, f"{root}/rejects", REJECT, everything)
        self.days = KeyedTable(spark, f"{root}/days", ["date"], DAY, buckets=8)

    def next_day(self, first: str) -> str:
        """The day after the last one tried, ``first`` before any was."""
        after = F.date_add(F.to_date(F.max("date")), 1).cast("string")
        return self.days.read().agg(after).first()[0] or first


def ingest_meetings(spark: SparkSession, source: str, store: MeetingStore, checkpoint: str, files_per_batch: int = 1000,
                    lines: bool = False) -> None:
    """Store the items of new meeting files; what does not parse goes to the rejects, and every day to the ledger.

    A file without date counts for the day its name tells; days without items are
    days tried.  All three sinks are written once for each batch, also if it is
    repeated after a failure: items and rejects overwrite the batch's own
    partition, the ledger knows the batches it has.
    """
    with_text = T.StructType([*schemas.MEETING.fields, T.StructField(CORRUPT, T.StringType())])
    raw = (spark.readStream.schema(with_text).option("multiLine", not lines).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
           .option("maxFilesPerTrigger", files_per_batch).json(source)
           .select("*", F.col("_metadata.file_name").alias("file_name")))
    named = F.coalesce("date", F.nullif(F.regexp_extract("file_name", r"^(\d{4}-\d\d-\d\d)\.json$", 1), F.lit("")))

    def write(batch: DataFrame, batch_id: int) -> None:
        told = stream_source(spark, checkpoint)
        batch = batch.persist()
        good = batch.where(F.col(CORRUPT).isNull()).withColumn("date", named)
        store.rejects.write(batch.where(F.col(CORRUPT).isNotNull()).select("file_name", CORRUPT), told, batch_id)
        store.items.write(explode_items(good), told, batch_id)
        tried = good.where(F.col("date").isNotNull()).groupBy("date").agg(
            F.sum(F.coalesce(F.array_size("data"), F.lit(0))).cast("long").alias("items")).withColumn("batch", F.lit(batch_id).cast("long"))

        def added(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.unionByName(new).groupBy("date").agg(F.sum("items").alias("items"), F.max("batch").alias("batch"))

        store.days.change(tried, added, source=told, batch_id=batch_id)
        batch.unpersist()

    run(raw.writeStream.foreachBatch(write), checkpoint)


# --- live roll-up -----------------------------------------------------------

COUNT = T.StructType([T.StructField("period", T.StringType()), T.StructField("measure", T.StringType()),
                      T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])


def timeline_table(spark: SparkSession, root: str, buckets: int = 8) -> KeyedTable:
    return KeyedTable(spark, root, ["period", "measure", "name"], COUNT, buckets)


def timeline_stream(items: DataFrame, table: KeyedTable, checkpoint: str, group_by: str = "year") -> None:
    """Keep the counts of :func:`rollups.timeline` current from a stream of prepared items.

    The state holds one count for each period and action, type or meeting day,
    however many items there are.  In update mode a batch brings the
    counts that changed, and the table takes them in place of the old ones:
    late days change their period like any other, a restart goes on from the
    state, and a repeated batch stores the same counts again.  Items have
    date, category and type_name; rows without a date are left out.
    """
    period = period_of(F.col("date"), group_by)
    measures = F.array(F.struct(F.lit("action").alias("measure"), F.col("category").alias("name")),
                       F.struct(F.lit("type").alias("measure"), F.col("type_name").alias("name")),
                       F.struct(F.lit("meeting").alias("measure"), F.col("date").alias("name")))
    counts = (items.where(F.col("date").isNotNull()).select(period.alias("period"), F.explode(measures).alias("m"))
              .groupBy("period", "m.measure", "m.name").agg(F.count("*").alias("n")))

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch.select(*COUNT.names))  # the state needs every batch to be read, so none is skipped

    run(counts.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def timeline_of(table: KeyedTable) -> DataFrame:
    """period, total_items, meetings and the maps actions and types, as :func:`rollups.timeline` gives them."""
    def counts(measure: str) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("measure") == measure, F.struct("name", "n")))))

    return table.read().groupBy("period").agg(
        F.sum(F.when(F.col("measure") == "action", F.col("n")).otherwise(0)).alias("total_items"),
        F.sum(F.when(F.col("measure") == "meeting", 1).otherwise(0)).cast("long").alias("meetings"),
        counts("action").alias("actions"), counts("type").alias("types"))


# --- ids seen before --------------------------------------------------------

def store_unseen(stream: DataFrame, table: KeyedTable, checkpoint: str, order: str) -> None:
    """Store of each batch one row for each key that is not stored yet, that of lowest ``order``; no key, no row.

    Keys lie in buckets by hash: a batch opens those that can hold one of its
    keys and no others.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table.insert_new(batch.dropna(subset=table.key), order, source=stream_source(batch.sparkSession, checkpoint), batch_id=batch_id)

    run(stream.writeStream.foreachBatch(write), checkpoint)
