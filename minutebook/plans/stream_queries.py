"""Bindings of the streaming jobs: each runs to the end and returns its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from minutebook.plans.fixtures import fixture, table
from minutebook.plans.registry import query
from minutebook.session import scratch_dir
from minutebook.sources import meetings as mt
from minutebook.sources.keyed import KeyedTable
from minutebook.plans.rollup_queries import flat, prepared, timeline_sql
from minutebook.streaming import ingest as ig, live

EVENT = "event_id long, ts timestamp, event_type string, value double"


def arrivals(df, day: str, path: str, parts: int = 4):
    """Write the rows as groups of files, oldest first; stops after each group."""
    return groups(df, F.floor((F.dayofmonth(day) - 1) / 8), path, parts)


def arrivals_by_id(df, key: str, path: str, parts: int = 4):
    """Write the rows as groups of files, each a range of the ids, lowest first, then rows without one; stops after each group."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    return groups(df, F.floor((F.col(key) - F.lit(low)) * parts / (F.lit(high) - F.lit(low) + 1)), path, parts)


def groups(df, slot, path: str, parts: int):
    slot = F.least(slot, F.lit(parts - 1))
    for k in range(parts):
        df.where(slot == k).write.mode("append").parquet(path)
        yield k


def arrive(df, day: str, path: str, parts: int = 4) -> str:
    """Write the rows as groups of files that arrive one after the other, oldest first."""
    list(arrivals(df, day, path, parts))
    return path


def event_files(spark, sf) -> str:
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    return arrive(events, "ts", scratch_dir(spark, "events"))


def event_stream(spark, path: str):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)


@query("i1_ingest_stream", "SELECT id, date, number, CAST(substr(date, 1, 4) AS INT) AS year FROM legis_items")
def _(spark, sf):
    base = scratch_dir(spark, "ingest")
    mt.write_meetings(fixture(spark, sf, "legis_items"), base + "/in")
    ig.ingest_stream(spark, base + "/in", base + "/out", base + "/cp", files_per_batch=10, lines=True)
    return spark.read.parquet(base + "/out").select("id", "date", "number", "year")


@query("i2_since_high_watermark", """
SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-20 00:00:00')""")
def _(spark, sf):
    e = table(spark, sf, "events")
    stored = e.where("event_type = 'error' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
    return ig.since_high_watermark(e, stored, "event_id").select("event_id")


@query("i3_upsert_stream", """
SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS title, count(*) > 0 AS stored FROM events WHERE user_id <> 0 GROUP BY user_id""")
def _(spark, sf):
    base = scratch_dir(spark, "upserts")
    arrive(table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("title"),
                                             F.struct("ts", "event_id").alias("seq")), "seq.ts", base + "/in")
    stream = (spark.readStream.schema("id long, title string, seq struct<ts:timestamp,event_id:long>")
              .option("maxFilesPerTrigger", 1).parquet(base + "/in"))
    target = ig.DeltaTable(spark, base + "/out", stream.schema, ig.newest_by_id(["title"]))
    ig.upsert_stream(stream, target, base + "/cp")
    return target.read().select("id", "title", F.lit(True).alias("stored"))


@query("i3_keyed_upsert_stream", """
SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS title, max(event_id) >= 0 AS stored FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def _(spark, sf):
    base = scratch_dir(spark, "upserts")
    arrive(table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("title"),
                                             F.struct("ts", "event_id").alias("seq")), "seq.ts", base + "/in")
    stream = (spark.readStream.schema("id long, title string, seq struct<ts:timestamp,event_id:long>")
              .option("maxFilesPerTrigger", 1).parquet(base + "/in"))
    target = KeyedTable(spark, base + "/out", ["id"], stream.schema, buckets=4)
    ig.upsert_keyed_stream(stream, target, "seq", base + "/cp")
    return target.read().select("id", "title", F.lit(True).alias("stored"))


@query("i4_rollup_stream", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def _(spark, sf):
    base = scratch_dir(spark, "rollups")
    stream = event_stream(spark, event_files(spark, sf)).select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    schema = spark.createDataFrame([], "day string, event_type string, n long").schema
    target = ig.DeltaTable(spark, base + "/out", schema, ig.summed(["day", "event_type"]))
    ig.rollup_table_stream(stream, target, ["day", "event_type"], base + "/cp")
    return target.read()


@query("i4_window_stream", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def _(spark, sf):
    base = scratch_dir(spark, "windows")
    # The files of a group cover the same days in no order, so a group makes one batch: file by file, most would come too late.
    for _ in arrivals(table(spark, sf, "events").select("event_id", "ts", "event_type", "value"), "ts", base + "/in"):
        stream = spark.readStream.schema(EVENT).parquet(base + "/in")
        ig.rollup_stream(stream, "ts", ["event_type"], "1 day", "1 hour", base + "/out", base + "/cp")
    return spark.read.parquet(base + "/out").select(F.date_format("period", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("i5_dedupe_stream", "SELECT event_id, event_type FROM events")
def _(spark, sf):
    base = scratch_dir(spark, "dedupe")
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    # Every event is delivered twice. A group makes one batch, as its files cover the same days in no order.
    for _ in arrivals(e.unionByName(e), "ts", base + "/in"):
        stream = spark.readStream.schema(EVENT).parquet(base + "/in")
        ig.dedupe_stream(stream, ["event_id"], "ts", "2 days", base + "/out", base + "/cp")
    return spark.read.parquet(base + "/out").select("event_id", "event_type")


@query("i5_skip_seen_stream", "SELECT user_id AS id, count(*) > 0 AS seen FROM events GROUP BY user_id")
def _(spark, sf):
    base = scratch_dir(spark, "seen")
    table(spark, sf, "events").select(F.col("user_id").alias("id"), F.lit(True).alias("seen")) \
        .repartition(3).write.parquet(base + "/in")
    stream = spark.readStream.schema("id long, seen boolean").option("maxFilesPerTrigger", 1).parquet(base + "/in")
    target = ig.DeltaTable(spark, base + "/out", stream.schema, ig.first_by_key("id", ["seen"]))
    ig.skip_seen_stream(stream, target, "id", base + "/cp")
    return target.read()


@query("i1_ingest_ledger", """
SELECT date, count(*) AS items, CAST(sum(id) AS BIGINT) AS ids FROM legis_items GROUP BY date
UNION ALL SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) + INTERVAL 40 YEAR AS DATE)::VARCHAR, 0, 0 FROM orders""")
def _(spark, sf):
    """Days with and without items, and what came of each."""
    base = scratch_dir(spark, "ledger")
    source = fixture(spark, sf, "legis_items")
    mt.write_meetings(source, base + "/in")
    empty = table(spark, sf, "orders").select(F.add_months(F.to_date("o_orderdate"), 480).cast("string").alias("date")).distinct()
    empty.select("date", F.array().cast("array<struct<id:long>>").alias("data")).coalesce(2).write.mode("append").json(base + "/in/empty")
    store = live.MeetingStore(spark, base + "/out")
    live.ingest_meetings(spark, base + "/in", store, base + "/cp", files_per_batch=20, lines=True)
    ids = store.items.read().groupBy("date").agg(F.sum("id").alias("ids"), F.count("*").alias("stored"))
    days = store.days.read().join(ids, "date", "left")
    return days.where(F.col("items") == F.coalesce("stored", F.lit(0))).select("date", "items", F.coalesce("ids", F.lit(0)).alias("ids"))


@query("i1_stream_rejects", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 1")
def _(spark, sf):
    """Every fourth record is cut off; whole ones are stored, the others are rejects."""
    base = scratch_dir(spark, "rejects")
    whole = F.to_json(F.struct(F.to_date("o_orderdate").cast("string").alias("date"), F.array(F.struct(F.col("o_orderkey").alias("id"))).alias("data")))
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"), F.lit("{")))
                                             .otherwise(whole).alias("value"))
    # Records and remnants alike under the name of JSON files.
    rows.repartition(3).write.option("extension", "json").csv(base + "/in", sep="\t", quote="", escapeQuotes=False)
    store = live.MeetingStore(spark, base + "/out")
    live.ingest_meetings(spark, base + "/in", store, base + "/cp", files_per_batch=1, lines=True)
    return store.rejects.read().select(F.regexp_extract("_corrupt", r"^x(\d+)", 1).cast("long").alias("id"))


@query("i4_update_stream", timeline_sql(4))
def _(spark, sf):
    """The roll-up of all items as they arrive, oldest days not first; the second half comes after a restart."""
    base = scratch_dir(spark, "timeline")
    rows = prepared(spark, sf).select("id", "date", "category", "type_name")
    kind = "id long, date string, category string, type_name string"
    target = live.timeline_table(spark, base + "/out")
    for half in (0, 1):
        rows.where(F.col("id") % 2 == half).repartition(2).write.mode("append").parquet(base + "/in")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(base + "/in")
        live.timeline_stream(stream, target, base + "/cp")
    return live.timeline_of(target).withColumn("actions", flat("actions")).withColumn("types", flat("types"))


@query("i5_store_unseen", "SELECT user_id AS id, min(event_id) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def _(spark, sf):
    base = scratch_dir(spark, "unseen")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", "ts")
    target = KeyedTable(spark, base + "/out", ["id"], rows.schema, buckets=8)
    # What is stored first stays, so events arrive in the order of their ids; a group's files have no order and make one batch.
    for _ in arrivals_by_id(rows, "event_id", base + "/in"):
        stream = spark.readStream.schema("id long, event_id long, ts timestamp").parquet(base + "/in")
        live.store_unseen(stream, target, base + "/cp", "event_id")
    return target.read().select("id", "event_id")
