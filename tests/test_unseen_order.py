"""The event stored for an id is its lowest, in whatever order days and files hold the events."""

from pyspark.sql import functions as F

from minutebook.plans.catalog import QUERIES


def test_lowest_event_is_stored(spark, tmp_path):
    rows = [(e, f"2024-01-{1 + (e * 17) % 30:02d} 10:00:00", e % 7) for e in range(60)]
    rows += [(100, "2024-01-01 00:00:00", None), (None, "2024-01-01 00:00:00", 3), (None, None, 8), (101, None, 9)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.to_timestamp("ts"))
    events.orderBy(F.desc("event_id")).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: r.event_id for r in QUERIES["i5_store_unseen"](spark, str(tmp_path)).collect()}
    assert got == {**{u: u for u in range(7)}, 8: None, 9: 101}
