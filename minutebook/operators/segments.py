"""A full-text index that follows inserts, updates and deletes.

Every batch writes one segment of its own: postings and lengths of the
documents it brings, and the ids it takes out of earlier segments.  A posting
counts if no later segment names its document.  Segments of about one size
that follow each other are merged, so their number grows with the logarithm of
the index; a merge leaves out what is dead, and the marks as well once
nothing older is left.  Which segments are live is a keyed table, so a batch or a
merge becomes visible at once or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minutebook.operators.fulltext import build_postings, corpus_totals, document_lengths, write_index
from minutebook.operators.tables import materialize
from minutebook.sources.keyed import KeyedTable

SEGMENTS = T.StructType([T.StructField("segment", T.LongType()), T.StructField("folder", T.StringType()),
                         T.StructField("rows", T.LongType())])
FAN = 4


class SegmentedIndex:
    """An index under ``root`` of the text ``fields`` of documents known by ``doc_id``."""

    def __init__(self, spark: SparkSession, root: str, doc_id: str, fields: list[str], fan: int = FAN):
        self.spark, self.root, self.doc_id, self.fields, self.fan = spark, root.rstrip("/"), doc_id, list(fields), fan
        self.live = KeyedTable(spark, f"{self.root}/segments", ["segment"], SEGMENTS, buckets=1)

    def segments(self) -> list:
        """(segment, folder, rows) of the live segments, oldest first; a few for any size of index."""
        return self.live.read().orderBy("segment").collect()

    # --- reading ------------------------------------------------------------

    def _part(self, name: str, segments: list) -> DataFrame | None:
        """Rows of one kind of all segments, with the segment they stand in."""
        out = None
        for s in segments:
            one = self.spark.read.parquet(f"{self.root}/{s['folder']}/{name}")
            one = one if name == "dead" else one.withColumn("segment", F.lit(s["segment"]).cast("long"))
            out = one if out is None else out.unionByName(one)
        return out

    def _alive(self, name: str, segments: list) -> DataFrame:
        rows = self._part(name, segments)
        if rows is None:
            raise ValueError(f"nothing was indexed under {self.root} yet")
        # The last mark of a document decides for all its earlier postings.
        dead = self._part("dead", segments).groupBy(F.col("doc_id").alias("_gone")).agg(F.max("by").alias("_by"))
        match = (F.col("doc_id") == F.col("_gone")) & (F.col("_by") > F.col("segment"))
        return rows.join(dead, match, "left_anti").drop("segment")

    def postings(self) -> DataFrame:
        """As of :func:`fulltext.build_postings`; a condition on ``term`` reaches the files of each segment."""
        return self._alive("postings", self.segments())

    def lengths(self) -> DataFrame:
        return self._alive("lengths", self.segments())

    def totals(self) -> DataFrame:
        return corpus_totals(self.lengths())

    # --- writing ------------------------------------------------------------

    def apply(self, docs: DataFrame | None = None, deleted: DataFrame | None = None, partitions: int | None = None,
              source: str | None = None, batch_id: int | None = None) -> None:
        """Index ``docs``, in place of what is indexed under their ids, and take out the ids of ``deleted``.

        A batch holds each document once.  An id that is deleted and brought
        by one batch is indexed.  A batch told by (``source``, ``batch_id``) is
        applied once.
        """
        if docs is None and deleted is None:
            return
        key = F.col(self.doc_id).alias("doc_id")
        kind = (docs if docs is not None else deleted).schema[self.doc_id].dataType.simpleString()
        marks = None
        if docs is not None:
            docs = materialize(docs.select(self.doc_id, *self.fields), "batch")
            twice = docs.groupBy(self.doc_id).count().where(F.col("count") > 1).limit(3).collect()
            if twice:
                raise ValueError(f"documents occur more than once in a batch: {[r[0] for r in twice]}")
            marks = docs.select(key)
        if deleted is not None:
            marks = deleted.select(key) if marks is None else marks.union(deleted.select(key))
        segments = self.segments()
        number, folder = max([s["segment"] for s in segments], default=0) + 1, f"data/{uuid.uuid4().hex}"
        path = f"{self.root}/{folder}"
        if docs is not None:
            write_index(build_postings(docs, self.doc_id, self.fields), f"{path}/postings", partitions)
            document_lengths(docs, self.doc_id, self.fields).write.parquet(f"{path}/lengths")
        else:
            self.spark.createDataFrame([], f"term string, doc_id {kind}, tf int, positions array<long>").write.parquet(f"{path}/postings")
            self.spark.createDataFrame([], f"doc_id {kind}, length int").write.parquet(f"{path}/lengths")
        marks.distinct().withColumn("by", F.lit(number).cast("long")).write.parquet(f"{path}/dead")
        new = self.spark.createDataFrame([(number, folder, self._rows(path))], SEGMENTS)
        self.live.change(new, lambda old, one: old.unionByName(one), source=source, batch_id=batch_id)
        self.merge()

    def _rows(self, path: str) -> int:
        return sum(self.spark.read.parquet(f"{path}/{name}").count() for name in ("lengths", "dead"))

    def merge(self) -> None:
        """Merge runs of ``fan`` neighbors whose sizes lie within a factor of ``fan``, until there is none."""
        while run := self._run(self.segments()):
            self._merge(run)

    def _run(self, segments: list) -> list:
        for lo in range(len(segments) - self.fan + 1):
            run = segments[lo:lo + self.fan]
            sizes = [max(1, s["rows"]) for s in run]
            if max(sizes) <= self.fan * min(sizes) or sizes[0] <= sum(sizes[1:]):
                return run
        return []

    def _merge(self, run: list) -> None:
        segments = self.segments()
        oldest = segments[0]["segment"] == run[0]["segment"]
        folder, number = f"data/{uuid.uuid4().hex}", run[-1]["segment"]
        path = f"{self.root}/{folder}"
        write_index(self._alive("postings", run), f"{path}/postings")
        self._alive("lengths", run).write.parquet(f"{path}/lengths")
        # Marks are needed only while something older is left.
        dead = self._part("dead", run).groupBy("doc_id").agg(F.max("by").alias("by"))
        (dead.limit(0) if oldest else dead).write.parquet(f"{path}/dead")
        gone = [s["segment"] for s in run]
        new = self.spark.createDataFrame([(number, folder, self._rows(path))], SEGMENTS)
        self.live.change(new, lambda old, one: old.where(~F.col("segment").isin(gone)).unionByName(one))
