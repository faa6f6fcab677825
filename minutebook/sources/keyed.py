"""Stored tables with a key: changed bucket by bucket, one version after the other.

Rows lie in buckets by a hash of their key.  A change reads and rewrites only
the buckets that its batch touches, into a folder of its own.  A version is a
few rows of the manifest, one for each bucket and its folder, added as one
file: until it is there readers see the version before, and a change that
fails leaves files that nobody reads.  Files of older versions stay, so readers
that began earlier go on undisturbed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.utils import AnalysisException

from minutebook.operators.tables import materialize

MANIFEST = "version long, writer string, bucket int, folder string, columns string, source string, batch long"


class KeyViolation(ValueError):
    """Rows of a change share a key or lack one."""


class Conflict(RuntimeError):
    """Another change was stored first; this one left no trace and can be tried again."""


class KeyedTable:
    """A table under ``root`` whose rows have unique, complete ``key`` values.

    ``schema`` may have more columns than earlier versions, whose rows then
    hold nulls there; columns cannot go or change their type.  ``buckets`` is
    fixed by the first change; later ones take it from the table.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], schema: StructType, buckets: int = 64):
        self.spark, self.root, self.key, self.schema, self.buckets = spark, root.rstrip("/"), list(key), schema, buckets
        if missing := [k for k in key if k not in schema.names]:
            raise ValueError(f"the schema lacks the key columns {missing}")

    # --- versions -----------------------------------------------------------

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException:  # nothing was stored yet
            return self.spark.createDataFrame([], MANIFEST)

    def versions(self) -> DataFrame:
        """(version, writer) of every stored version; of two that raced for a number the first by name counts."""
        return self._manifest().groupBy("version").agg(F.min("writer").alias("writer"))

    def version(self) -> int:
        """Number of the current version, 0 before the first change."""
        return self.versions().agg(F.max("version")).first()[0] or 0

    def _folders(self, version: int) -> list:
        """One row for each bucket of a version."""
        rows = self._manifest().where(F.col("version") == version)
        first = rows.agg(F.min("writer")).scalar()
        return rows.where(F.col("writer") == first).select("bucket", "folder", "columns").collect()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the current or of an earlier version."""
        return self._rows([r["folder"] for r in self._folders(self.version() if version is None else version)])

    def _rows(self, folders: list[str | None]) -> DataFrame:
        paths = [f"{self.root}/{f}" for f in folders if f]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # --- changes ------------------------------------------------------------

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def _checked_schema(self, stored: str | None) -> None:
        if stored is None:
            return
        now = {f.name: f.dataType for f in self.schema.fields}
        for f in StructType.fromJson(json.loads(stored)).fields:
            if f.name not in now:
                raise ValueError(f"the stored table has a column {f.name} that the schema lacks")
            if now[f.name] != f.dataType:
                raise ValueError(f"column {f.name} is stored as {f.dataType.simpleString()}, not {now[f.name].simpleString()}")

    def change(self, batch: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], source: str | None = None,
               batch_id: int | None = None) -> int:
        """Store ``how(rows, batch)`` as the next version and return its number.

        ``rows`` are the rows of the buckets in which the batch has keys;
        ``how`` must keep rows whose keys the batch does not have, and may drop
        or add others only under keys of the batch.  ``batch`` has the key
        columns.  A null or repeated key in the result refuses the change.
        A change told by (``source``, ``batch_id``) is stored once: repeating
        it changes nothing.
        """
        manifest = self._manifest()
        if source is not None:
            done = manifest.where((F.col("source") == source) & (F.col("batch") == batch_id)).agg(F.min("version")).first()[0]
            if done is not None:
                return done
        batch, current = materialize(batch, "batch"), self.version()
        folders = self._folders(current) if current else []
        buckets = len(folders) or self.buckets
        self._checked_schema(folders[0]["columns"] if folders else None)
        old = {r["bucket"]: r["folder"] for r in folders}
        touched = sorted(r[0] for r in batch.select(self._bucket(buckets)).distinct().collect())  # at most one row for each bucket
        writer = uuid.uuid4().hex
        data = f"data/{writer}"
        changed = how(self._rows([old.get(b) for b in touched]), batch).select(
            *(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields)).withColumn("_bucket", self._bucket(buckets))
        # Ranges of (bucket, key): a large bucket is spread over tasks, small ones share a task.
        (changed.repartitionByRange("_bucket", *self.key).write.partitionBy("_bucket").parquet(f"{self.root}/{data}"))
        written = self._written(data)
        self._check_keys(written)
        filled = {r[0] for r in written.select("_bucket").distinct().collect()}
        if astray := filled - set(touched):
            raise ValueError(f"the change made rows in buckets {sorted(astray)[:5]} that its batch does not touch")
        new = dict(old) | {b: f"{data}/_bucket={b}" if b in filled else None for b in touched}
        rows = [(current + 1, writer, b, new.get(b), json.dumps(self.schema.jsonValue()), source, batch_id) for b in range(buckets)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        if self.versions().where(F.col("version") == current + 1).first()["writer"] != writer:
            raise Conflict(f"version {current + 1} was stored by another change")
        return current + 1

    def _written(self, data: str) -> DataFrame:
        kind = StructType([*self.schema.fields]).add("_bucket", IntegerType())
        try:
            return self.spark.read.schema(kind).parquet(f"{self.root}/{data}")
        except AnalysisException:  # no row was left
            return self.spark.createDataFrame([], kind)

    def _check_keys(self, rows: DataFrame) -> None:
        gone = None
        for k in self.key:
            gone = F.col(k).isNull() if gone is None else gone | F.col(k).isNull()
        bad = rows.groupBy(*self.key).agg(F.count("*").alias("n")).where(gone | (F.col("n") > 1)).limit(3).collect()
        if bad:
            raise KeyViolation(f"keys {self.key} must be complete and unique, found {[tuple(r[k] for k in self.key) for r in bad]}")

    # --- kinds of changes ---------------------------------------------------

    def upsert(self, batch: DataFrame, order: str | Column | None = None, **told) -> int:
        """Rows of the batch take the place of rows with their key; of several the one of highest ``order``."""
        def how(old: DataFrame, new: DataFrame) -> DataFrame:
            last = one_of(new, self.key, self.schema.names, F.max_by, order)
            return old.join(last.select(*self.key), self.key, "left_anti").unionByName(last)
        return self.change(batch, how, **told)

    def insert_new(self, batch: DataFrame, order: str | Column | None = None, **told) -> int:
        """Rows of the batch whose key is new, of several the one of lowest ``order``."""
        return self.change(batch, lambda old, new: old.unionByName(one_of(new, self.key, self.schema.names, F.min_by, order).join(
            old.select(*self.key), self.key, "left_anti")), **told)

    def keep_newest(self, batch: DataFrame, order: str | Column, **told) -> int:
        """Of each key the row of highest ``order`` among stored rows and rows of the batch."""
        return self.change(batch, lambda old, new: one_of(old.unionByName(new.select(*old.columns)), self.key, self.schema.names,
                                                          F.max_by, order), **told)

    def delete(self, keys: DataFrame, **told) -> int:
        return self.change(keys, lambda old, gone: old.join(gone.select(*self.key), self.key, "left_anti"), **told)


def one_of(rows: DataFrame, key: list[str], names: list[str], pick: Callable, order: str | Column | None) -> DataFrame:
    """One row for each key; ``pick`` is max_by or min_by."""
    rest = [c for c in names if c not in key]
    if not rest:
        return rows.select(*key).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in rest))
    return rows.groupBy(*key).agg(pick(row, F.lit(0) if order is None else order).alias("_r")).select(*key, "_r.*")
