"""Changes of tables as functions from old and new rows to the resulting table, and versioned snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.sources.tables import keep_first


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those whose key comes anew, and all new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def upsert_touched(old: DataFrame, new: DataFrame, keys: list[str], touched: str, as_of: str) -> DataFrame:
    """upsert() with the time of the change in column ``touched`` of the new rows."""
    return upsert(old, new.withColumn(touched, F.to_timestamp(F.lit(as_of))), keys)


def insert_new(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: rows of ``new`` with an unknown key, the first by ``order`` of each key.
    A NULL key conflicts with nothing."""
    first = keep_first(new.filter(F.col(key).isNotNull()), [key], F.col(order).asc())
    return first.unionByName(new.filter(F.col(key).isNull())).join(old.select(key).distinct(), key, "left_anti").select(*old.columns)


def update_column(table: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The value of ``changes`` where there is one, the old value elsewhere; several changes of a key: the smallest."""
    new = changes.groupBy(*keys).agg(F.min(column).alias("_new"))
    return table.join(new, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*table.columns)


def replace_slice(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Delete all rows whose ``column`` is among the values of ``new``, then insert ``new``."""
    return old.join(new.select(column).distinct(), column, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def next_id(table: DataFrame, key: str) -> DataFrame:
    return table.agg(F.greatest(F.lit(1), F.coalesce(F.max(key), F.lit(0))).cast("long").alias("last_id"))


def missing_rows(wanted: DataFrame, have: DataFrame, key: str, have_key: str) -> DataFrame:
    """Incremental scan: rows of ``wanted`` whose key is not in ``have``."""
    return wanted.join(have.select(F.col(have_key).alias(key)).distinct(), key, "left_anti")


class Snapshots:
    """Named tables as versions under one folder. A version is written beside the others and becomes current by one
    small pointer file, so readers never see half a table, and a lost executor only repeats its own tasks."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, name: str, df: DataFrame, keys: list[str] | None = None, partition: str | None = None) -> str:
        version = uuid.uuid4().hex
        path = f"{self.folder}/{name}/v-{version}"
        out = df.write.option("compression", "zstd")
        (out.partitionBy(partition) if partition else out).parquet(path)
        if keys and self.spark.read.parquet(path).groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{name}: repeated keys {keys}")
        self.spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}/current")
        return path

    def exists(self, name: str) -> bool:
        """Whether a version of the table has become current."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/current")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def merge(self, name: str, new: DataFrame, keys: list[str], touched: str, as_of: str) -> str:
        """Upsert by key into the current version, or the first version; changed rows get the time ``as_of``."""
        rows = new.withColumn(touched, F.to_timestamp(F.lit(as_of)))
        return self.write(name, upsert(self.read(name), rows, keys) if self.exists(name) else rows, keys)

    def read(self, name: str) -> DataFrame:
        version = self.spark.read.text(f"{self.folder}/{name}/current").first()[0]
        return self.spark.read.parquet(f"{self.folder}/{name}/v-{version}")
