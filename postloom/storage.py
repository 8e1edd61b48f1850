"""Cutting lineage and checking sizes, in ways that survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup side that may be broadcast; beyond it operators take a shuffled join.
BROADCAST_ROWS = 2_000_000
#: Tables written by cut(), by application.
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``; only where none is set, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if sc.getCheckpointDir():
            return str(sc.getCheckpointDir())
        if sc.master.startswith("local[") or sc.master == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="postloom-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_postloom"
        sc.setCheckpointDir(folder)
    return str(folder)


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that later stages depend on files only."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label))


def written(df: DataFrame, label: str = "step") -> str:
    """Where ``df`` was written as Parquet in the shared folder, as a path that tasks can give to stored()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/postloom-{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())


def stored(path: str, *columns: str) -> Iterator[pa.RecordBatch]:
    """The batches of a table at written(), read by the task itself: they pass neither the driver nor a broadcast."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    fs, folder = pyarrow.fs.FileSystem.from_uri(path)
    for file in sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if x.base_name.endswith(".parquet")):
        with fs.open_input_file(file) as f:
            yield from pq.ParquetFile(f).iter_batches(columns=list(columns))


def release(spark: SparkSession) -> int:
    """Delete what cut() has written in this application; for callers that have written or collected all their results.
    Gives the number of tables deleted."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder, pruned to ``columns`` at the scan; clashing or extra columns are never read."""
    df = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).agg(F.count("*").alias("n")).first()["n"] <= rows


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when a small input has fewer partitions than those; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
