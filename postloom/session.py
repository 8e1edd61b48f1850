"""Sessions, and shipping this package to the executors."""

from __future__ import annotations

import tempfile
import weakref
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per context; a cluster needs no other installation."""
    sc = spark.sparkContext
    if sc not in _shipped:
        root = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="postloom-zip-")) / "postloom_pkg.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*")):
                if p.is_file() and "__pycache__" not in p.parts:
                    z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc)
    return spark


def shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(ship(spark), folder)


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("postloom")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
