"""Intermediate tables in the folder that driver and executors share: cut lineage, rows that survive a lost executor, removed at the end."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of this machine only where nothing is named and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="geoloom-")
    spark.conf.set("spark.checkpoint.dir", named)
    _roots.append((spark, named))
    return named


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Stored:
    """Tables of one run. A table written under a name again replaces none: the older one is dropped when it is no longer read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        _roots.append((spark, self.root))

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        remove(self.spark, self.root)


@atexit.register
def _clean() -> None:
    for spark, path in _roots:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone
            pass
