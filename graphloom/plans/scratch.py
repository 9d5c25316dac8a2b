"""Intermediate tables in the folder that the driver and all executors share.

Iterative plans and multi-pass operators cut their lineage by writing Parquet below
``spark.checkpoint.dir``. The files survive a lost executor, unlike cached blocks. What a result still reads
stays until the session's Python process ends; the rest goes as soon as no later step reads it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Row groups are held in memory until they are whole; tables with texts or sets fill them quickly.
ROW_GROUP_BYTES = 16 << 20
#: After a table that took so long, shuffles that no one will read again are freed.
LONG_SECONDS = 3.0


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/graphloom-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(spark: SparkSession, root: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, root)
        elif root.startswith("file://"):
            shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)
    except Exception:  # noqa: BLE001 - the gateway may be gone by then; the folder is then the cluster's to clear
        pass


class Scratch:
    """Named Parquet tables of one run; ``drop`` frees those no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        atexit.register(_delete_at_exit, spark, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        since = time.monotonic()
        df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
        if time.monotonic() - since > LONG_SECONDS:
            # Spark deletes the shuffles of past jobs only when the driver collects its garbage, which may be hours later.
            self.spark._jvm.System.gc()
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                _delete(self.spark, path)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*[n for n in self.paths if n not in names])
