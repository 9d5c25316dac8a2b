"""Global positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_partitions


def with_positions(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with its dense place in ``order``: ranges are sorted apart, then shifted by the sizes before them."""
    low = (1 << 33) - 1
    scratch = Scratch(df.sparkSession, "ranks")
    sorted_ = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    sorted_ = scratch.save(sorted_, "sorted")
    part = F.shiftright("__at", 33)
    sizes = sorted_.groupBy(part.alias("__part")).agg((F.max(F.col("__at").bitwiseAND(low)) + 1).alias("n")).orderBy("__part").collect()
    total, shifts = start, []
    for r in sizes:
        shifts.append((r["__part"], total))
        total += r["n"]
    table = F.broadcast(df.sparkSession.createDataFrame(shifts, "__part long, __shift long"))
    return sorted_.withColumn("__part", part).join(table, "__part").withColumn(name, F.col("__shift") + F.col("__at").bitwiseAND(low)).drop("__part", "__shift", "__at")
