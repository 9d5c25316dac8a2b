"""Bounded Arrow batches for rows that carry whole texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_RECORDS = 500


def bound_batches(spark: SparkSession) -> None:
    """Lowers Spark's default of 10,000 rows for a batch, which is 30 MB and more of texts on both sides.

    A value that the user chose is left alone. The setting stays with the session, since results are computed after
    the operator that made them has returned.
    """
    if spark.conf.get(RECORDS) == "10000":
        spark.conf.set(RECORDS, str(TEXT_RECORDS))
