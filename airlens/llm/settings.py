"""Session settings of the operators on texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from airlens.session import prepare

# Rows handed to Python at once. Texts may be long, so fewer than Spark's default; results don't depend on it.
ROWS_AT_ONCE = 500


def ready(spark: SparkSession) -> SparkSession:
    """``spark`` with the library's own settings, and batches of texts that fit a Python worker."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    return spark
