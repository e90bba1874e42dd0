"""Frames computed once where a plan would read them several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df computed once into spark.checkpoint.dir (a local folder where that is unset, as in tests), so that what follows
    reads it instead of repeating its plan, and lost executors cost nothing of it. Every call computes anew: nothing is
    shared between queries. The size estimate of the plan, a product over its joins, is left behind with it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='riverbend-')}")
    kept = df.checkpoint(eager=True)
    fresh = spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False)
    return type(kept)(fresh, spark)
