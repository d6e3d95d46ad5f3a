"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder that the session's cluster shares; without one a local session uses a temporary folder, any other
    one in the warehouse.

    A checkpoint keeps the size that Spark guessed for df, the product of a join's sides; over rounds that number doubles its digits each time, until planning is all that a
    round does.  So its rows get a plan of their own, without a guess."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.startswith("local"):
            folder = os.path.join(tempfile.gettempdir(), "terracell-checkpoints")
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    rows = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), spark)
