"""Lineage cut with reliable checkpoints, for operators that work level by level."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def materialized(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the checkpoint folder that the session names, in local mode else in a
    temporary one.

    A checkpoint keeps the size that the optimizer estimates, the product of a join's sides, whose digits double with every
    turn of a loop; where it has got beyond 128 bits it is forgotten.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint()
    plan = kept._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() <= 128:
        return kept
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), kept._jdf.schema(), False), spark)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; an error if none is named and there are other machines, which don't see this one's folders."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named
