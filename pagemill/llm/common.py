"""Helpers the operators share: scratch space, hidden column names, block folds."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of columns the operators add for themselves, so that user columns cannot clash.
HIDE = "__pm_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where all run in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagemill-"))
    return sc.getCheckpointDir()


def _unestimated(df: DataFrame) -> DataFrame:
    """A checkpointed ``df`` without an estimate of its size that no longer fits a long (such a table is not broadcast either way)."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    plan = df._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes() < 1 << 63:
        return df
    none, session = jvm.scala.Option.empty(), spark._jsparkSession
    sql = jvm.org.apache.spark.sql
    bare = sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, none, none)
    return DataFrame(sql.classic.Dataset.ofRows(session, bare), spark)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: lineage ends here.

    What led to it is garbage then; Spark deletes shuffle files when the driver's
    JVM collects, which a long plan should not leave to chance. So does the estimate of
    the size: Spark keeps it, a join multiplies those of its sides, and in a loop of
    joins its digits double each round until they fill the driver's memory.
    """
    scratch(df.sparkSession)
    out = _unestimated(df.checkpoint(eager=True))
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
