"""Documents as a stream: files that arrive become checked rows, exactly once per file."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stream_files(spark: SparkSession, folder: str, schema, pattern: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def stream_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of part files."""
    # a stream takes one file by a pattern only, since a plain path has to be a folder
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Processes what there is, batch by batch, and stops. A batch that is run again overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def scratch_folder(spark: SparkSession) -> str:
    """A folder that all executors see, beside the checkpoints; one of this machine only where all run in one process."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return f"{base}/stream-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="pagemill-stream-")
