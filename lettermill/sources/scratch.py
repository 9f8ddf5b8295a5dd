"""Folders that driver and executors share, tables put there in batches, and streams run over them until all is read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Only where all runs in one process may that be unset; then it becomes a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lettermill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/lettermill/{name}-{uuid.uuid4().hex}"


def streamed(batches: Sequence[DataFrame], files: int = 8) -> DataFrame:
    """A stream that delivers tables of one schema one after another, `files` of their files at a time."""
    spark = batches[0].sparkSession
    path = folder(spark, "stream")
    for df in batches:  # files are read in the order in which they were written
        df.write.mode("append").parquet(path)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def run_through(stream: DataFrame) -> DataFrame:
    """Runs a stream over all there is and gives the table of what came out, written in the shared folder."""
    spark = stream.sparkSession
    path, before = folder(spark, "stream-out"), spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", folder(spark, "stream-state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(stream.schema).parquet(path)
