"""Record tables in folders by a hash of their key, so that a change reads and writes only the folders of the keys that it changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The partition column, and how many folders a table has unless it is told otherwise.
BUCKET, BUCKETS = "bucket", 256


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def written_by_key(table: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Writes a table in folders by its key's hash, a file for each."""
    table.withColumn(BUCKET, _bucket(key, buckets)).repartition(buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_by_key(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def found_by_key(spark: SparkSession, path: str, key: str, values: list, buckets: int = BUCKETS) -> DataFrame:
    """The rows of those keys; only their folders are read."""
    kind = spark.read.parquet(path).schema[key].dataType
    wanted = [r.b for r in spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v").cast(kind).alias(key)).select(_bucket(key, buckets).alias("b")).distinct().collect()]
    return spark.read.parquet(path).where(F.col(BUCKET).isin(wanted)).where(F.col(key).cast("string").isin([str(v) for v in values])).drop(BUCKET)


def changed_by_key(spark: SparkSession, path: str, changes: DataFrame, key: str, change: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> int:
    """Replaces the folders of the keys in `changes` by change(their rows, changes), and returns how many folders that were.

    change is a function of tables, as store.patched, store.upserted and store.without are; it must leave rows of other keys as they are.
    changes is read twice. The numbers of the folders, at most `buckets`, pass through the driver.
    """
    touched = sorted(r.b for r in changes.where(F.col(key).isNotNull()).select(_bucket(key, buckets).alias("b")).distinct().collect())
    if not touched:
        return 0
    whole = spark.read.parquet(path)
    old = whole.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    new = change(old, changes).withColumn(BUCKET, _bucket(key, buckets)).repartition(min(buckets, len(touched)), BUCKET)
    aside = f"{path.rstrip('/')}.changed"
    new.write.mode("overwrite").partitionBy(BUCKET).parquet(aside)
    target = spark._jvm.org.apache.hadoop.fs.Path
    files = target(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for b in touched:  # a folder that got no rows just goes
        made, kept = target(f"{aside}/{BUCKET}={b}"), target(f"{path}/{BUCKET}={b}")
        files.delete(kept, True)
        if files.exists(made):
            files.rename(made, kept)
    files.delete(target(aside), True)
    return len(touched)
