"""Sources: record tables, letters as files, fixtures keyed by case, images and web pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.binary import READABLE_IMAGES, mime_or_extension
from ..functions.schedule import Cron
from ..functions.vault import master_key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer partitions than there are: for rows that cost far more to work on than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt over all cores by a key, however few files or row groups it comes from: for rows that cost far more to work on than to move."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def letters(spark: SparkSession, pattern: str) -> DataFrame:
    """file, text: one row per text file."""
    return spark.read.text(pattern, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """case_key, value: one row per entry of a JSON object; keys that begin with _ are comments. value: the entries' DDL type."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("case_key", "raw"))
    return whole.where(~F.col("case_key").startswith("_")).select("case_key", F.from_json("raw", value).alias("value"))


def images(spark: SparkSession, pattern: str) -> DataFrame:
    """path, content, mime, readable: files with their kind, by first bytes or else by extension."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.withColumn("mime", mime_or_extension(F.col("content"), F.col("path"))).withColumn("readable", F.coalesce(F.col("mime").isin(*READABLE_IMAGES), F.lit(False)))


def transcribed(files: DataFrame, read: Callable[[bytes, str], str]) -> DataFrame:
    """files (content, mime) with text, by whatever reader is given; it is called in the tasks, for readable images only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[(read(bytes(c), m) or "").strip() if m in READABLE_IMAGES else None for c, m in zip(b["content"], b["mime"], strict=True)])

    return files.mapInPandas(run, T.StructType([*files.schema.fields, T.StructField("text", T.StringType())]))


def mock_reader(content: bytes, mime: str) -> str:
    """Stands in for a reader: a fixed letter."""
    return "Ausländerbehörde Berlin\nAktenzeichen: ABH-2024-000001\nBitte reichen Sie die Unterlagen bis zum 30.06.2024 ein."


@dataclass(frozen=True)
class Settings:
    """What a run is set to; blank values count as absent."""

    environment: str = "development"
    retention_days: int = 30
    mock_model: bool = True
    reader: str = "mock"
    skip_schedules: bool = False
    master_key: str | None = field(default=None, repr=False)
    deletion_cron: str = "0 3 * * *"

    @classmethod
    def of(cls, values: dict[str, str]) -> Settings:
        v = {k: x.strip() for k, x in values.items() if x and x.strip()}
        flag = lambda k, d: {"true": True, "1": True, "false": False, "0": False}[v[k].lower()] if k in v else d
        out = cls(v.get("ENVIRONMENT", "development"), int(v.get("RETENTION_DAYS", 30)), flag("MOCK_MODEL", True), v.get("READER", "mock"), flag("SKIP_SCHEDULES", False), v.get("MASTER_KEY"), v.get("DELETION_CRON", cls.deletion_cron))
        Cron.read(out.deletion_cron)
        if out.master_key:
            master_key(out.master_key)
        if out.retention_days <= 0:
            raise ValueError("RETENTION_DAYS must be positive")
        if out.environment == "production" and (out.mock_model or not out.master_key):
            raise ValueError("production needs a real model and a master key")
        return out


def polled(spark: SparkSession, fetch: Callable[[int], list[tuple[int, str]]], name: str = "polled") -> DataFrame:
    """A stream of (update_id, value) from a service that is asked for what follows an offset.

    fetch(offset) gives the updates from that offset on, as (update_id, JSON), in order, and bears being asked again. Asking is one
    poller's work by the service's own terms, so it runs on the driver; what it gives is dealt out like any stream. Offsets are kept in
    the stream's checkpoint, so no update is lost or taken twice.
    """

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:  # noqa: N802
            return {"next": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple[int, str]], dict]:
            found = fetch(start["next"])
            return iter(found), {"next": max((i + 1 for i, _ in found), default=start["next"])}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str]]:  # noqa: N802
            return (u for u in fetch(start["next"]) if u[0] < end["next"])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "update_id long, value string"

        def simpleStreamReader(self, schema: T.StructType) -> Reader:  # noqa: N802
            return Reader()

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


def with_files(events: DataFrame, files: DataFrame) -> DataFrame:
    """events with the bytes of the file that each names: content and, where the event tells none, the file's mime. files: file_id, content, mime.

    An event whose file is not there keeps a null content. Only events with a file are joined, so those without are no hot key.
    """
    f = files.select(F.col("file_id").alias("__file"), "content", F.col("mime").alias("__mime"))
    named = events.where(F.col("file.file_id").isNotNull()).join(f, F.col("file.file_id") == F.col("__file"), "left")
    named = named.withColumn("mime", F.coalesce("file.mime", "__mime")).drop("__file", "__mime")
    none = events.where(F.col("file.file_id").isNull()).withColumns({"content": F.lit(None).cast("binary"), "mime": F.lit(None).cast("string")})
    return named.unionByName(none)
