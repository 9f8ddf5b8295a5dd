"""Sinks: appended records, chunked messages, approval requests and result files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import MESSAGE_LIMIT, message_parts


def inserted(table: DataFrame, rows: DataFrame, now: Column, key: Column | None = None) -> DataFrame:
    """table with rows added; each gets an id (or `key`) and its times. Without rows nothing changes."""
    new = rows.withColumn("id", F.uuid() if key is None else key)
    for c in ("created_at", "updated_at"):
        if c in table.columns:
            new = new.withColumn(c, now)
    return table.unionByName(new, allowMissingColumns=True).select(*table.columns)


def appended(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def message_chunks(messages: DataFrame, text: str = "text", limit: int = MESSAGE_LIMIT) -> DataFrame:
    """A row for each chunk with part and is_last; buttons go with the last one only."""
    chunks = messages.withColumn("__parts", message_parts(F.col(text), limit))
    return chunks.select(*messages.columns, F.posexplode("__parts").alias("part", "chunk"), (F.size("__parts") - 1).alias("__n")).withColumn("is_last", F.col("part") == F.col("__n")).drop("__n")


def approval_requests(drafts: DataFrame, limit: int = MESSAGE_LIMIT) -> DataFrame:
    """Chunks of title and body; approve and reject callbacks on the last chunk."""
    text = drafts.withColumn("text", F.concat_ws("\n\n", "subject", "body"))
    out = message_chunks(text, "text", limit)
    button = lambda what: F.when(F.col("is_last"), F.concat(F.lit(f"{what}:"), F.col("draft_id")))
    return out.withColumns({"approve": button("approve"), "reject": button("reject")})


def results_file(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def cached(path: str, make: Callable[[], DataFrame], spark, renew: bool = False) -> DataFrame:
    """What is stored at path, or what make gives, stored there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if renew or not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Recorder:
    """A foreachBatch sink for tests: remembers each batch's rows."""

    def __init__(self) -> None:
        self.batches: list[tuple[int, list]] = []

    def __call__(self, df: DataFrame, batch: int) -> None:
        self.batches.append((batch, df.collect()))


class Channel:
    """A foreachBatch sink: hands rows to a port's send(kind, row) where their tasks run, so nothing passes through the driver.

    kind is the row's own column, or the one given. A row that can't be sent doesn't keep others back; a task with such rows fails after
    all are tried, so that Spark sends it again: send has to bear repeats, as with any such sink.
    """

    def __init__(self, send: Callable[[str, dict], None], kind: str | None = None) -> None:
        self.send, self.kind = send, kind

    def __call__(self, df: DataFrame, batch: int) -> None:
        send, kind = self.send, self.kind

        def each(rows: Iterator[Row]) -> None:
            errors = []
            for r in rows:
                try:
                    send(kind or r["kind"], r.asDict(recursive=True))
                except Exception as e:  # one row's error is not the others'
                    errors.append(repr(e))
            if errors:
                raise RuntimeError(f"{len(errors)} rows were not sent, the first for {errors[0]}")

        df.foreachPartition(each)


class Outbox:
    """A foreachBatch sink that sends rows one by one and sends again only those that failed.

    Each row's outcome is written under its batch in the folder `path`, with the number of its tries. With a batch go the rows of the one before
    that failed fewer than `tries` times. A batch whose outcomes are there already is not sent again, so a stream may repeat it. A failing
    send never fails its task; only a task that is lost between sending and writing sends its rows again, and so send(key, row) gets the key
    by which a receiver can tell. Of rows of one key in a batch one is sent; see events.unrepeated for repeats between batches.
    """

    MARKS = "outbox_try int, outbox_sent boolean, outbox_error string"

    def __init__(self, path: str, send: Callable[[str, dict], None], key: str = "event_id", tries: int = 5) -> None:
        self.path, self.send, self.key, self.tries = path, send, key, tries

    def _done(self, spark: SparkSession) -> list[str]:
        """Names of the batches whose outcomes are complete, in order."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in files.listStatus(root)) if files.exists(root) else []
        return [n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def outcomes(self, spark: SparkSession) -> DataFrame | None:
        """All outcomes, a row for each try; None before the first batch."""
        done = self._done(spark)
        return spark.read.parquet(*[f"{self.path}/{n}" for n in done]) if done else None

    def _failed(self, spark: SparkSession, names: list[str]) -> DataFrame | None:
        if not names:
            return None
        return spark.read.parquet(f"{self.path}/{names[-1]}").where(~F.col("outbox_sent") & (F.col("outbox_try") < self.tries)).drop("outbox_sent", "outbox_error")

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        names, name = self._done(spark), f"{batch:012d}-000"
        if name in names:
            return
        self._sent(df.withColumn("outbox_try", F.lit(0)), self._failed(spark, [n for n in names if n < name]), name)

    def again(self, spark: SparkSession) -> int:
        """Sends what the last batch left, and returns how many rows are still to be sent."""
        names = self._done(spark)
        failed = self._failed(spark, names)
        if failed is None or failed.isEmpty():
            return 0
        batch, _, turn = names[-1].partition("-")
        self._sent(failed, None, f"{batch}-{int(turn) + 1:03d}")
        return self._failed(spark, self._done(spark)).count()

    def _sent(self, rows: DataFrame, failed: DataFrame | None, name: str) -> None:
        send, key = self.send, self.key
        rows = rows.dropDuplicates([key])
        if failed is not None:
            rows = rows.join(failed.select(key), key, "left_anti").select(*rows.columns).unionByName(failed)
        plain = [c for c in rows.columns if c != "outbox_try"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sent, errors = [], []
                for row in b.select(plain).to_pylist():
                    try:
                        send(str(row[key]), row)
                        errors.append(None)
                    except Exception as e:  # one row's error is not the others'
                        errors.append(f"{type(e).__name__}: {e}")
                    sent.append(errors[-1] is None)
                tries = pa.array([t + 1 for t in b.column("outbox_try").to_pylist()], pa.int32())
                columns = [b.column(c) for c in plain]
                yield pa.RecordBatch.from_arrays([*columns, tries, pa.array(sent, pa.bool_()), pa.array(errors, pa.string())], [*plain, "outbox_try", "outbox_sent", "outbox_error"])

        kind = StructType([*rows.select(*plain).schema.fields, *StructType.fromDDL(self.MARKS).fields])
        rows.select(*plain, "outbox_try").mapInArrow(run, kind).write.mode("overwrite").parquet(f"{self.path}/{name}")


def document_messages(documents: DataFrame, caption: str = "caption") -> DataFrame:
    """What a channel needs to send documents: kind, user, name, mime, content, caption. Documents without content are no messages."""
    named = F.coalesce("name", F.concat(F.lit("document."), F.coalesce(F.element_at(F.split("mime", "/"), -1), F.lit("bin"))))
    return documents.where(F.octet_length("content") > 0).select(F.lit("document").alias("kind"), "user", named.alias("name"), "mime", "content", F.coalesce(caption, F.lit("")).alias("caption"))
