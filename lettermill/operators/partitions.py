"""Tables laid out by the time at which their rows expire, and writes that are checked before they count."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import CASCADE, ENUMS, SCHEMAS, draft_gate

#: The partition column, and what stands in it for rows that never expire.
DAY, NEVER = "expires", "never"


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _unit(time: Column, unit: str) -> Column:
    """The UTC day or month of a time as text that sorts by time, whatever the session's zone."""
    day = F.date_from_unix_date(F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(86_400_000_000)).cast("int")).cast("string")
    return day if unit == "day" else F.substring(day, 1, 7)


def written_by_expiry(table: DataFrame, path: str, column: str = "delete_after", unit: str = "day") -> None:
    """Writes a table into a folder for each day or month in which its rows expire. A unit with very many rows is written by several tasks; rows without a time never expire."""
    day = F.coalesce(_unit(F.col(column), unit), F.lit(NEVER))
    table.withColumn(DAY, day).hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY).parquet(path)


def _folders(spark: SparkSession, path: str) -> dict[str, object]:
    """Of a table of written_by_expiry: its units and their folders."""
    target, files = _path(spark, path)
    found = [s.getPath() for s in files.listStatus(target) if s.isDirectory()]
    return {p.getName().partition("=")[2]: p for p in found if p.getName().startswith(f"{DAY}=")}


def purged_by_expiry(spark: SparkSession, path: str, now: Column, column: str = "delete_after", unit: str = "day") -> int:
    """Removes expired rows from a table of written_by_expiry and returns their number.

    Folders before that of now go whole, and are counted from their files' footers; only now's own is read, and overwritten by what
    stays. Rows expire strictly before now. Run again after a failure, it goes on where it stopped.
    """
    border, folders = spark.range(1).select(_unit(now, unit).alias("d")).first().d, _folders(spark, path)
    past = [u for u in folders if u < border and u != NEVER]
    n = 0
    if folders:
        table = spark.read.parquet(path).withColumn(DAY, F.col(DAY).cast("string"))
        n = table.where((F.col(DAY) < border) & (F.col(DAY) != NEVER)).count()
    if border in folders:
        edge = table.where(F.col(DAY) == border)
        stays = edge.where(~F.coalesce(F.col(column) < now, F.lit(False)))
        had, kept = edge.count(), stays.count()
        n += had - kept
        if 0 < kept < had:
            stays.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
        past += [border] if not kept else []
    _, files = _path(spark, path)
    for u in past:
        files.delete(folders[u], True)
    return n


class RefusedError(ValueError):
    """A write that would break constraints; counts says how many rows break which."""

    def __init__(self, name: str, counts: dict[str, int]):
        super().__init__(f"{name} was not written: " + ", ".join(f"{n} rows with {what}" for what, n in counts.items()))
        self.counts = counts


def violations(rows: DataFrame, name: str, parents: Mapping[str, DataFrame], before: DataFrame | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """(rows with what the checks need beside them, the checks: what is wrong with a row, as a condition).

    A row needs an id that no other row has; enumerated columns hold what they may; foreign keys of tables given as parents name rows of those
    or nothing; a draft is sent only from approved, as `before`, the table as it was, has it.
    """
    checks = {"no id": F.col("id").isNull(), "repeated id": F.col("id").isNotNull() & (F.col("__same") > 1)}
    rows = rows.withColumn("__same", F.count(F.lit(1)).over(W.partitionBy("id")))
    for (table, column), allowed in ENUMS.items():
        if table == name and column in rows.columns:
            checks[f"unknown {column}"] = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
    for child, column, parent in CASCADE:
        if child == name and parent in parents and column in rows.columns:
            ids = parents[parent].select(F.col("id").alias(f"__{column}")).distinct()
            rows = rows.join(ids, F.col(column) == F.col(f"__{column}"), "left")
            checks[f"unknown {column}"] = F.col(column).isNotNull() & F.col(f"__{column}").isNull()
    if name == "drafts" and before is not None:
        was = before.select(F.col("id").alias("__id"), F.col("status").alias("__status"), F.col("approved_at").alias("__approved_at"))
        rows = rows.join(was, F.col("id") == F.col("__id"), "left")
        told = draft_gate(F.when(F.col("__id").isNotNull(), F.coalesce("__status", F.lit("draft"))), F.col("__approved_at"), F.col("status"))
        unchanged = F.coalesce(F.col("__status") == "sent", F.lit(False))
        checks["sent without approval"] = told.isNotNull() & ~unchanged
    return rows, {what: F.coalesce(bad, F.lit(False)) for what, bad in checks.items()}


def checked_write(rows: DataFrame, name: str, path: str, parents: Mapping[str, DataFrame] | None = None, before: DataFrame | None = None) -> int:
    """Writes a record table to path if all its constraints hold, and returns its number of rows; else RefusedError, and what was there stays.

    Columns have to be those of SCHEMAS that the table has, of their types. What breaks a constraint is counted in the pass that writes the
    rows beside the table; only without such rows that becomes the table, by renaming. In a store that cannot rename a folder at once,
    readers have to be kept away meanwhile.
    """
    spark = rows.sparkSession
    known = {f.name: f.dataType for f in StructType.fromDDL(SCHEMAS[name])}
    wrong = [f.name for f in rows.schema.fields if known.get(f.name) != f.dataType]
    if wrong or "id" not in rows.columns:
        raise ValueError(f"{name} has no such columns: {', '.join(wrong) or 'id is missing'}")
    columns, seen, aside = rows.columns, Observation(), f"{path}.new-{uuid.uuid4().hex}"
    beside, checks = violations(rows, name, parents or {}, before)
    named = {f"check{k}": what for k, what in enumerate(checks)}
    marked = beside.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(bad).alias(k) for k, bad in zip(named, checks.values(), strict=True)])
    marked.select(*columns).write.parquet(aside)
    counts = seen.get
    broken = {what: counts[k] for k, what in named.items() if counts[k]}
    new, files = _path(spark, aside)
    if broken:
        files.delete(new, True)
        raise RefusedError(name, broken)
    old, _ = _path(spark, path)
    gone, _ = _path(spark, f"{path}.old-{uuid.uuid4().hex}")
    if files.exists(old):
        files.rename(old, gone)
    files.rename(new, old)
    files.delete(gone, True)
    return counts["rows"]
