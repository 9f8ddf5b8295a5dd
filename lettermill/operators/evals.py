"""Measurements of how well extraction and masking did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import names_overlap


def accuracy(results: DataFrame, *fields: str) -> DataFrame:
    """field, correct, total, pct of boolean columns; a null counts as wrong."""
    long = results.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit(False)).alias("ok")) for f in fields])).alias("x")).select("x.*")
    counts = long.groupBy("field").agg(F.count_if("ok").alias("correct"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("pct", F.round(100.0 * F.col("correct") / F.col("total"), 0))


def mean_recall(results: DataFrame, expected: str, overlap: str) -> DataFrame:
    """recall: the mean of overlap over expected; 1 where nothing is expected."""
    return results.agg(F.avg(F.when(F.col(expected) > 0, F.col(overlap) / F.col(expected)).otherwise(1.0)).alias("recall"))


def by_subset(results: DataFrame, category: str, *fields: str) -> DataFrame:
    """Correct answers and cases for all and for each category; the row for all has a null category."""
    return results.rollup(category).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f)).alias(f"{f}_ok") for f in fields])


def name_recall(cases: DataFrame, expected: str = "expected", got: str = "got", latency: str | None = None) -> DataFrame:
    """category, n_expected, n_found, recall, n_spurious and mean latency; a name counts as found if any hit overlaps it."""
    hit = lambda a, b: F.size(F.filter(F.col(a), lambda x: F.exists(F.col(b), lambda y: names_overlap(x, y))))
    per = cases.select("category", F.size(expected).alias("e"), hit(expected, got).alias("f"), (F.size(got) - hit(got, expected)).alias("s"), *([F.col(latency).alias("ms")] if latency else []))
    out = per.groupBy("category").agg(F.sum("e").alias("n_expected"), F.sum("f").alias("n_found"), F.sum("s").alias("n_spurious"), *([F.avg("ms").alias("mean_ms")] if latency else []))
    return out.withColumn("recall", F.when(F.col("n_expected") > 0, F.col("n_found") / F.col("n_expected")).otherwise(1.0))


def accepted(recall: DataFrame, category: str = "bare", least: float = 0.7) -> DataFrame:
    """accepted: whether that category's recall suffices and nothing spurious was found in any."""
    return recall.agg((F.coalesce(F.bool_and(F.when(F.col("category") == category, F.col("recall") >= least)), F.lit(False)) & (F.sum("n_spurious") == 0)).alias("accepted"))


def token_parity(clean: DataFrame, damaged: DataFrame) -> DataFrame:
    """type, n_clean, n_damaged, lost: how many tokens of each type damage cost. Both: (type, n)."""
    both = clean.select("type", F.col("n").alias("n_clean")).join(damaged.select("type", F.col("n").alias("n_damaged")), "type", "full_outer").na.fill(0, ["n_clean", "n_damaged"])
    return both.withColumn("lost", F.greatest(F.col("n_clean") - F.col("n_damaged"), F.lit(0)))


def name_differences(cases: DataFrame, expected: str = "expected", got: str = "got") -> DataFrame:
    """cases with missed (expected names that no hit overlaps) and spurious (hits that overlap no expected name)."""
    apart = lambda a, b: F.filter(F.col(a), lambda x: ~F.exists(F.col(b), lambda y: names_overlap(x, y)))
    return cases.withColumns({"missed": apart(expected, got), "spurious": apart(got, expected)})


def residue_total(residues: DataFrame, column: str = "residue") -> DataFrame:
    """total: how many residues were found."""
    return residues.agg(F.count(F.col(column)).alias("total"))
