"""Letters as a projection of orders and customers, and the plan from letter to analysis and reminders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import escalated, german_date, reminder_dates
from ..functions.jsonx import analysis_errors, stand_in_analysis
from ..operators.masking import leaks, masked
from ..sources.tables import dealt, table

#: What letters are made of. Names are no words of the stop list, streets and cities no parts of mail addresses.
GIVEN = ("Ahmet", "Leyla", "Mehmet", "Elif", "Kemal")
FAMILY = ("Yilmaz", "Kaplan", "Demirel", "Toprak", "Korkmaz")
STREETS = ("Torstraße", "Lindenweg", "Kastanienallee", "Marktplatz", "Brunnengasse")
CITIES = ("Berlin", "Hamburg", "Potsdam", "Leipzig", "Bremen")
PRIORITY_RISK = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "low", "5-LOW": "low"}


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One letter for each order: o_orderkey, c_custkey, its parts and text."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_custkey", "o_orderdate", "o_orderpriority",
        F.concat_ws(" ", pick(GIVEN, F.col("c_nationkey")), pick(FAMILY, F.floor(F.col("c_nationkey") / 5))).alias("name"),
        F.concat(pick(STREETS, F.col("c_custkey")), F.lit(" "), (F.col("c_custkey") % 90 + 1).cast("string")).alias("street"),
        F.concat((F.col("c_custkey") % 80000 + 10000).cast("string"), F.lit(" "), pick(CITIES, F.col("c_custkey"))).alias("town"),
        F.concat(F.lit("ABH-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("file_number"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("deadline_text"),
        F.concat(F.lit("kunde"), F.col("c_custkey").cast("string"), F.lit("@mail.example")).alias("email"),
    )
    return dealt(rows, "o_orderkey").withColumn("text", letter(*[F.col(c) for c in ("name", "street", "town", "file_number", "deadline_text", "email")]))


def letter(name: Column, street: Column, town: Column, file_number: Column, deadline: Column, email: Column) -> Column:
    lines = [
        F.lit("Ausländerbehörde"), F.concat(F.lit("Herrn "), name), street, town, F.lit(""), F.concat(F.lit("Aktenzeichen: "), file_number),
        F.concat(F.lit("Bitte reichen Sie die Unterlagen bis zum "), deadline, F.lit(" ein.")), F.concat(F.lit("Kontakt: "), email), F.lit("Mit freundlichen Grüßen"),
    ]
    return F.array_join(F.array(*lines), "\n")


def analysed(docs: DataFrame, now: Column, text: str = "text", profile: str | None = None) -> DataFrame:
    """docs masked and analysed: masked_text, matches, leaks, ok, deadline, risk, reminders.

    The stand-in model sees masked text only, and only where nothing leaks. Its deadline token is looked up among the matches and read as a
    German date; risk rises as it comes near; reminders are due before it.
    """
    m = masked(docs, text, profile)
    m = m.withColumn("leaks", leaks(F.col("masked_text"), F.col("matches")))
    a = m.withColumn("analysis", F.when(F.size("leaks") == 0, stand_in_analysis(F.col("masked_text"))))
    a = a.withColumn("ok", F.size(analysis_errors(F.col("analysis"))) == 0)
    original = F.filter("matches", lambda x: x["token"] == F.col("analysis.deadline_token"))
    a = a.withColumn("deadline", german_date(F.get(original, F.lit(0))["original"]))
    return a.withColumn("risk", escalated(F.col("analysis.risk_level"), F.col("deadline"), now)).withColumn("reminders", reminder_dates(F.col("deadline"), now))
