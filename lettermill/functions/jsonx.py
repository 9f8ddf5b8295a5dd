"""Model output: the JSON in it, its validity, and the stand-in model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT = "struct<label:string,explanation:string,where_to_get:string,required:boolean>"
ANALYSIS = f"struct<authority:string,request_type:string,summary:string,deadline_token:string,risk_level:string,missing_documents:array<{DOCUMENT}>,next_steps:array<string>,confidence:double,in_scope:boolean>"
DRAFT = "struct<subject:string,body:string,placeholders:array<string>>"
TOKEN_SHAPE = r"^\[\[[A-Z]+_[0-9]+\]\]$"
#: How often an answer that fails is asked for again.
REPAIRS = 1


def json_payload(text: Column) -> Column:
    """What is between the first fence and its end, if there is one, and of that from the first { to the last }."""
    t = F.trim(text)
    fence = r"(?is)```(?:json)?\s*(.*?)```"
    body = F.when(t.rlike(fence), F.trim(F.regexp_extract(t, fence, 1))).otherwise(t)
    first = F.instr(body, "{")
    last = F.length(body) - F.instr(F.reverse(body), "}") + 1
    return F.when((first > 0) & F.contains(body, F.lit("}")) & (last > first), F.substr(body, first, last - first + 1)).otherwise(body)


def analysis_errors(a: Column) -> Column:
    """The names of what an analysis lacks or has wrong; empty if it is valid."""
    filled = lambda c: F.coalesce(F.length(c) >= 1, F.lit(False))
    docs_ok = F.coalesce(F.forall(a["missing_documents"], lambda d: filled(d["label"]) & d["required"].isNotNull()), F.lit(False))
    checks = {
        "json": a.isNotNull(), "authority": filled(a["authority"]), "request_type": filled(a["request_type"]), "summary": filled(a["summary"]),
        "deadline_token": a["deadline_token"].isNull() | a["deadline_token"].rlike(TOKEN_SHAPE), "risk_level": F.coalesce(a["risk_level"].isin("low", "medium", "high", "critical"), F.lit(False)),
        "missing_documents": docs_ok, "next_steps": a["next_steps"].isNotNull(), "confidence": F.coalesce(a["confidence"].between(0, 1), F.lit(False)), "in_scope": a["in_scope"].isNotNull(),
    }
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda e: e.isNotNull())


def parsed_analysis(df: DataFrame, answer: str) -> DataFrame:
    """df with analysis (unknown keys dropped), errors and ok."""
    payload = json_payload(F.col(answer))
    parsed = df.withColumn("analysis", F.when(F.get_json_object(payload, "$").isNotNull(), F.from_json(payload, ANALYSIS)))
    parsed = parsed.withColumn("errors", analysis_errors(F.col("analysis")))
    return parsed.withColumn("ok", F.size("errors") == 0)


def repaired(df: DataFrame, answer: str, ask_again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Invalid answers are asked for once more; ask_again gets those rows and returns them with `answer` anew. Valid rows are not asked about."""
    first = parsed_analysis(df, answer)
    again = parsed_analysis(ask_again(first.where(~F.col("ok")).select(*df.columns)), answer)
    return first.where("ok").unionByName(again)


def first_token(text: Column, kind: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"\[\[{kind}_[0-9]+\]\]", 0), F.lit(""))


def stand_in_analysis(text: Column) -> Column:
    """What the stand-in model answers to a masked letter: fixed but for its first date token and the risk that follows from it."""
    date = first_token(text, "DATE")
    doc = lambda label, needed: F.struct(F.lit(label).alias("label"), F.lit("stand-in").alias("explanation"), F.lit(None).cast("string").alias("where_to_get"), F.lit(needed).alias("required"))
    return F.struct(
        F.lit("unknown authority").alias("authority"), F.lit("documents").alias("request_type"), F.lit("stand-in summary").alias("summary"), date.alias("deadline_token"),
        F.when(date.isNotNull(), "medium").otherwise("low").alias("risk_level"), F.array(doc("passport copy", True), doc("registration", False)).alias("missing_documents"),
        F.array(F.lit("collect documents"), F.lit("answer in time")).alias("next_steps"), F.lit(0.42).alias("confidence"), F.lit(True).alias("in_scope"),
    )


def stand_in_draft(text: Column) -> Column:
    """The stand-in draft: greets the letter's first name token, or nobody in particular."""
    name = first_token(text, "NAME")
    body = F.concat_ws("\n", F.lit("Sehr geehrte Damen und Herren,"), F.lit("anbei erhalten Sie die angeforderten Unterlagen."), F.lit("Mit freundlichen Grüßen"), name)
    return F.struct(F.lit("Ihr Schreiben").alias("subject"), body.alias("body"), F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>")).alias("placeholders"))
