"""Chat updates as events, their routing, and the keyed state machines, in batch and as streams."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import ANSWER_LIMIT, approval, command, command_meaning

UPDATE = (
    "struct<update_id:long,callback_query:struct<data:string,chat_id:string>,message:struct<chat_id:string,text:string,caption:string,"
    "photo:array<struct<file_id:string,width:int>>,document:struct<file_id:string,mime_type:string,file_name:string>>,"
    "edited_message:struct<chat_id:string,text:string,caption:string,photo:array<struct<file_id:string,width:int>>,document:struct<file_id:string,mime_type:string,file_name:string>>>"
)
#: States of a draft: from which each command may be given, and where it leads.
DRAFT_MOVES = {"present": ({"draft"}, "pending_approval"), "approve": ({"draft", "pending_approval", "approved"}, "approved"), "reject": ({"draft", "pending_approval", "rejected"}, "rejected"), "send": ({"approved"}, "sent")}
ONBOARDING = ("name", "address", "city", "done")


def authenticated(requests: DataFrame, secret: str | None) -> DataFrame:
    """Requests that carry the secret; without one set none pass. Digests are compared, so how long it takes says nothing about the secret."""
    return requests.where(F.sha2(F.col("secret"), 256) == hashlib.sha256(secret.encode()).hexdigest()) if secret else requests.limit(0)


def incoming(updates: DataFrame, raw: str = "value") -> DataFrame:
    """One event for each update that says something: update_id, user, kind, text, command, callback, file.

    A callback comes first; of a message a command, then the largest photo, a document, a text. An edited message counts as a message.
    """
    u = updates.select(F.from_json(raw, UPDATE).alias("u")).select("u.*")
    m = F.coalesce(F.col("message"), F.col("edited_message"))
    photo = F.try_element_at(m["photo"], F.lit(-1))
    said = m["text"]
    kind = (
        F.when(F.col("callback_query.data").isNotNull(), "callback").when(said.startswith("/"), "command").when(photo.isNotNull(), "photo")
        .when(m["document"].isNotNull(), "document").when(F.length(said) > 0, "text")
    )
    file = F.when(kind == "photo", F.struct(photo["file_id"].alias("file_id"), F.lit("image/jpeg").alias("mime"))).when(kind == "document", F.struct(m["document"]["file_id"].alias("file_id"), m["document"]["mime_type"].alias("mime")))
    return u.select(
        "update_id", F.coalesce(F.col("callback_query.chat_id"), m["chat_id"]).alias("user"), kind.alias("kind"), F.when(kind != "callback", F.coalesce(said, m["caption"])).alias("text"),
        F.when(kind == "command", command(said)).alias("command"), F.when(kind == "callback", approval(F.col("callback_query.data"))).alias("callback"), file.alias("file"),
    ).where(F.col("kind").isNotNull())


def unrepeated(events: DataFrame, key: str = "update_id", at: str | None = None, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered; which of its deliveries counts is open. Events without a key all stay.

    In a stream its deliveries have to come within `late` of each other by the time `at`, as the keys of older ones are forgotten.
    """
    keyed = events.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.uuid()))
    if events.isStreaming:
        return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
    return keyed.dropDuplicates(["__key"]).drop("__key")


def route(kind: Column, text: Column, in_onboarding: Column) -> Column:
    """Where an event goes: callbacks first, then answers of a running onboarding, commands by meaning, files, long texts; the rest is unsupported."""
    long = F.length(F.trim(text)) > ANSWER_LIMIT
    return (
        F.when(kind == "callback", "approval").when((kind == "text") & in_onboarding & ~long, "onboarding_answer")
        .when(kind == "command", F.concat(F.lit("command:"), F.coalesce(command_meaning(command(text)), F.lit("unknown"))))
        .when(kind.isin("photo", "document"), "document").when((kind == "text") & long, "document").otherwise("unsupported")
    )


def handled(events: DataFrame, handlers: Mapping[str, Callable[[dict], str | None]], route: str = "route") -> DataFrame:
    """events with result and error, from the handler of each one's route. An event that its handler fails on, or that has none, doesn't stop others."""
    columns = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            results, errors = [], []
            for row in b.to_pylist():
                handler, result, error = handlers.get(row[route]), None, None
                if handler is None:
                    error = f"no handler for {row[route]}"
                else:
                    try:
                        result = handler(row)
                    except Exception as e:  # one event's error is not the others'
                        error = f"{type(e).__name__}: {e}"
                results.append(result)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(results, pa.string()), pa.array(errors, pa.string())], [*columns, "result", "error"])

    return events.mapInArrow(run, StructType([*events.schema.fields, StructField("result", StringType()), StructField("error", StringType())]))


def stored_with_status(documents: DataFrame, outcome: DataFrame) -> DataFrame:
    """Documents with status analyzed or failed by their outcome (document_id, ok); those without one are still processing."""
    o = outcome.select(F.col("document_id").alias("id"), "ok")
    return documents.join(o, "id", "left").withColumn("status", F.when(F.col("ok"), "analyzed").when(~F.col("ok"), "failed").otherwise("processing")).drop("ok")


# ---- watches: a fold that windows can state


def watch_states(checks: DataFrame) -> DataFrame:
    """Each watch after its checks: watch, status, check_count, last_checked_at, found_at, error_message.

    checks: watch, at, outcome (available, none, error), message. Only an active watch is checked: an available one is found, an error
    stops it for good, no slots leave it as it is. So what counts is each watch's first check that ends it, and those before.
    """
    ends = F.col("outcome").isin("available", "error")
    done = F.sum(F.when(ends, 1).otherwise(0)).over(W.partitionBy("watch").orderBy("at", "outcome").rowsBetween(W.unboundedPreceding, -1))
    made = checks.withColumn("ended", F.coalesce(done, F.lit(0))).where("ended = 0")
    return made.groupBy("watch").agg(
        F.coalesce(F.max(F.when(F.col("outcome") == "available", F.lit("found")).when(F.col("outcome") == "error", F.lit("error"))), F.lit("active")).alias("status"),
        F.count(F.lit(1)).alias("check_count"), F.max("at").alias("last_checked_at"), F.max(F.when(F.col("outcome") == "available", F.col("at"))).alias("found_at"), F.max(F.when(F.col("outcome") == "error", F.col("message"))).alias("error_message"),
    )


# ---- drafts: a fold over each draft's commands


def draft_states(commands: DataFrame) -> DataFrame:
    """Each command with the state it meets and leads to: draft, seq, command, before, after, error.

    A command that its state does not allow changes nothing and is an error; approving twice is none. The fold runs over each draft's few
    commands, in order.
    """
    ordered = commands.groupBy("draft").agg(F.array_sort(F.collect_list(F.struct("seq", "command"))).alias("commands"))

    def after(state: Column, cmd: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, (sources, target) in DRAFT_MOVES.items():
            out = F.when((cmd == name) & state.isin(*sorted(sources)), F.lit(target)).otherwise(out)
        return out

    row = "array<struct<seq:long,command:string,before:string,after:string,error:string>>"

    def step(acc: Column, c: Column) -> Column:
        new = after(acc["state"], c["command"])
        line = F.struct(
            c["seq"].cast("long").alias("seq"), c["command"].alias("command"), acc["state"].alias("before"), F.coalesce(new, acc["state"]).alias("after"),
            F.when(new.isNull(), F.concat(c["command"], F.lit(" from "), acc["state"])).alias("error"),
        )
        return F.struct(F.coalesce(new, acc["state"]).alias("state"), F.concat(acc["log"], F.array(line)).alias("log"))

    log = F.aggregate("commands", F.struct(F.lit("draft").alias("state"), F.array().cast(row).alias("log")), step, lambda acc: acc["log"])
    return ordered.select("draft", F.explode(log).alias("x")).select("draft", "x.*")


# ---- onboarding: keyed state in a stream

ONBOARDING_STATE = "step string, name string, address string, city string"
ONBOARDING_OUT = "user string, seq long, asked string, step string, accepted boolean, name string, address string, city string"


def onboarding_step(step: str, answer: str) -> tuple[str, str | None]:
    """(next step, what is stored) of an answer: blank skips, too short asks again."""
    answer = (answer or "").strip()
    following = ONBOARDING[ONBOARDING.index(step) + 1]
    if not answer:
        return following, None
    return (following, answer) if len(answer) >= 3 else (step, None)


class Onboarding(StatefulProcessor):
    """Asks each user for name, address and city; what is known so far is the state, kept until all is asked."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("onboarding", ONBOARDING_STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        step, *known = self.state.get() if self.state.exists() else ("name", None, None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if step == "done":
                break
            asked = step
            step, stored = onboarding_step(step, r.answer)
            if stored is not None:
                known[ONBOARDING.index(asked)] = stored
            out.append((key[0], int(r.seq), asked, step, step != asked, *known))
        self.state.update((step, *known))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ONBOARDING_OUT.split(", ")])

    def close(self) -> None:
        pass


def onboarding_stream(answers: DataFrame) -> DataFrame:
    """A stream of (user, seq, answer) to a stream of what each answer led to. Needs the RocksDB state store."""
    return answers.groupBy("user").transformWithStateInPandas(Onboarding(), ONBOARDING_OUT, "Append", "None")


def onboarding_batch(answers: DataFrame) -> DataFrame:
    """The same for a table of answers: a fold over each user's few answers."""
    ordered = answers.groupBy("user").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "answer"))).alias("answers"))
    steps = F.array(*[F.lit(s) for s in ONBOARDING])
    log_type = "array<struct<seq:long,asked:string,step:string,accepted:boolean,name:string,address:string,city:string>>"

    def step(acc: Column, a: Column) -> Column:
        said = F.trim(F.coalesce(a["answer"], F.lit("")))
        moved = (said == "") | (F.length(said) >= 3)
        new = F.when(moved, F.element_at(steps, F.array_position(steps, acc["step"]).cast("int") + 1)).otherwise(acc["step"])
        stored = lambda f: F.when(moved & (said != "") & (acc["step"] == f), said).otherwise(acc[f]).alias(f)
        line = F.struct(a["seq"].alias("seq"), acc["step"].alias("asked"), new.alias("step"), moved.alias("accepted"), stored("name"), stored("address"), stored("city"))
        went = F.struct(new.alias("step"), stored("name"), stored("address"), stored("city"), F.concat(acc["log"], F.array(line)).alias("log"))
        return F.when(acc["step"] == "done", acc).otherwise(went)

    none = F.lit(None).cast("string")
    log = F.aggregate("answers", F.struct(F.lit("name").alias("step"), none.alias("name"), none.alias("address"), none.alias("city"), F.array().cast(log_type).alias("log")), step, lambda acc: acc["log"])
    return ordered.select("user", F.explode(log).alias("x")).select("user", "x.*")


def scheduled_scan(due: DataFrame, skip: bool) -> DataFrame:
    """Rows to work on at a tick of the clock; none at all, and nothing read, where schedules are switched off."""
    return due.limit(0) if skip else due


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by hour and type, in batch or in a stream that waits `late` for stragglers."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
