"""Watches, drafts and reminders as streams: rows wait for the watermark, timers of event time apply them, and idle keys are forgotten."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import DRAFT_MOVES

#: A fold: (what is known of a key or None, a row) to (what is known then, what comes out or None).
Fold = Callable[[tuple | None, dict], tuple[tuple | None, tuple | None]]
DAY_MS = 86_400_000
#: Buckets that the keys of a stream are dealt to by hash. A task works on a bucket at a time, as a call for each key costs a hundred times what its rows do.
BUCKETS = 1024


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class InOrder(StatefulProcessor):
    """Applies a fold to each key's rows in the order of their times, whatever batches they came in.

    Rows wait in the state until the watermark has passed their time, those of a bucket of keys together. The bucket's one timer stands at the
    first of them; when it fires, all that the watermark has passed are taken up key by key, those of one time as `order` tells them apart,
    and the timer moves to the first that is left. A key that had no row for `keep` days of event time is forgotten: its state goes.
    """

    def __init__(self, fold: Fold, key: str, order: Sequence[str], out: str, keep: int):
        self.fold, self.key, self.order, self.out, self.keep = fold, key, list(order), [c.split()[0] for c in out.split(", ")], keep * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "states binary")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, first: int | None, fired: int | None = None) -> None:
        """Moves the bucket's timer; the one that has fired goes by itself."""
        (now,) = self.timer.get() if self.timer.exists() else (None,)
        if now is not None and now not in (first, fired):
            self.handle.deleteTimer(now)
        if first is None:
            self.timer.clear()
        elif first != now:
            self.timer.update((first,))
            self.handle.registerTimer(first)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = self.timer.get()[0] if self.timer.exists() else None
        for batch in rows:
            plain = batch.astype(object).where(batch.notna(), None)
            said = [json.dumps(list(x)) for x in zip(plain[self.key], *(plain[c] for c in self.order), strict=True)]
            times = batch["time_ms"].to_numpy(np.int64)
            self.waiting.appendValue((_packed(pa.table({"ms": times, "row": pa.array(said, pa.string())})),))
            first = int(times.min()) if first is None else min(first, int(times.min()))
        self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, at = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        held = [pa.ipc.open_stream(rows).read_all() for (rows,) in self.waiting.get()] if self.waiting.exists() else []
        known: dict[Any, tuple[tuple, int]] = {k: (tuple(state), last) for k, state, last in json.loads(self.known.get()[0])} if self.known.exists() else {}
        rest, out = None, []
        if held:
            held = pa.concat_tables(held)
            passed = pc.less_equal(held["ms"], now)
            due, rest = held.filter(passed), held.filter(pc.invert(passed))
            taken = [(k, ms, row) for ms, (k, *row) in zip(due["ms"].to_pylist(), map(json.loads, due["row"].to_pylist()), strict=True)]
            for k, ms, row in sorted(taken, key=lambda x: (x[1], [(v is not None, v) for v in x[2]])):
                before, last = known.get(k, (None, 0))
                after, made = self.fold(before if ms < last + self.keep else None, dict(zip(self.order, row, strict=True)))
                if after is None:
                    known.pop(k, None)
                else:
                    known[k] = after, ms
                if made is not None:
                    out.append((k, *made))
            if len(due):
                self.waiting.clear()
                if len(rest):
                    self.waiting.appendValue((_packed(rest.combine_chunks()),))
        known = {k: x for k, x in known.items() if x[1] + self.keep > now}  # rows that could still come for the others are as far from theirs
        if known:
            self.known.update((json.dumps([[k, state, last] for k, (state, last) in known.items()]).encode(),))
        else:
            self.known.clear()
        ahead = [last + self.keep for _, last in known.values()]
        if rest is not None and len(rest):
            ahead.append(pc.min(rest["ms"]).as_py())
        self._wake(min(ahead, default=None), fired=at)
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, at: str, late: str, order: Sequence[str], fold: Fold, out: str, keep: int = 400, buckets: int = BUCKETS) -> DataFrame:
    """A stream of rows to a stream of what a fold makes of each key's rows in the order of their times. Needs the RocksDB state store.

    Rows may come up to `late` after rows of a later time; later ones are dropped by the watermark. order: the columns that the fold gets, first
    those that decide between rows of one time; a time in milliseconds should be among them if the fold looks at it. Rows of one key, time
    and order are applied one after another; null times never come up. What a fold knows and rows are kept as JSON.
    """
    timed = rows.withWatermark(at, late).withColumn("time_ms", F.unix_millis(at)).where("time_ms IS NOT NULL").select(key, at, "time_ms", *[c for c in order if c not in (key, at)])
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(InOrder(fold, key, order, out, keep), out, "Append", "EventTime")


# ---- watches


def _checked(known: tuple | None, row: dict) -> tuple[tuple, tuple | None]:
    status, count, *_ = known or ("active", 0)
    if status != "active":
        return known, None
    outcome, us, message = row["outcome"], row["at_us"], row["message"]
    new = {"available": "found", "error": "error"}.get(outcome, "active")
    state = (new, count + 1, us, us if new == "found" else None, message if new == "error" else None)
    return state, state


def watch_stream(checks: DataFrame, late: str = "1 hour", keep: int = 400) -> DataFrame:
    """A stream of checks (watch, at, outcome, message) to a stream of each watch after each check that counts: an active watch's, in order of time and outcome.

    Columns as of events.watch_states, whose last row for a watch this comes to, however checks are split into batches. A message counts only
    with an error; a null outcome leaves a watch active. Of equal checks each counts.
    """
    state = "status string, check_count long, last_us long, found_us long, error_message string"
    rows = checks.select(F.col("watch").cast("string").alias("watch"), "at", F.unix_micros("at").alias("at_us"), "outcome", "message")
    out = in_order(rows, "watch", "at", late, ("at_us", "outcome", "message"), _checked, f"watch string, {state}", keep)
    return out.select("watch", "status", "check_count", F.timestamp_micros("last_us").alias("last_checked_at"), F.timestamp_micros("found_us").alias("found_at"), "error_message")


# ---- drafts


def _moved(known: tuple | None, row: dict) -> tuple[tuple, tuple]:
    (before,) = known or ("draft",)
    command = row["command"]
    sources, target = DRAFT_MOVES.get(command, ((), None))
    after = target if before in sources else before
    return (after,), (row["seq"], command, before, after, None if before in sources else f"{command} from {before}")


def draft_stream(commands: DataFrame, late: str = "1 hour", keep: int = 400) -> DataFrame:
    """A stream of commands (draft, at, seq, command) to a stream of what each met and led to; columns and rules as of events.draft_states."""
    rows = commands.select(F.col("draft").cast("string").alias("draft"), "at", F.col("seq").cast("long").alias("seq"), "command")
    return in_order(rows, "draft", "at", late, ("seq", "command"), _moved, "draft string, seq long, command string, before string, after string, error string", keep)


# ---- reminders

REMINDER_OUT = "id string, user_id string, due_ms long, fired_ms long"
REMINDER_STATE = pa.schema([("id", pa.string()), ("status", pa.string()), ("user_id", pa.string()), ("due_ms", pa.int64()), ("wake_ms", pa.int64())])


class Reminders(StatefulProcessor):
    """Fires each reminder once, when the clock of the stream has passed its time; remembers for `keep` days that it did.

    A key is a bucket of ids, whose reminders are worked on together, as columns: what is known of them is a table, kept as one value. Its one
    timer stands at the first time at which one of them is due or forgotten.
    """

    def __init__(self, keep: int):
        self.keep = keep * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reminders", "known binary, timer long")

    def _known(self) -> tuple[pd.DataFrame, int | None]:
        """id, status (S scheduled, F fired, C cancelled), user_id, due_ms (-1: none), wake_ms: when the next thing happens to it; and the timer."""
        if not self.state.exists():
            return pd.DataFrame({"id": pd.Series(dtype=object), "status": pd.Series(dtype=object), "user_id": pd.Series(dtype=object), "due_ms": pd.Series(dtype="int64"), "wake_ms": pd.Series(dtype="int64")}), None
        known, timer = self.state.get()
        return pa.ipc.open_stream(known).read_pandas(), timer

    def _stored(self, known: pd.DataFrame, timer: int | None, running: bool) -> None:
        """Keeps the table, and one timer at its first time. running: whether the timer stands, so that it has to go."""
        first = None if known.empty else int(known["wake_ms"].min())
        if running and timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.state.clear()
            return
        self.state.update((_packed(pa.Table.from_pandas(known, schema=REMINDER_STATE, preserve_index=False)), first))
        self.handle.registerTimer(first)

    def _fired(self, known: pd.DataFrame, now: int) -> pd.DataFrame:
        """Takes the reminders that are due as fired and gives them."""
        due = (known["status"] == "S") & (known["due_ms"] <= now)
        at = np.maximum(known.loc[due, "due_ms"], now)
        out = pd.DataFrame({"id": known.loc[due, "id"], "user_id": known.loc[due, "user_id"], "due_ms": known.loc[due, "due_ms"], "fired_ms": at})
        known.loc[due, "status"] = "F"
        known.loc[due, "wake_ms"] = at + self.keep
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        known, timer = self._known()
        new = pd.concat(list(rows)).sort_values(["at_us", "status"], ascending=[True, False], kind="stable")
        new = new.merge(known[["id", "status"]].rename(columns={"status": "was"}), "left", on="id")
        new = new[new["status"].isin(["scheduled", "cancelled"]) & ~new["was"].isin(["F", "C"])]
        if new.empty:
            return
        # what is said after the first cancellation counts for nothing; of what is said before it the last due date counts, with the user who said it first
        off = (new["status"] == "cancelled").groupby(new["id"]).cumsum()
        asked = new[(new["status"] == "scheduled") & (off == 0)]
        before = known[known["status"] == "S"]
        said = pd.concat([before[["id", "user_id", "due_ms"]], asked[["id", "user_id", "due_ms"]]], ignore_index=True)
        said = said[said["due_ms"] != said.groupby("id")["due_ms"].shift()].drop_duplicates("id", keep="last")
        cancelled = new.loc[new["status"] == "cancelled", "id"].unique()
        none = pd.DataFrame({"id": pd.Series(list(set(cancelled) - set(said["id"])), dtype=object), "user_id": None, "due_ms": -1})
        said = pd.concat([said, none.astype({"user_id": object, "due_ms": "int64"})], ignore_index=True)
        gone = said["id"].isin(cancelled)
        said["status"] = np.where(gone, "C", "S")
        said["wake_ms"] = np.where(gone, np.maximum(said["due_ms"].clip(lower=0), now) + self.keep, said["due_ms"])
        known = pd.concat([known[known["status"] != "S"], said], ignore_index=True)
        out = self._fired(known, now)
        self._stored(known, timer, running=True)
        if len(out):
            yield out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, at = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        known, timer = self._known()
        if timer is None:
            return
        known = known[(known["status"] == "S") | (known["wake_ms"] > now)].reset_index(drop=True)
        out = self._fired(known, now)
        known = known[known["wake_ms"] > now]
        self._stored(known, timer, running=timer != at)
        if len(out):
            yield out

    def close(self) -> None:
        pass


def reminder_stream(reminders: DataFrame, late: str = "0 seconds", keep: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """A stream of reminders (id, user_id, due_date, status, at) to a stream of those that are due: id, user_id, due_date, fired_at. Needs the RocksDB state store.

    The clock is the watermark of `at`, which rows with a null id, as ticks, move too. A reminder fires once when the clock reaches its due date,
    or at once where that has passed; scheduled again it takes the new date, unless it was sent or cancelled. What was sent or cancelled is
    remembered for `keep` days of the clock, so rows delivered again do nothing. Rows without a due date are left out, but for cancellations.
    buckets: what ids are dealt to by hash; more of them make each batch rewrite less of what is remembered, fewer make calls fewer.
    """
    rows = reminders.select(
        F.col("id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.coalesce(F.unix_millis(F.col("due_date").cast("timestamp")), F.lit(-1)).alias("due_ms"), "status", "at",
        F.unix_micros("at").alias("at_us"),
    )
    # a filter that looks at the time too, so that it stays above the watermark, which ticks have to reach
    rows = rows.withWatermark("at", late).where("CASE WHEN at IS NULL THEN false ELSE id IS NOT NULL AND (due_ms >= 0 OR status = 'cancelled') END")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    fired = rows.groupBy("bucket").transformWithStateInPandas(Reminders(keep), REMINDER_OUT, "Append", "EventTime")
    return fired.select("id", "user_id", F.timestamp_millis("due_ms").alias("due_date"), F.timestamp_millis("fired_ms").alias("fired_at"))
