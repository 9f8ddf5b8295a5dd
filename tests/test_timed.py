"""Streams against their batch forms, reminders that fire once, deliveries that repeat, expiry by folders, refused writes and schedules."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lettermill.functions import schedule
from lettermill.operators import partitions
from lettermill.operators.partitions import RefusedError, checked_write
from lettermill.sources import scratch
from lettermill.sources.sinks import Outbox
from lettermill.streaming import events, timed


def at(df, seconds="t"):
    return df.withColumn("at", F.timestamp_seconds(seconds)).drop(seconds)


@pytest.mark.parametrize("seed", [1, 2])
def test_watches_and_drafts_whatever_the_batches(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"w{rnd.randrange(6)}", 1_000_000 + rnd.randrange(60), rnd.choice(["none", "none", "none", "available", "error", None]), rnd.choice(["a", "b", None]), rnd.randrange(3)) for _ in range(120)]
    whole = at(spark.createDataFrame(rows, "watch string, t long, outcome string, message string, batch int"))
    clock = at(spark.createDataFrame([(None, 9_000_000, None, None)], "watch string, t long, outcome string, message string"))
    parts = [whole.where(F.col("batch") == k).drop("batch").coalesce(1) for k in range(3)]
    out = scratch.run_through(timed.watch_stream(scratch.streamed([*parts, clock], files=1), late="5 days"))
    last = out.where("watch IS NOT NULL").groupBy("watch").agg(F.max_by(F.struct("status", "check_count", "last_checked_at", "found_at", "error_message"), "check_count").alias("x")).select("watch", "x.*")
    # the stream tells checks of one time apart by outcome and message, nulls first; so does this fold
    want = {}
    for w in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == w), key=lambda r: (r[1], (r[2] is not None, r[2]), (r[3] is not None, r[3])))
        status, n, found, message = "active", 0, None, None
        for _, t, outcome, text, _ in own:
            if status != "active":
                break
            n, seen = n + 1, t
            if outcome in ("available", "error"):
                status, found, message = ("found", t, None) if outcome == "available" else ("error", None, text)
        want[w] = (status, n, seen, found, message)
    got = {r.watch: (r.status, r.check_count, int(r.last_checked_at.replace(tzinfo=dt.timezone.utc).timestamp()), r.found_at and int(r.found_at.replace(tzinfo=dt.timezone.utc).timestamp()), r.error_message) for r in last.collect()}
    assert got == want

    moves = [(f"d{d}", 100 + s, s, rnd.choice(["present", "approve", "reject", "send", "lost"]), rnd.randrange(3)) for d in range(5) for s in range(6)]
    commands = at(spark.createDataFrame(moves, "draft string, t long, seq long, command string, batch int"))
    clock = at(spark.createDataFrame([("~", 9_000_000, 0, "present")], "draft string, t long, seq long, command string"))
    parts = [commands.where(F.col("batch") == k).drop("batch").coalesce(1) for k in range(3)]
    out = scratch.run_through(timed.draft_stream(scratch.streamed([*parts, clock], files=1), late="5 days")).where("draft <> '~'")
    batch = events.draft_states(commands.select("draft", "seq", "command"))
    assert sorted(map(tuple, out.select(*batch.columns).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_idle_keys_are_forgotten(spark):
    kind = "watch string, t long, outcome string, message string"
    day = 86_400
    steps = [[("a", 10 * day, "available", None)], [("clock", 40 * day, None, None)], [("clock", 60 * day, None, None)], [("a", 61 * day, "none", None)], [("clock", 90 * day, None, None)]]
    out = scratch.run_through(timed.watch_stream(scratch.streamed([at(spark.createDataFrame(s, kind)).coalesce(1) for s in steps], files=1), late="1 second", keep=20))
    assert [(r.status, r.check_count) for r in out.where("watch = 'a'").orderBy("last_checked_at").collect()] == [("found", 1), ("active", 1)]


def test_reminders_fire_once(spark):
    kind = "id string, user_id string, t long, status string, due long"
    day = 86_400
    rows = [
        [("r1", "u", day, "scheduled", 5 * day), ("r2", "u", day, "scheduled", 9 * day), ("r3", "v", day, "scheduled", 6 * day), ("r4", "v", day, "scheduled", 6 * day), ("r6", "v", day, "scheduled", None)],
        [("r1", "u", 2 * day, "scheduled", 5 * day), ("r3", "v", 2 * day, "cancelled", None), ("r4", "v", 2 * day, "scheduled", 7 * day)],
        [(None, None, 8 * day, "tick", None)],
        [("r1", "u", 8 * day + 1, "scheduled", 5 * day), ("r3", "v", 8 * day + 1, "scheduled", 6 * day), ("r5", "w", 8 * day + 1, "scheduled", 3 * day)],
        [(None, None, 10 * day, "tick", None)],
        [("r2", "u", 10 * day + 1, "scheduled", 9 * day), (None, None, 10 * day + 2, "tick", None)],
    ]
    made = [at(spark.createDataFrame(r, kind)).withColumn("due_date", F.timestamp_seconds("due")).drop("due").coalesce(1) for r in rows]
    out = scratch.run_through(timed.reminder_stream(scratch.streamed(made, files=1)))
    seconds = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp()) // day
    fired = sorted((r.id, r.user_id, seconds(r.due_date), seconds(r.fired_at)) for r in out.collect())
    assert fired == [("r1", "u", 5, 8), ("r2", "u", 9, 10), ("r4", "v", 7, 8), ("r5", "w", 3, 8)]


def test_streams_call_for_buckets_not_for_keys(spark):
    rows = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("u").alias("user_id"), F.timestamp_seconds(F.lit(86_400) + F.col("id")).alias("due_date"), F.lit("scheduled").alias("status"), F.timestamp_seconds(F.lit(1)).alias("at"))
    tick = rows.limit(1).select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("timestamp").alias("due_date"), F.lit("tick").alias("status"), F.timestamp_seconds(F.lit(86_400 + 1500)).alias("at"))
    off = rows.where("id LIKE 'r%7'").withColumn("status", F.lit("cancelled"))
    out = scratch.run_through(timed.reminder_stream(scratch.streamed([rows.coalesce(1), off.unionByName(rows).coalesce(1), tick, rows.coalesce(1)], files=1), buckets=5))
    assert sorted(r.id for r in out.collect()) == sorted(f"r{i}" for i in range(1501) if i % 10 != 7)
    assert "bucket" in timed.reminder_stream(spark.readStream.format("rate").load().select(F.col("value").cast("string").alias("id"), F.lit("u").alias("user_id"), F.col("timestamp").alias("due_date"), F.lit("scheduled").alias("status"), F.col("timestamp").alias("at")))._jdf.queryExecution().analyzed().toString()


def test_repeated_deliveries(spark):
    rows = [(1, "a", 100), (1, "a", 101), (2, "b", 102), (None, "c", 103), (None, "c", 104)]
    df = at(spark.createDataFrame(rows, "update_id long, value string, t long"))
    assert sorted(r.value for r in events.unrepeated(df).collect()) == ["a", "b", "c", "c"]
    stream = scratch.streamed([df.coalesce(1), df.coalesce(1), at(spark.createDataFrame([(3, "d", 900), (2, "b", 105)], "update_id long, value string, t long")).coalesce(1)], files=1)
    out = scratch.run_through(events.unrepeated(stream, at="at", late="1 hour"))
    assert sorted(r.value for r in out.collect()) == ["a", "b", "c", "c", "c", "c", "d"]


def test_only_failed_rows_are_sent_again(spark, tmp_path):
    told = str(tmp_path / "told")
    os.makedirs(told)

    def send(key, row):
        with open(f"{told}/{key}-{uuid.uuid4().hex}", "w") as f:
            f.write(row["text"])
        before = sum(name.startswith(f"{key}-") for name in os.listdir(told))
        if key == "never" or key.startswith("twice") and before < 3:
            raise OSError("no line")

    tries = lambda: {k: sum(n.startswith(f"{k}-") for n in os.listdir(told)) for k in ("once0", "once7", "twice0", "twice4", "never", "new")}
    box = Outbox("file://" + str(tmp_path / "box"), send, tries=4)
    rows = [(f"once{i}", "x") for i in range(20)] + [(f"twice{i}", "y") for i in range(5)] + [("never", "z"), ("once3", "x")]
    df = spark.createDataFrame(rows, "event_id string, text string").repartition(3)
    box(df, 0)
    assert tries() == {"once0": 1, "once7": 1, "twice0": 1, "twice4": 1, "never": 1, "new": 0}
    box(df, 0)  # a batch that a stream repeats
    box(spark.createDataFrame([("new", "n")], df.schema), 1)
    assert tries() == {"once0": 1, "once7": 1, "twice0": 2, "twice4": 2, "never": 2, "new": 1}
    assert box.again(spark) == 1 and box.again(spark) == 0 and box.again(spark) == 0
    assert tries() == {"once0": 1, "once7": 1, "twice0": 3, "twice4": 3, "never": 4, "new": 1}
    out = box.outcomes(spark)
    assert out.where("outbox_sent").count() == out.where("outbox_sent").select("event_id").distinct().count() == 26
    assert {r.outbox_error for r in out.where("NOT outbox_sent").collect()} == {"OSError: no line"}


def test_expired_rows_go_by_folders(spark, tmp_path):
    path = "file://" + str(tmp_path / "t")
    rows = [(i, f"2024-0{1 + i % 6}-{1 + i % 28:02} 0{i % 10}:00:00") for i in range(200)] + [(1000 + i, None) for i in range(5)]
    table = spark.createDataFrame(rows, "id long, d string").select("id", F.col("d").cast("timestamp").alias("delete_after"))
    for unit in ("day", "month"):
        now = F.lit("2024-03-15 04:00:00").cast("timestamp")
        partitions.written_by_expiry(table, path, unit=unit)
        before = {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "t").glob("expires=*")}
        want = {i for i, d in rows if d is None or d >= "2024-03-15 04:00:00"}
        assert partitions.purged_by_expiry(spark, path, now, unit=unit) == len(rows) - len(want)
        assert {r.id for r in spark.read.parquet(path).collect()} == want
        after = {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "t").glob("expires=*")}
        edge = "expires=2024-03-15" if unit == "day" else "expires=2024-03"
        assert all(after[k] == before[k] for k in after if k != edge), "only the folder of now is written again"
        assert all(k.partition("=")[2] >= edge.partition("=")[2] for k in after)
        assert partitions.purged_by_expiry(spark, path, now, unit=unit) == 0
    plan = spark.read.parquet(path).where((F.col("expires") == "2024-03") & (F.col("delete_after") < now))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(expires" in plan and "PushedFilters: [IsNotNull(delete_after), LessThan(delete_after" in plan
    partitions.written_by_expiry(table.where("id < 20"), path, unit="month")
    assert partitions.purged_by_expiry(spark, path, F.lit("2025-01-01").cast("timestamp"), unit="month") == 20 and partitions.purged_by_expiry(spark, path, now, unit="month") == 0


def test_bad_rows_leave_the_old_table(spark, tmp_path):
    path = "file://" + str(tmp_path / "drafts")
    df = lambda rows: spark.createDataFrame(rows, "id string, analysis_id string, status string, approved_at timestamp")
    when = dt.datetime(2024, 1, 1)
    parents = {"analyses": spark.createDataFrame([("a1",), ("a2",), ("a2",)], "id string")}
    old = df([("1", "a1", "approved", when), ("2", "a2", "draft", None), ("3", "a1", "approved", None), ("4", None, "sent", when)])
    with pytest.raises(RefusedError) as told:
        checked_write(old, "drafts", path, parents, df([]))
    assert told.value.counts == {"sent without approval": 1} and not (tmp_path / "drafts").exists()
    assert checked_write(old, "drafts", path, parents) == 4
    stored = spark.read.parquet(path)
    bad = [("1", "a1", "sent", when), ("2", "a2", "sent", None), ("3", "a1", "sent", None), ("4", None, "sent", when), ("5", "a9", "odd", None), ("5", "a1", None, None), (None, "a1", "draft", None), ("6", "a1", "sent", None)]
    with pytest.raises(RefusedError) as told:
        checked_write(df(bad), "drafts", path, parents, stored)
    assert told.value.counts == {"no id": 1, "repeated id": 2, "unknown status": 1, "unknown analysis_id": 1, "sent without approval": 3}
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["1", "2", "3", "4"] and [p.name for p in tmp_path.iterdir()] == ["drafts"]
    assert checked_write(df([bad[0], bad[3]]), "drafts", path, parents, stored) == 2
    assert sorted(r.status for r in spark.read.parquet(path).collect()) == ["sent", "sent"]
    with pytest.raises(ValueError, match="no such columns: extra"):
        checked_write(old.withColumn("extra", F.lit(1)), "drafts", path)


def test_schedules(spark):
    expressions = ("0 3 * * *", "*/30 * * * *", "15 8 1-7 * 1", "0 0 29 2 *", "5,10-20/5 6-8 * 1-3,12 5-7", "0 12 * * 7", "59 23 31 * *")
    start = dt.datetime(2023, 12, 28)
    minutes = [start + dt.timedelta(minutes=k) for k in range(0, 70 * 1440)]

    def fits(cron, t):
        def has(field, value, low, high):
            for part in field.split(","):
                span, _, step = part.partition("/")
                a, b = (low, high) if span == "*" else (int(x) for x in span.split("-")) if "-" in span else (int(span), high if step else int(span))
                if value in range(a, b + 1, int(step or 1)):
                    return True
            return False

        m, h, d, mo, w = cron.split()
        weekday = t.isoweekday() % 7
        day, week = has(d, t.day, 1, 31), has(w, weekday, 0, 7) or weekday == 0 and has(w, 7, 0, 7)
        both = day and week if d.startswith("*") or w.startswith("*") else day or week
        return has(m, t.minute, 0, 59) and has(h, t.hour, 0, 23) and has(mo, t.month, 1, 12) and both

    asked = [start + dt.timedelta(seconds=s) for s in (0, 1, 59, 60, 86_399, 500_000, 1_000_003)]
    df = spark.createDataFrame([(str(t),) for t in asked], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    for cron in expressions:
        want = [t for t in minutes if fits(cron, t)]
        got = [r["at"] for r in schedule.fire_times(spark, cron, str(minutes[0]), str(minutes[-1] + dt.timedelta(minutes=1))).orderBy("at").collect()]
        assert got == want, cron
        following = {r.t: r.n for r in df.select("t", schedule.next_fire(F.col("t"), cron).alias("n")).collect()}
        assert following == {t: next(x for x in want if x >= t) for t in asked}, cron
    assert df.select(schedule.next_fire(F.col("t"), "0 0 30 2 *").alias("n")).first().n is None
    assert spark.range(1).select(schedule.next_fire(F.lit(None).cast("timestamp_ntz"), "0 0 * * *").alias("n")).first().n is None
    for odd in ("* * * *", "60 * * * *", "5-2 * * * *", "*/0 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            schedule.Cron.read(odd)


def test_changes_write_their_folders_only(spark, tmp_path):
    from lettermill.operators import buckets, store

    path = "file://" + str(tmp_path / "t")
    rows = spark.range(5000).select("id", F.lit("a").alias("x"), F.lit("b").alias("y"))
    buckets.written_by_key(rows, path, "id", 512)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    news = spark.createDataFrame([(7, "late", 3), (7, "early", 1), (7, None, 4), (4000, "z", 1), (9999, "new", 1)], "id long, x string, at int")
    assert buckets.changed_by_key(spark, path, news, "id", lambda old, new: store.upserted(old, new, ("id",), {"y": F.lit("c")}, order="at"), 512) <= 3
    after = files()
    changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert len({p.rsplit("/", 2)[1] for p in changed}) <= 3 and len(changed & before.keys()) < 0.02 * len(before)
    got = {r.id: (r.x, r.y) for r in buckets.read_by_key(spark, path).collect()}
    assert len(got) == 5001 and got[7] == ("a", "b") and got[4000] == ("z", "b") and got[9999] == ("new", "c") and got[8] == ("a", "b")
    assert sorted(r.id for r in buckets.found_by_key(spark, path, "id", [7, 8, 123456], 512).collect()) == [7, 8]
    plan = buckets.found_by_key(spark, path, "id", [7], 512)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    gone = rows.where("id < 20").select("id")
    assert buckets.changed_by_key(spark, path, gone, "id", lambda old, keys: store.without(old, keys, "id"), 512) <= 20
    assert {r.id for r in buckets.read_by_key(spark, path).collect()} == {*range(20, 5000), 9999}
    assert buckets.changed_by_key(spark, path, gone.limit(0), "id", lambda old, keys: old.limit(0), 512) == 0


def test_deleted_users_are_told_of_without_a_name(spark):
    from lettermill.operators import store

    users = spark.createDataFrame([("u1",), ("u2",)], "id string")
    audit = spark.createDataFrame([("a1", "u1", "seen"), ("a2", "u2", "seen")], "id string, user_id string, action string")
    out, counts = store.cascaded({"users": users, "audit_log": audit}, spark.createDataFrame([("u1",), ("gone",)], "id string"), action="user_deleted")
    assert sorted(((r.user_id or "", r.action) for r in out["audit_log"].collect())) == [("", "seen"), ("", "user_deleted"), ("u2", "seen")]
    assert [tuple(r) for r in counts.collect()] == [("users", 1)] and store.purge_total(counts).first().total == 1 and store.purge_total(counts.limit(0)).first().total == 0


def test_rotation_goes_from_the_oldest_and_can_be_tried(spark, tmp_path):
    from lettermill.functions import vault

    old, new = bytes(32), bytes([1]) * 32
    rows = spark.createDataFrame([(f"u{i}", f"d{i}", "[[NAME_1]]", "NAME", f"wert{i}", 100 - i) for i in range(9)], "user_id string, document_id string, token string, entity_type string, value string, created_at int")
    sealed = rows.withColumn("s", vault.seal(F.col("value"), old, vault.scope(F.col("user_id"), F.col("document_id"), F.col("token")))).select("user_id", "document_id", "token", "entity_type", "s.*", "created_at")
    sealed.write.parquet(str(tmp_path / "old"))
    kept = spark.read.parquet(str(tmp_path / "old"))
    path = str(tmp_path / "new")
    assert vault.rotated_checked(kept, old, new, path, dry_run=True) == 9 and not (tmp_path / "new").exists()
    assert vault.rotated_checked(kept, old, new, path) == 9
    made = spark.read.parquet(path)
    assert sorted((r.user_id, r.original, r.created_at) for r in vault.opened_vault(made, new).collect()) == [(f"u{i}", f"wert{i}", 100 - i) for i in range(9)]
    assert made.coalesce(1).columns == kept.columns and {r.key_version for r in made.collect()} == {2}
