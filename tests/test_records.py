import pytest
from pyspark.sql import functions as F

from lettermill.operators import evals, joins, store
from lettermill.streaming import events


def test_upsert_patch_delete(spark):
    users = spark.createDataFrame([(1, "a", "de"), (2, "b", "tr")], "id int, name string, locale string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", None)], "id int, name string, locale string")
    out = store.upserted(users, new, ("id",), {"locale": F.lit("de")})
    assert sorted(map(tuple, out.collect())) == [(1, "a", "de"), (2, "B", "tr"), (3, "c", "de")]
    patches = spark.createDataFrame([(1, {"name": None}), (9, {"name": "x"})], "id int, fields map<string,string>")
    assert sorted(map(tuple, store.patched(users, patches, "id").collect())) == [(1, None, "de"), (2, "b", "tr")]
    assert [r.id for r in store.missing_keys(users, patches, "id").collect()] == [9]
    assert [r.id for r in store.without(users, spark.createDataFrame([(1,), (7,)], "id int"), "id").collect()] == [2]


def test_purge_is_strict_and_leaves_watches(spark):
    t = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 00:00:00",), (None,)], "delete_after string").withColumn("delete_after", F.col("delete_after").cast("timestamp"))
    kept, counts = store.purged({"users": t, "watches": t}, F.lit("2024-01-02").cast("timestamp"))
    assert kept["users"].count() == 2 and kept["watches"].count() == 3 and [(r.table_name, r.deleted_count) for r in counts.collect()] == [("users", 1)]


def test_draft_gate_and_states(spark):
    c = [("d", 1, "send"), ("d", 2, "present"), ("d", 3, "approve"), ("d", 4, "approve"), ("d", 5, "send"), ("d", 6, "reject"), ("e", 1, "reject"), ("e", 2, "approve")]
    out = sorted(events.draft_states(spark.createDataFrame(c, "draft string, seq long, command string")).collect())
    assert [(r.draft, r.after, r.error is None) for r in out] == [
        ("d", "draft", False), ("d", "pending_approval", True), ("d", "approved", True), ("d", "approved", True), ("d", "sent", True), ("d", "sent", False), ("e", "rejected", True), ("e", "rejected", False)]
    at = F.lit("2024-01-01").cast("timestamp")
    gate = lambda old, when, new: spark.range(1).select(store.draft_gate(F.lit(old).cast("string"), when, F.lit(new))).first()[0]
    none = F.lit(None).cast("timestamp")
    assert gate(None, none, "sent") and gate("draft", at, "sent") and gate("approved", none, "sent") and gate("rejected", at, "sent") and gate("pending_approval", at, "sent") and gate("sent", at, "sent")
    assert gate("approved", at, "sent") is None and gate(None, none, "draft") is None


def test_watches(spark):
    c = [("a", 1, "none", None), ("a", 2, "available", None), ("a", 3, "none", None), ("b", 1, "error", "boom"), ("b", 2, "available", None), ("c", 1, "none", None)]
    got = {r.watch: (r.status, r.check_count, r.error_message) for r in events.watch_states(spark.createDataFrame(c, "watch string, at int, outcome string, message string")).collect()}
    assert got == {"a": ("found", 2, None), "b": ("error", 1, "boom"), "c": ("active", 1, None)}


def test_updates_become_events(spark):
    raw = [
        '{"update_id":1,"message":{"chat_id":"u","text":"/Start@Bot x"}}', '{"update_id":2,"callback_query":{"data":"reject:9","chat_id":"u"}}', '{"update_id":3,"message":{"chat_id":"u","photo":[{"file_id":"s"},{"file_id":"l"}]}}',
        '{"update_id":4,"edited_message":{"chat_id":"u","text":"hallo"}}', '{"update_id":5}', "no json",
    ]
    got = {r.update_id: r for r in events.incoming(spark.createDataFrame([(x,) for x in raw], "value string")).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1].command == "start" and got[2].callback.action == "reject" and got[3].file.file_id == "l" and got[4].kind == "text"
    assert events.authenticated(spark.createDataFrame([("s",), ("t",)], "secret string"), "s").count() == 1 and events.authenticated(spark.createDataFrame([("s",)], "secret string"), None).count() == 0


def test_onboarding_stream_equals_batch(spark, tmp_path):
    answers = [("u", 1, "Al"), ("u", 2, "Ayşe Yılmaz"), ("u", 3, ""), ("u", 4, "10115 Berlin"), ("u", 5, "zu spät"), ("v", 1, " "), ("v", 2, "Torstraße 1")]
    schema = "user string, seq long, answer string"
    df = spark.createDataFrame(answers, schema)
    batch = sorted(map(tuple, events.onboarding_batch(df).collect()), key=repr)
    for k in (0, 1):
        df.where(F.col("seq") <= 2 if k == 0 else F.col("seq") > 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.onboarding_stream(stream).writeStream.format("memory").queryName("onboarding").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("onboarding").collect()), key=repr) == batch


def test_evaluations(spark):
    cases = spark.createDataFrame([("bare", ["Anna Berg"], ["anna  BERG"]), ("bare", ["Otto"], []), ("trap", [], [])], "category string, expected array<string>, got array<string>")
    rec = {r.category: (r.recall, r.n_spurious) for r in evals.name_recall(cases).collect()}
    assert rec == {"bare": (0.5, 0), "trap": (1.0, 0)} and evals.accepted(evals.name_recall(cases), least=0.5).first().accepted
    tokens = lambda rows: spark.createDataFrame(rows, "type string, n long")
    assert sorted(map(tuple, evals.token_parity(tokens([("NAME", 3), ("DATE", 1)]), tokens([("NAME", 1), ("IBAN", 1)])).collect())) == [("DATE", 1, 0, 1), ("IBAN", 0, 1, 0), ("NAME", 3, 1, 2)]


def test_joins(spark):
    r = spark.createDataFrame([("r1", "u1", "a1"), ("r2", "u2", None), ("r3", "gone", "a1")], "id string, user_id string, analysis_id string")
    u = spark.createDataFrame([("u1", "tg", "1", "de"), ("u2", "tg", "2", "tr")], "id string, channel string, channel_user_id string, locale string")
    a = spark.createDataFrame([("a1", "d1", "Amt", None, "low")], "id string, document_id string, authority string, deadline date, risk_level string")
    v = spark.createDataFrame([("d1", "t1", "NAME", "c", "i", "g")], "document_id string, token string, entity_type string, ciphertext string, iv string, auth_tag string")
    got = {x.id: (x.authority, x.vault and len(x.vault)) for x in joins.reminder_context(r, u, a, v).collect()}
    assert got == {"r1": ("Amt", 1), "r2": (None, None)}


def test_cascade_along_every_key(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    graph = {
        "users": t([(1,), (2,)], "id long"), "documents": t([(10, 1), (20, 2)], "id long, user_id long"), "analyses": t([(100, 10), (200, 20)], "id long, document_id long"),
        "reminders": t([(5, None, 100), (6, 2, 100), (7, 2, 200), (8, 1, None)], "id long, user_id long, analysis_id long"), "pii_vault": t([(1, None, 10), (2, None, 20), (3, 1, None)], "id long, user_id long, document_id long"),
    }
    left, counts = store.cascaded(graph, graph["users"].where("id = 1"))
    assert {n: sorted(r.id for r in df.collect()) for n, df in left.items()} == {"users": [2], "documents": [20], "analyses": [200], "reminders": [7], "pii_vault": [2]}
    assert {r.table_name: r.deleted_count for r in counts.collect()} == {"users": 1, "documents": 1, "analyses": 1, "reminders": 3, "pii_vault": 2}


def test_sealed_values_never_share_a_nonce(spark):
    from lettermill.functions import vault

    key = bytes(range(32))
    one = vault.seal(F.col("v"), key, F.lit("x"))
    a, b = (spark.createDataFrame([(v,)] * 50, "v string").select(one.alias("s")) for v in ("secret", "other"))
    ivs = [r.s.iv for df in (a, b, a) for r in df.collect()]
    assert len(set(ivs)) == 150
    back = a.select(vault.opened(F.col("s"), key, F.lit("x")).alias("v")).distinct().collect()
    assert [r.v for r in back] == ["secret"]
    prints = spark.createDataFrame([("SCHULZ",), ("\uff33\uff43\uff48\uff55\uff4c\uff5a",)], "v string").select(vault.fingerprint(F.col("v"), key).alias("f")).distinct()
    assert prints.count() == 1


def test_rotation_stops_before_it_writes(spark, tmp_path):
    from lettermill.functions import vault

    old, new = bytes(range(32)), bytes(range(1, 33))
    rows = spark.createDataFrame([("u2", "d", [("[[NAME_1]]", "NAME", "Schulz")]), ("u1", "d", [("[[NAME_1]]", "NAME", "Braun")])], "user_id string, document_id string, matches array<struct<token:string,type:string,original:string>>")
    path = str(tmp_path / "vault")
    sealed = vault.sealed_matches(rows, old)
    sealed.write.parquet(path)
    sealed = spark.read.parquet(path)
    assert vault.rotated_checked(sealed, old, new, str(tmp_path / "new")) == 2
    again = spark.read.parquet(str(tmp_path / "new"))
    assert sorted(r.original for r in vault.opened_vault(again, new).collect()) == ["Braun", "Schulz"] and again.select("key_version").distinct().count() == 1
    with pytest.raises(ValueError, match="nothing was written"):
        vault.rotated_checked(sealed.withColumn("user_id", F.lit("u1")), old, new, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_profiles_decisions_and_sent_reminders(spark):
    vault = spark.createDataFrame([("u", "profile:city", "a"), ("u", "[[NAME_1]]", "b"), ("v", "profile:city", "c")], "user_id string, token string, ciphertext string")
    new = spark.createDataFrame([("u", "profile:email", "d")], "user_id string, token string, ciphertext string")
    assert sorted(r.ciphertext for r in store.profile_replaced(vault, new).collect()) == ["b", "c", "d"]
    now = F.lit("2024-05-05 10:00:00").cast("timestamp")
    drafts = spark.createDataFrame([("a", "pending_approval"), ("b", "pending_approval"), ("c", "draft")], "id string, status string").withColumns({"approved_at": F.lit(None).cast("timestamp"), "rejected_at": F.lit(None).cast("timestamp")})
    out = {r.id: r for r in store.decided(drafts, spark.createDataFrame([("a", True), ("b", False), ("c", True)], "draft_id string, approve boolean"), now).collect()}
    assert (out["a"].status, out["b"].status, out["c"].status) == ("approved", "rejected", "draft")
    assert out["a"].approved_at and out["b"].rejected_at and not (out["a"].rejected_at or out["c"].approved_at)
    reminders = spark.createDataFrame([(1, "scheduled", "2024-05-05 09:00:00"), (2, "scheduled", "2024-05-06 09:00:00"), (3, "cancelled", "2024-01-01 00:00:00")], "id int, status string, due string").select("id", "status", F.col("due").cast("timestamp").alias("due_date"), F.lit(None).cast("timestamp").alias("sent_at"))
    table, hit = store.sent(reminders, now)
    assert [r.id for r in hit.collect()] == [1] and {r.id: r.status for r in table.collect()} == {1: "sent", 2: "scheduled", 3: "cancelled"}


def test_days_are_counted_in_utc(spark):
    from lettermill.functions.dates import utc_date

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert str(spark.range(1).select(utc_date(F.lit("2024-05-05 22:00:00").cast("timestamp"))).first()[0]) == "2024-05-06"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_one_failing_event_stops_no_other(spark):
    def handle(row):
        return {"a": 1}[row["text"]] and "done"

    rows = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", "a")], "id int, route string, text string")
    got = {r.id: (r.result, r.error) for r in events.handled(rows, {"x": handle}).collect()}
    assert got == {1: ("done", None), 2: (None, "KeyError: 'b'"), 3: (None, "no handler for y")}


def test_polled_updates_and_files(spark, tmp_path):
    from lettermill.sources import tables

    log = [(i, f'{{"update_id": {i}}}') for i in range(7)]
    stream = tables.polled(spark, lambda offset: log[offset : offset + 3])
    rows = []
    query = stream.writeStream.foreachBatch(lambda df, batch: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            if len(rows) >= 7:
                break
    finally:
        query.stop()
    assert [r.update_id for r in rows] == list(range(7))
    asked = spark.createDataFrame([(1, ("f", None)), (2, ("g", "image/png")), (3, None)], "id int, file struct<file_id:string,mime:string>")
    files = spark.createDataFrame([("f", bytearray(b"abc"), "application/pdf")], "file_id string, content binary, mime string")
    got = {r.id: (r.content and bytes(r.content), r.mime) for r in tables.with_files(asked, files).collect()}
    assert got == {1: (b"abc", "application/pdf"), 2: (None, "image/png"), 3: (None, None)}


def test_channel_sends_what_it_can(spark, tmp_path):
    from lettermill.sources.sinks import Channel, document_messages

    folder = str(tmp_path)
    docs = spark.createDataFrame([("u", None, "application/pdf", bytearray(b"x"), None), ("u", "leer", "text/plain", bytearray(b""), None)], "user string, name string, mime string, content binary, caption string")

    def send(kind, row):
        if row["name"] == "bad":
            raise OSError("no")
        with open(f"{folder}/{kind}-{row['name']}", "wb") as f:
            f.write(row["content"])

    messages = document_messages(docs)
    Channel(send)(messages, 0)
    assert (tmp_path / "document-document.pdf").read_bytes() == b"x" and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(Exception, match="1 rows were not sent"):
        Channel(send)(messages.unionByName(messages.withColumn("name", F.lit("bad"))).coalesce(1), 1)


def test_differences_and_residues(spark):
    cases = spark.createDataFrame([("c", ["Anna Schulz", "Max"], ["Schulz", "Otto"])], "category string, expected array<string>, got array<string>")
    r = evals.name_differences(cases).first()
    assert (r.missed, r.spurious) == (["Max"], ["Otto"])
    assert evals.residue_total(spark.createDataFrame([("a",), (None,)], "residue string")).first().total == 1


def test_two_vaults_from_letters_mask_each_letter_once(spark):
    from lettermill import catalogue

    plan = catalogue.QUERIES["vault_nonce_unique"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_even_constants_are_sealed_apart(spark):
    from lettermill.functions import vault

    rows = spark.range(200).select(vault.seal(F.lit("one"), bytes(32), F.lit("bound")).alias("s"))
    assert rows.select("s.iv").distinct().count() == 200
    assert "EvalPython" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.v for r in rows.select(vault.opened(F.col("s"), bytes(32), F.lit("bound")).alias("v")).collect()} == {"one"}
