import datetime

import pytest
from pyspark.sql import functions as F

from lettermill.functions import binary, dates, jsonx, text, vault
from lettermill.functions.page import page_items
from lettermill.sources import sinks, tables

def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("said", "want"),
    [("30.06.2024", (2024, 6, 30)), ("1.1.2025", (2025, 1, 1)), ("30. 06. 2024", (2024, 6, 30)), ("2024-06-30", (2024, 6, 30)), ("30. Juni 2024", (2024, 6, 30)), ("3. März 2025", (2025, 3, 3)), ("3. Maerz 2025", (2025, 3, 3)),
     ("30.06.24", (2024, 6, 30)), ("30.06.98", (1998, 6, 30)), ("31.02.2024", None), ("30.13.2024", None), ("demnächst", None), ("", None), ("30. Junius 2024", None), ("29.02.2023", None), (None, None)],
)
def test_german_dates(spark, said, want):
    assert one(spark, dates.german_date(F.lit(said).cast("string"))) == (want and datetime.date(*want))


def test_days_risk_reminders(spark):
    NOW = F.lit("2024-06-01 12:00:00").cast("timestamp")  # noqa: N806
    day = lambda d: F.lit(d).cast("date")
    assert [one(spark, dates.days_until(day(d), NOW)) for d in ("2024-06-30", "2024-05-30", "2024-06-01")] == [29, -2, 0]
    risk = lambda r, d: one(spark, dates.escalated(F.lit(r), F.date_add(day("2024-06-01"), d) if d is not None else F.lit(None).cast("date"), NOW))
    assert [risk("low", d) for d in (-1, 2, 7, 14)] == ["critical", "critical", "high", "medium"]
    assert (risk("medium", 60), risk("critical", 90), risk("high", None)) == ("medium", "critical", "high")
    due = lambda d: [t.strftime("%m-%d") for t in one(spark, dates.reminder_dates(day(d), NOW))]
    assert due("2024-06-30") == ["06-16", "06-23", "06-27", "06-29"] and due("2024-06-05") == ["06-02", "06-04"]


def test_message_parts(spark):
    parts = lambda t, n=4096: one(spark, text.message_parts(F.lit(t), n))
    assert parts("") == [""] and len(parts("a" * 4096)) == 1 and [len(p) for p in parts("a" * 4097)] == [4096, 1]
    assert parts("a" * 4086 + "\n" + "b" * 20) == ["a" * 4086, "b" * 20] and parts("123456789", 3) == ["123", "456", "789"]
    for t, n in [("a\nb\nc\n\nd" * 7, 5), ("\n" * 9, 2), ("xyz\n" * 30, 4)]:
        assert parts(t, n) == [c for _, c in text.MessageParts().eval(t, n)]


def test_small_text_functions(spark):
    assert [one(spark, text.approval(F.lit(c)).getField("draft_id")) for c in ("approve:draft:with:colons", "unknown:123", "approve", "")] == ["draft:with:colons", None, None, None]
    assert [one(spark, text.command(F.lit(c))) for c in ("/start@Bot", "/profil vize", "hallo")] == ["start", "profil", None]
    assert one(spark, text.postcode_city(F.lit("10115 Berlin"))).asDict() == {"postal_code": "10115", "city": "Berlin"}
    assert one(spark, text.given_family(F.lit("Ayşe Nur Yılmaz"))).asDict() == {"given": "Ayşe", "family": "Yılmaz"}
    assert one(spark, text.html_escaped(F.lit("<a&b>"))) == "&lt;a&amp;b&gt;"
    assert one(spark, text.loosely_matches(F.lit("Ausländerbehörde Berlin"), F.lit("ausländerbehörde")))


def test_mime(spark):
    kinds = {b"\xff\xd8\xff" + b"0" * 9: "image/jpeg", b"RIFF0000WEBP": "image/webp", b"0000ftypheic": "image/heic", b"%PDF-1.7....": "application/pdf", b"short": None}
    assert [one(spark, binary.mime_of(F.lit(k))) for k in kinds] == list(kinds.values())


def test_json_and_repair(spark):
    good = '{"authority":"A","request_type":"R","summary":"S","deadline_token":null,"risk_level":"low","missing_documents":[],"next_steps":[],"confidence":0.5,"in_scope":true}'
    df = spark.createDataFrame([(1, f"```json\n{good}\n```"), (2, '{"foo":"bar"}'), (3, "no json")], "i int, answer string")
    out = {r.i: r for r in jsonx.repaired(df, "answer", lambda bad: bad.withColumn("answer", F.when(F.col("i") == 2, good).otherwise(F.col("answer")))).collect()}
    assert out[1].ok and out[2].ok and not out[3].ok and "json" in out[3].errors


def test_vault(spark):
    key, other = bytes(range(32)), bytes(range(1, 33))
    bound = vault.scope(F.lit("u"), F.lit("d"), F.lit("[[NAME_1]]"))
    df = spark.range(3).withColumn("s", vault.seal(F.concat(F.lit("Schulz "), F.col("id").cast("string")), key, bound)).cache()
    assert [r[0] for r in df.select(vault.opened(F.col("s"), key, bound)).collect()] == ["Schulz 0", "Schulz 1", "Schulz 2"]
    assert {r[0] for r in df.select(vault.opened(F.col("s"), other, bound)).collect()} == {None}
    assert df.select("s.iv").distinct().count() == 3
    import hashlib
    import hmac

    assert one(spark, vault.fingerprint(F.lit("Schulz"), key)) == hmac.new(key, b"schulz", hashlib.sha256).hexdigest()[:32]
    with pytest.raises(ValueError):
        vault.master_key(None)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.txt").write_text("Zeile 1\nZeile 2")
    (tmp_path / "e.json").write_text('{"_note": "x", "01": {"risk": "low"}, "02": {"risk": "high"}}')
    assert [tuple(r) for r in tables.letters(spark, str(tmp_path / "l")).collect()] == [("a.txt", "Zeile 1\nZeile 2")]
    assert sorted((r.case_key, r.value.risk) for r in tables.keyed_json(spark, str(tmp_path / "e.json"), "risk string").collect()) == [("01", "low"), ("02", "high")]
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "p.bin").write_bytes(b"\xff\xd8\xff" + b"0" * 20)
    read = tables.transcribed(tables.images(spark, str(tmp_path / "i")), tables.mock_reader).first()
    assert read.mime == "image/jpeg" and "Ausländerbehörde" in read.text
    html = F.lit('<ul><li class="slot-item">10:00 <b>frei</b></li><li>x</li><li class="a slot-item"> </li></ul>')
    assert one(spark, page_items(html, css_class="slot-item")) == ["10:00 frei"]
    parts = sinks.approval_requests(spark.createDataFrame([("d1", "s", "b" * 5000)], "draft_id string, subject string, body string")).orderBy("part").collect()
    assert [p.chunk for p in parts] == ["s\n", "b" * 4096, "b" * 904]  # the blank line after the title is the last line end within the limit
    assert [(p.is_last, p.approve) for p in parts] == [(False, None), (False, None), (True, "approve:d1")]
    with pytest.raises(ValueError):
        tables.Settings.of({"ENVIRONMENT": "production"})
    assert tables.Settings.of({"RETENTION_DAYS": " "}).retention_days == 30
    for odd in ({"DELETION_CRON": "0 25 * * *"}, {"MASTER_KEY": "ab"}, {"RETENTION_DAYS": "0"}):
        with pytest.raises(ValueError):
            tables.Settings.of(odd)
    assert tables.Settings.of({"DELETION_CRON": "30 2 * * 1-5", "MASTER_KEY": "ab" * 32}).deletion_cron == "30 2 * * 1-5"
