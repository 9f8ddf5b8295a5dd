"""The registered queries over the driver's tables, each beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import binary, dates, jsonx, page, residue, schedule, text, tolerance, vault
from ..operators import buckets, evals, joins, masking, partitions, secrets, store
from ..sources import scratch, sinks, tables
from ..streaming import events as ev
from ..streaming import timed
from . import letters as ltr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The clock of every query.
NOW = "1998-08-02 12:00:00"
KEY, OTHER_KEY = bytes(range(32)), bytes(range(1, 33))


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The letters in SQL, with their parts.
LETTERS = f"""parts AS (
    SELECT o_orderkey, c_custkey, o_orderdate, o_orderpriority,
        {_list(ltr.GIVEN)}[c_nationkey % 5 + 1] AS given, {_list(ltr.FAMILY)}[(c_nationkey // 5) % 5 + 1] AS family,
        {_list(ltr.STREETS)}[c_custkey % 5 + 1] || ' ' || (c_custkey % 90 + 1) AS street, (c_custkey % 80000 + 10000) || ' ' || {_list(ltr.CITIES)}[c_custkey % 5 + 1] AS town,
        'ABH-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS file_number, strftime(o_orderdate, '%d.%m.%Y') AS deadline_text, 'kunde' || c_custkey || '@mail.example' AS email
    FROM orders JOIN customer ON o_custkey = c_custkey),
letters AS (SELECT *, given || ' ' || family AS name FROM parts)"""


def _letter_sql(name: str, street: str, town: str, file_number: str, deadline: str, email: str) -> str:
    return (
        f"'Ausländerbehörde' || chr(10) || 'Herrn ' || {name} || chr(10) || {street} || chr(10) || {town} || chr(10) || chr(10) || 'Aktenzeichen: ' || {file_number} || chr(10) || "
        f"'Bitte reichen Sie die Unterlagen bis zum ' || {deadline} || ' ein.' || chr(10) || 'Kontakt: ' || {email} || chr(10) || 'Mit freundlichen Grüßen'"
    )


PLAIN = _letter_sql("name", "street", "town", "file_number", "deadline_text", "email")
MASKED = _letter_sql("'[[NAME_1]]'", "'[[ADDRESS_1]]'", "'[[ADDRESS_2]]'", "'[[AKTENZEICHEN_1]]'", "'[[DATE_1]]'", "'[[EMAIL_1]]'")


# ---- spans and masking


def _spans(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(masking.pattern_spans(F.col("text"), kinds)).alias("s")).select("doc_id", F.col("s.original").alias("original"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS original FROM documents")
def email_spans(spark, sf_dir):
    return _spans(spark, sf_dir, "EMAIL")


@query(r"""SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{1,2}\.\s?[0-9]{1,2}\.\s?[0-9]{2,4}\b') || regexp_extract_all(text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')) AS original FROM documents""")
def date_spans(spark, sf_dir):
    return _spans(spark, sf_dir, "DATE")


@query(r"""
    SELECT doc_id, m AS original FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:(?:\+|00)49|\(0\)|\b0)[\s\-/]?[0-9]{2,5}[\s\-/]?[0-9]{3,9}(?:[\s\-/]?[0-9]{1,6})?\b')) AS m FROM documents)
    WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 7 AND 15""")
def phone_spans(spark, sf_dir):
    return _spans(spark, sf_dir, "PHONE")



@query("""
    WITH b AS (SELECT c_custkey, '37040044' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS body FROM customer),
    c AS (SELECT c_custkey, body, 98 - CAST(CAST(body || '131400' AS HUGEINT) % 97 AS INTEGER) AS digits FROM b)
    SELECT c_custkey, 'DE' || lpad(CAST(CASE WHEN c_custkey % 3 = 0 THEN digits % 97 + 1 ELSE digits END AS VARCHAR), 2, '0') || body AS iban,
        (CASE WHEN c_custkey % 3 = 0 THEN digits % 97 + 1 ELSE digits END) = digits AS valid FROM c""")
def iban_candidates_valid(spark, sf_dir):
    body = F.concat(F.lit("37040044"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    digits = (98 - F.pmod(F.concat(body, F.lit("131400")).cast("decimal(30,0)"), F.lit(97))).cast("int")
    shown = F.when(F.col("c_custkey") % 3 == 0, digits % 97 + 1).otherwise(digits)
    rows = tables.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("DE"), F.lpad(shown.cast("string"), 2, "0"), body).alias("iban"))
    return rows.withColumn("valid", masking.iban_valid(F.col("iban")))


@query("""
    WITH b AS (SELECT c_custkey, '37040044' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS body FROM customer),
    c AS (SELECT c_custkey, body, 98 - CAST(CAST(body || '131400' AS HUGEINT) % 97 AS INTEGER) AS digits FROM b),
    m AS (SELECT c_custkey, lpad(CAST(CASE WHEN c_custkey % 3 = 0 THEN (digits + 1) % 97 ELSE digits END AS VARCHAR), 2, '0') || replace(substr(body, 1, 6), '0', 'O') || substr(body, 7) AS rest FROM c),
    v AS (SELECT c_custkey, rest, unnest(range(8)) AS k FROM m),
    r AS (SELECT c_custkey, substr(rest, 1, 4) || CASE WHEN k % 2 = 1 THEN '0' ELSE '24' END || substr(rest, 6, 1)
            || CASE WHEN k // 2 % 2 = 1 THEN '0' ELSE '24' END || CASE WHEN k // 4 = 1 THEN '0' ELSE '24' END || substr(rest, 9) AS read FROM v)
    SELECT c_custkey, bool_or(CAST(substr(read, 3) || '1314' || substr(read, 1, 2) AS HUGEINT) % 97 = 1) AS readable FROM r GROUP BY c_custkey""")
def iban_misread_repaired(spark, sf_dir):
    """Numbers whose first account digits were misread, 0 as O; of every third the check digits are wrong too. SQL tries all eight readings."""
    body = F.concat(F.lit("37040044"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    digits = (98 - F.pmod(F.concat(body, F.lit("131400")).cast("decimal(30,0)"), F.lit(97))).cast("int")
    shown = F.when(F.col("c_custkey") % 3 == 0, (digits + 1) % 97).otherwise(digits)
    iban = F.concat(F.lit("DE"), F.lpad(shown.cast("string"), 2, "0"), F.replace(F.substring(body, 1, 6), F.lit("0"), F.lit("O")), F.substring(body, 7, 20))
    return tables.table(spark, sf_dir, "customer").select("c_custkey", masking.iban_readable(iban).alias("readable"))


@query("""
    WITH d AS (SELECT DISTINCT o_orderkey, lpad(CAST((o_orderkey * 7919 + 12345678901) % 100000000000 AS VARCHAR), 11, '0') AS digits FROM orders),
    e AS (SELECT *, [substr(digits, i, 1) for i in range(1, 11)] AS first FROM d)
    SELECT o_orderkey, digits, substr(digits, 1, 1) <> '0' AND len(list_distinct(first)) >= 8
        AND len(list_filter(list_distinct(first), lambda c: len(list_filter(first, lambda x: x = c)) > 1)) <= 1 AS plausible FROM e""")
def tax_id_plausible(spark, sf_dir):
    digits = F.lpad(((F.col("o_orderkey") * 7919 + F.lit(12345678901)) % F.lit(100000000000)).cast("string"), 11, "0")
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", digits.alias("digits")).withColumn("plausible", masking.plausible_tax_id(F.col("digits")))


@query(f"WITH {LETTERS} SELECT o_orderkey, {MASKED} AS masked_text, 6 AS n_masked FROM letters")
def letter_masking(spark, sf_dir):
    return masking.masked(ltr.letters(spark, sf_dir)).select("o_orderkey", "masked_text", "n_masked")


@query(f"""WITH {LETTERS} SELECT o_orderkey, {MASKED} || chr(10) || 'Sehr geehrter Herr [[NAME_2]],' AS masked_text, 7 AS n_masked FROM letters""")
def letter_masking_profile(spark, sf_dir):
    rows = ltr.letters(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\nSehr geehrter Herr "), F.element_at(F.split("name", " "), -1), F.lit(",")))
    rows = rows.withColumn("profile", F.struct(F.col("name").alias("full_name"), F.col("email").alias("email")))
    return masking.masked(rows, profile="profile").select("o_orderkey", "masked_text", "n_masked")


@query(f"""WITH {LETTERS} SELECT o_orderkey, {_letter_sql("name", "street", "town", "file_number", "'[[DATE_1]]'", "email")} AS masked_text FROM letters""")
def mask_only_dates(spark, sf_dir):
    return masking.masked(ltr.letters(spark, sf_dir), only=["DATE"]).select("o_orderkey", "masked_text")


@query(r"""
    WITH s AS (SELECT doc_id, 'EMAIL' AS type, unnest(list_distinct([lower(x) for x in regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')])) AS v FROM documents)
    SELECT count(DISTINCT doc_id) AS docs, count(*) AS values_masked FROM s""")
def mask_documents_emails(spark, sf_dir):
    rows = masking.masked(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), only=["EMAIL"])
    return rows.where("n_masked > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_masked").cast("long").alias("values_masked"))


@query(f"WITH {LETTERS} SELECT unnest(['NAME', 'ADDRESS', 'AKTENZEICHEN', 'DATE', 'EMAIL']) AS type, unnest([1, 2, 1, 1, 1]) * (SELECT count(*) FROM letters) AS n")
def token_census(spark, sf_dir):
    return masking.token_census(masking.masked(ltr.letters(spark, sf_dir)))


@query(f"WITH {LETTERS} SELECT o_orderkey, {PLAIN} AS text, true AS same FROM letters")
def unmask_roundtrip(spark, sf_dir):
    rows = masking.masked(ltr.letters(spark, sf_dir)).withColumn("back", masking.unmasked(F.col("masked_text"), F.col("matches")))
    return rows.select("o_orderkey", F.col("back").alias("text"), (F.col("back") == F.col("text")).alias("same"))


@query(f"WITH {LETTERS} SELECT o_orderkey, 0 AS n_leaks, CASE WHEN o_orderkey % 2 = 0 THEN 'NAME' ELSE 'EMAIL' END AS leaked FROM letters")
def leak_audit(spark, sf_dir):
    """Leaks of masked letters, and of the same with one value slipped back in, in capitals."""
    rows = masking.masked(ltr.letters(spark, sf_dir))
    slipped = F.concat("masked_text", F.lit(" "), F.when(F.col("o_orderkey") % 2 == 0, F.upper("name")).otherwise(F.upper("email")))
    return rows.select("o_orderkey", F.size(masking.leaks(F.col("masked_text"), F.col("matches"))).alias("n_leaks"), F.array_join(masking.leaks(slipped, F.col("matches")), ",").alias("leaked"))


@query(f"WITH {LETTERS} SELECT o_orderkey % 2 = 0 AS slipped, o_orderkey % 2 = 1 AS passes, count(*) AS n FROM letters GROUP BY 1, 2")
def leak_gate_fullwidth(spark, sf_dir):
    """Masked letters, into every other of which the name slips back in full-width letters: the gate stops those and no others."""
    plain = "".join(chr(c) for c in [*range(65, 91), *range(97, 123)])
    wide = F.translate(F.upper("name"), plain, "".join(chr(ord(c) + 0xFEE0) for c in plain))
    rows = masking.masked(ltr.letters(spark, sf_dir)).withColumn("slipped", F.col("o_orderkey") % 2 == 0)
    rows = rows.withColumn("masked_text", F.concat("masked_text", F.when(F.col("slipped"), F.concat(F.lit(" "), wide)).otherwise("")))
    return masking.gate(rows).groupBy("slipped", "passes").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT c_custkey, 'Ausländernummer: [[AUSLNR_1]]' || chr(10) || 'Versichertennummer: [[INSURANCE_1]]' || chr(10) || 'Reisepass: [[PASSPORT_1]]' || chr(10) || 'Telefon [[PHONE_1]]' || chr(10) ||
        'Geboren am [[DATE_1]]' || chr(10) || 'Konto [[IBAN_1]]' || chr(10) || 'Steuer-ID: [[STEUERID_1]]' AS masked_text,
        lpad(CAST(c_custkey AS VARCHAR), 9, '7') || '|' || 'A' || lpad(CAST(c_custkey AS VARCHAR), 9, '5') || '|' || 'C' || lpad(CAST(c_custkey AS VARCHAR), 8, '6') || '|' ||
        '+49 30 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '4') || '|' || (c_custkey % 28 + 1) || '. Juni 1984' || '|' || 'DE89 3704 0044 0532 0130 00' || '|' || '98 765 432 1' || lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '0') AS originals
    FROM customer""")
def letter_numbers(spark, sf_dir):
    """Every kind of number that letters have: foreigners', insurance and passport numbers, phones, written dates, accounts and tax ids."""
    key = F.col("c_custkey").cast("string")
    values = [
        ("Ausländernummer: ", F.lpad(key, 9, "7")), ("Versichertennummer: ", F.concat(F.lit("A"), F.lpad(key, 9, "5"))), ("Reisepass: ", F.concat(F.lit("C"), F.lpad(key, 8, "6"))),
        ("Telefon ", F.concat(F.lit("+49 30 "), F.lpad(key, 7, "4"))), ("Geboren am ", F.concat((F.col("c_custkey") % 28 + 1).cast("string"), F.lit(". Juni 1984"))), ("Konto ", F.lit("DE89 3704 0044 0532 0130 00")),
        ("Steuer-ID: ", F.concat(F.lit("98 765 432 1"), F.lpad((F.col("c_custkey") % 90).cast("string"), 2, "0"))),
    ]
    rows = tables.dealt(tables.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.concat_ws("\n", *[F.concat(F.lit(label), v) for label, v in values]).alias("text"))
    return masking.masked(rows).select("c_custkey", "masked_text", F.array_join(F.transform("matches", lambda m: m["original"]), "|").alias("originals"))


@query(f"WITH {LETTERS} SELECT o_orderkey, CAST(6 AS DOUBLE) / len(regexp_extract_all({MASKED}, '[^ \\n]+')) AS density, true AS within FROM letters")
def mask_density(spark, sf_dir):
    rows = masking.masked(ltr.letters(spark, sf_dir))
    return rows.select("o_orderkey", masking.density(F.col("masked_text")).alias("density"), masking.dense_enough(F.col("masked_text")).alias("within"))


@query(f"WITH {LETTERS} SELECT o_orderkey, {MASKED} || chr(10) || 'Verwendungszweck: [[AKTENZEICHEN_1]]' AS masked_text FROM letters")
def propagated_case_number(spark, sf_dir):
    rows = ltr.letters(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\nVerwendungszweck: "), F.col("file_number")))
    return masking.masked(rows).select("o_orderkey", "masked_text")


@query(r"""SELECT o_orderkey, 'Siehe ⟦⟧NAME_' || (o_orderkey % 10) || '⟦⟧ und ⟦⟧DATE_1⟦⟧.' AS masked_text, 0 AS n_masked FROM orders""")
def token_injection_neutralised(spark, sf_dir):
    said = F.concat(F.lit("Siehe [[NAME_"), (F.col("o_orderkey") % 10).cast("string"), F.lit("]] und [[DATE_1]]."))
    return masking.masked(tables.dealt(tables.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", said.alias("text"))).select("o_orderkey", "masked_text", "n_masked")


@query("""
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Sehr geehrte Damen und Herren,' WHEN 1 THEN 'Sehr geehrter Herr [[NAME_1]],' WHEN 2 THEN 'Sachbearbeiterin: Frau [[NAME_1]]'
        WHEN 3 THEN 'i. A. [[NAME_1]]' WHEN 4 THEN 'Ihre Ehefrau [[NAME_1]] kommt.' ELSE 'gez. SCHULZ' END AS masked_text FROM customer""")
def name_trigger_stoplist(spark, sf_dir):
    forms = ("Sehr geehrte Damen und Herren,", "Sehr geehrter Herr Dr. Schulz,", "Sachbearbeiterin: Frau Meier-Vogt", "i. A. Brandt", "Ihre Ehefrau Leyla Kaplan kommt.", "gez. SCHULZ")
    rows = tables.dealt(tables.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", ltr.pick(forms, F.col("c_custkey")).alias("text"))
    return masking.masked(rows).select("c_custkey", F.replace("masked_text", F.lit("Dr. "), F.lit("")).alias("masked_text"))


@query(f"""
    WITH {LETTERS} SELECT o_orderkey, NOT (o_orderkey % 3 = 0 AND contains(street, 'e')) AS street_found, NOT (o_orderkey % 3 = 0 AND contains(name, 'e')) AS name_found FROM letters""")
def ocr_tolerant_match(spark, sf_dir):
    """Streets and names of letters, damaged as a reader damages them, are found by their clean values; where e became x, which no reader does, those with an e are not."""
    read = F.translate(F.replace(F.concat_ws("\n", "street", "name"), F.lit("rn"), F.lit("m")), "ß1", "Bl")
    read = F.when(F.col("o_orderkey") % 3 == 0, F.translate(read, "e", "x")).otherwise(read)
    rows = ltr.letters(spark, sf_dir).select("o_orderkey", masking.value_places(read, F.array("street", "name")).alias("p"))
    return rows.select("o_orderkey", (F.size(F.col("p")[0]) > 0).alias("street_found"), (F.size(F.col("p")[1]) > 0).alias("name_found"))


#: What a piece of a word in lower case may have been read as, as a pattern of SQL.
_PIECES = """CASE u WHEN 'ss' THEN '(?:[sS][sS]|ß|[bB]|[fF][sS])' WHEN 'ae' THEN '(?:[aA][eE]|[äÄ])' WHEN 'oe' THEN '(?:[oO][eE]|[öÖ])' WHEN 'ue' THEN '(?:[uU][eE]|[üÜ])'
    WHEN 'rn' THEN '(?:[rR][nN]|[mM])' WHEN 'o' THEN '[oO0qQdD]' WHEN 's' THEN '[sS5]' WHEN 'b' THEN '[bB8ß]' WHEN 'g' THEN '[gG6]' WHEN 'z' THEN '[zZ2]' WHEN 'l' THEN '[lL1I|]'
    WHEN 'i' THEN '[iıIİ1lL|]' ELSE '[' || u || upper(u) || ']' END"""


@query(rf"""
    WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{{10,}}'))) AS value FROM benchmark),
    p AS (SELECT value, array_to_string(list_transform(regexp_extract_all(value, 'ss|ae|oe|ue|rn|.'), lambda u: {_PIECES}), '') AS pattern FROM w)
    SELECT doc_id, value, CAST(len(regexp_extract_all(text, pattern)) AS BIGINT) AS n FROM documents, p WHERE regexp_matches(text, pattern)""")
def known_words_in_documents(spark, sf_dir):
    """The long words of all benchmark items, as they stand in all documents, read rightly or not."""
    words = tables.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{10,}"), F.lit(0))).alias("value"))
    found = masking.known_places(tables.spread(tables.table(spark, sf_dir, "documents").select("doc_id", "text")), words, "doc_id")
    return found.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
    WITH s AS (SELECT c_custkey, {_list(ltr.STREETS)}[c_custkey % 5 + 1] || ' ' || (c_custkey % 90 + 1) AS street, {_list(ltr.GIVEN)}[c_nationkey % 5 + 1] || ' ' || {_list(ltr.FAMILY)}[(c_nationkey // 5) % 5 + 1] AS name FROM customer),
    t AS (SELECT *, 'Herrn [[NAME_1]], Ihr Antrag aus der ' || CASE c_custkey % 4 WHEN 0 THEN translate(street, 'ßa', 'Bo') WHEN 1 THEN reverse(street) WHEN 2 THEN substr(street, 3) ELSE replace(street, 'e', 'ee') END
            || ' vom [[DATE_1]] liegt vor. ' || CASE c_custkey % 3 WHEN 0 THEN upper(translate(name, 'l', '1')) WHEN 1 THEN substr(name, 5) ELSE '' END AS text FROM s),
    v AS (SELECT c_custkey, regexp_replace(text, '\[\[[A-Z]+_[0-9]+\]\]', ' ', 'g') AS hay, unnest([street, name]) AS value FROM t),
    n AS (SELECT *, length(value) AS w, unnest(range(greatest(4, CAST(floor(length(value) * 0.75) AS BIGINT)), CAST(ceil(length(value) * 1.25) AS BIGINT) + 1)) AS n FROM v),
    i AS (SELECT *, unnest(range(1, length(hay) - n + 2)) AS i FROM n),
    d AS (SELECT *, 1 - levenshtein(translate(lower(substr(hay, i, n)), 'ß', '~'), translate(lower(value), 'ß', '~')) / greatest(n, w) AS score FROM i)
    SELECT c_custkey, value, substr(hay, i, n) AS "window", round(score, 6) AS score FROM d WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY c_custkey, value ORDER BY score DESC, n, i) = 1""")
def residue_letters(spark, sf_dir):
    """Streets and names that masked letters still hold, misread, cut or turned around: the windows most like them, where any is like enough."""
    names = F.concat_ws(" ", ltr.pick(ltr.GIVEN, F.col("c_nationkey")), ltr.pick(ltr.FAMILY, F.floor(F.col("c_nationkey") / 5)))
    rows = tables.spread(tables.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    rows = rows.select("c_custkey", F.concat(ltr.pick(ltr.STREETS, F.col("c_custkey")), F.lit(" "), (F.col("c_custkey") % 90 + 1).cast("string")).alias("street"), names.alias("name"))
    one = F.when(F.col("c_custkey") % 4 == 0, F.translate("street", "ßa", "Bo")).when(F.col("c_custkey") % 4 == 1, F.reverse("street"))
    one = one.when(F.col("c_custkey") % 4 == 2, F.substring("street", 3, 99)).otherwise(F.replace("street", F.lit("e"), F.lit("ee")))
    two = F.when(F.col("c_custkey") % 3 == 0, F.upper(F.translate("name", "l", "1"))).when(F.col("c_custkey") % 3 == 1, F.substring("name", 5, 99)).otherwise(F.lit(""))
    text = F.concat(F.lit("Herrn [[NAME_1]], Ihr Antrag aus der "), one, F.lit(" vom [[DATE_1]] liegt vor. "), two)
    found = rows.select("c_custkey", F.explode(residue.residues(text, F.array("street", "name"))).alias("r"))
    return found.select("c_custkey", "r.value", "r.window", F.round("r.score", 6).alias("score"))


@query("""SELECT c_custkey, true AS near, false AS far FROM customer""")
def residue_scan(spark, sf_dir):
    """Names left in a text with one character changed are found; texts without them are clean."""
    rows = tables.table(spark, sf_dir, "customer").repartition(spark.sparkContext.defaultParallelism, "c_custkey").select("c_custkey", F.translate("c_name", "0", "o").alias("value"))
    damaged = F.concat(F.lit("Schreiben an "), F.replace("value", F.lit("C"), F.lit("c")), F.lit("x, bitte. [[NAME_1]]"))
    found = lambda t: residue.residue(t, F.col("value")).isNotNull()
    return rows.select("c_custkey", found(damaged).alias("near"), found(F.lit("Das Wetter bleibt heute und morgen gut.")).alias("far"))


# ---- dates, risk, reminders


@query(r"""
    SELECT o_orderkey, form, CASE WHEN form < 5 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS parsed FROM orders, range(7) f(form)""")
def parse_german_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    names = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
    forms = F.array(
        F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "d.M.yy"), F.date_format(d, "dd. MM. yyyy"), F.date_format(d, "yyyy-MM-dd"),
        F.concat(F.date_format(d, "d. "), ltr.pick(names, F.month(d) - 1), F.date_format(d, " yyyy")), F.concat(F.lit("31.02."), F.year(d).cast("string")), F.lit("demnächst"),
    )
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(forms).alias("form", "t"))
    return rows.select("o_orderkey", F.col("form").cast("long").alias("form"), dates.german_date(F.col("t")).cast("string").alias("parsed"))


_RISK = "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END"


def _risk() -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in ltr.PRIORITY_RISK.items() for x in (k, v)])[F.col("o_orderpriority")], F.lit("low"))


@query(f"""
    WITH d AS (SELECT o_orderkey, {_RISK} AS model, CAST(date_diff('day', DATE '1998-08-02', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders),
    r AS (SELECT *, CASE WHEN days <= 3 THEN 3 WHEN days <= 7 THEN 2 WHEN days <= 14 THEN 1 ELSE 0 END AS t, list_position(['low', 'medium', 'high', 'critical'], model) - 1 AS m FROM d)
    SELECT o_orderkey, days, ['low', 'medium', 'high', 'critical'][greatest(t, m) + 1] AS risk FROM r""")
def risk_escalation(spark, sf_dir):
    deadline = F.to_date("o_orderdate")
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", dates.days_until(deadline, now()).alias("days"), dates.escalated(_risk(), deadline, now()).alias("risk"))


@query(f"""SELECT o_orderkey, due FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) - to_days(CAST(unnest([14, 7, 3, 1]) AS INTEGER)) AS due FROM orders) WHERE due > TIMESTAMP '{NOW}'""")
def reminder_fanout(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.explode(dates.reminder_dates(F.to_date("o_orderdate"), now())).alias("due"))
    return rows.select("o_orderkey", F.col("due").cast("timestamp_ntz").alias("due"))


def _reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("analysis_id"), F.col("l_suppkey").alias("user_id"), F.col("l_shipdate").cast("timestamp").alias("due_date"),
        F.when(F.col("l_linestatus") == "O", "scheduled").otherwise("sent").alias("status"),
    )


@query(f"""
    SELECT l_orderkey || '-' || l_linenumber AS id, s_name, strftime(l_shipdate, '%d.%m.%Y') AS due, o_orderstatus FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey
    WHERE l_linestatus = 'O' AND l_shipdate <= TIMESTAMP '{NOW}'""")
def due_reminders(spark, sf_dir):
    due = store.due(_reminders(spark, sf_dir), now())
    users = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), "s_name")
    analyses = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id"), "o_orderstatus")
    return due.join(users, "user_id").join(analyses, "analysis_id", "left").select("id", "s_name", dates.deadline_text(F.col("due_date")).alias("due"), "o_orderstatus")


@query(f"SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS deadline FROM orders WHERE CAST(o_orderdate AS DATE) <= CAST(TIMESTAMP '{NOW}' AS DATE)")
def upcoming_deadlines(spark, sf_dir):
    rows = store.upcoming(tables.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("deadline")), now())
    return rows.select("o_orderkey", F.col("deadline").cast("string").alias("deadline"))


# ---- records


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def find_by_id(spark, sf_dir):
    return store.by_id(tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 7)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def find_by_channel(spark, sf_dir):
    return store.by_all(tables.table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=3).select("c_custkey", "c_name")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders WHERE o_custkey = 11")
def docs_by_user(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id")
    mine = store.newest_first(rows, 11, "o_orderdate", "o_orderkey")
    return mine.select("o_orderkey", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).cast("long").alias("place"))


@query("""
    WITH i AS (SELECT c_custkey * 2 AS k, c_name || '!' AS n, CASE WHEN c_custkey % 2 = 0 THEN 'tr' END AS l FROM customer)
    SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(n, c_name) AS c_name, CASE WHEN c_custkey IS NULL THEN coalesce(l, 'de') WHEN k IS NULL THEN c_mktsegment ELSE coalesce(l, c_mktsegment) END AS locale
    FROM customer FULL JOIN i ON c_custkey = k""")
def upsert_users(spark, sf_dir):
    base = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("locale"))
    new = base.select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat("c_name", F.lit("!")).alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, "tr").alias("locale"))
    return store.upserted(base, new, ("c_custkey",), {"locale": F.lit("de")})


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 'patched' ELSE o_orderpriority END AS o_orderpriority,
        CASE WHEN o_orderstatus IN ('F', 'O') THEN TIMESTAMP '1998-08-02 12:00:00' ELSE o_orderdate END AS updated_at FROM orders""")
def patch_update(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    nothing = F.create_map(F.lit("o_orderstatus"), F.lit(None).cast("string"))
    fields = F.when(F.col("o_orderstatus") == "F", nothing).otherwise(F.create_map(F.lit("o_orderpriority"), F.lit("patched")))
    patches = rows.where("o_orderstatus IN ('F', 'O')").select("o_orderkey", fields.alias("fields"))
    out = store.patched(rows, patches, "o_orderkey", now())
    return out.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 1499 = 7 THEN 'patched' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 1499 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
    FROM orders WHERE o_orderkey % 1501 <> 11""")
def changes_by_bucket(spark, sf_dir):
    """A table in folders by its key: some keys are changed, the last of three changes counts, others are deleted, and only their folders are written."""
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    path = scratch.folder(spark, "bucketed")
    buckets.written_by_key(rows, path, "o_orderkey", 64)
    some = rows.where("o_orderkey % 1499 = 7").select("o_orderkey", F.explode(F.array(F.lit(2), F.lit(3), F.lit(1))).alias("at"))
    news = some.select("o_orderkey", F.when(F.col("at") == 3, "patched").otherwise("lost").alias("o_orderpriority"), F.when(F.col("at") == 3, "X").otherwise("Y").alias("o_orderstatus"), "at")
    buckets.changed_by_key(spark, path, news, "o_orderkey", lambda old, new: store.upserted(old, new, ("o_orderkey",), {}, order="at"), 64)
    gone = rows.where("o_orderkey % 1501 = 11").select("o_orderkey")
    buckets.changed_by_key(spark, path, gone, "o_orderkey", lambda old, keys: store.without(old, keys, "o_orderkey"), 64)
    return buckets.read_by_key(spark, path)


@query("""
    WITH d AS (SELECT DISTINCT o_orderkey, lpad(CAST((o_orderkey * 7919 + 12345678901) % 100000000000 AS VARCHAR), 11, '0') AS d FROM orders),
    e AS (SELECT *, [substr(d, i, 1) for i in range(1, 11)] AS first FROM d)
    SELECT o_orderkey, 'Nummer ' || CASE WHEN substr(d, 1, 1) <> '0' AND len(list_distinct(first)) >= 8 AND len(list_filter(list_distinct(first), lambda c: len(list_filter(first, lambda x: x = c)) > 1)) <= 1
        THEN '[[STEUERID_1]]' ELSE substr(d, 1, 2) || ' ' || substr(d, 3, 3) || ' ' || substr(d, 6, 3) || ' ' || substr(d, 9) END || ', danke' AS masked_text FROM e""")
def bare_tax_ids(spark, sf_dir):
    """Tax numbers without a label, in groups as they are written, masked where their digits are those of one."""
    d = F.lpad(((F.col("o_orderkey") * 7919 + F.lit(12345678901)) % F.lit(100000000000)).cast("string"), 11, "0")
    said = F.concat(F.lit("Nummer "), F.concat_ws(" ", F.substring(d, 1, 2), F.substring(d, 3, 3), F.substring(d, 6, 3), F.substring(d, 9, 3)), F.lit(", danke"))
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", said.alias("text"))
    return masking.masked(rows, only=["STEUERID"]).select("o_orderkey", "masked_text")


def _purgeable(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    item, order = tables.table(spark, sf_dir, "lineitem"), tables.table(spark, sf_dir, "orders")
    customer = tables.table(spark, sf_dir, "customer")
    timed = lambda df, c: df.select(F.col(c).cast("timestamp").alias("delete_after"))
    return {
        "pii_vault": timed(item.where("l_returnflag = 'R'"), "l_shipdate"), "drafts": timed(item.where("l_returnflag = 'A'"), "l_shipdate"), "analyses": timed(order, "o_orderdate"),
        "reminders": timed(item.where("l_returnflag = 'N'"), "l_shipdate"), "documents": timed(order.where("o_orderstatus = 'F'"), "o_orderdate"),
        "users": customer.select(F.when(F.col("c_acctbal") < 0, F.lit("1996-01-01").cast("timestamp")).alias("delete_after")),
    }


@query(f"""
    SELECT 'pii_vault' AS table_name, count(*) AS deleted_count FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '{NOW}' UNION ALL
    SELECT 'drafts', count(*) FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate < TIMESTAMP '{NOW}' UNION ALL SELECT 'analyses', count(*) FROM orders WHERE o_orderdate < TIMESTAMP '{NOW}' UNION ALL
    SELECT 'reminders', count(*) FROM lineitem WHERE l_returnflag = 'N' AND l_shipdate < TIMESTAMP '{NOW}' UNION ALL
    SELECT 'documents', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '{NOW}' UNION ALL SELECT 'users', count(*) FROM customer WHERE c_acctbal < 0""")
def purge_expired_counts(spark, sf_dir):
    return store.purged(_purgeable(spark, sf_dir), now())[1].select("table_name", "deleted_count")


@query(f"""
    WITH t AS (
        SELECT 'pii_vault' AS table_name, CAST(l_shipdate AS TIMESTAMP) AS t FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'drafts', l_shipdate FROM lineitem WHERE l_returnflag = 'A'
        UNION ALL SELECT 'analyses', o_orderdate FROM orders UNION ALL SELECT 'reminders', l_shipdate FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT 'documents', o_orderdate FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 'users', CASE WHEN c_acctbal < 0 THEN TIMESTAMP '1996-01-01' END FROM customer)
    SELECT table_name, count(*) FILTER (t < TIMESTAMP '{NOW}') AS deleted_count, count(*) FILTER (t IS NULL OR t >= TIMESTAMP '{NOW}') AS kept_count FROM t GROUP BY table_name""")
def purge_by_partition(spark, sf_dir):
    """Tables laid out by the month in which rows expire: whole months go as folders, only the present one is read and written again."""
    counts = []
    for name, rows in _purgeable(spark, sf_dir).items():
        path = scratch.folder(spark, f"expiring-{name}")
        partitions.written_by_expiry(rows, path, unit="month")
        deleted = partitions.purged_by_expiry(spark, path, now(), unit="month")
        counts.append((name, deleted, spark.read.parquet(path).count()))
    return spark.createDataFrame(counts, "table_name string, deleted_count long, kept_count long")


@query("""
    WITH d AS (SELECT o_orderstatus, c_acctbal > -500 AS known FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT 'documents' AS table_name, 'unknown status' AS violation, count(*) FILTER (o_orderstatus = 'P') AS n, count(*) FILTER (o_orderstatus <> 'P' AND known) AS rows_after FROM d UNION ALL
    SELECT 'documents', 'unknown user_id', count(*) FILTER (NOT known), count(*) FILTER (o_orderstatus <> 'P' AND known) FROM d UNION ALL
    SELECT 'drafts', 'sent without approval', count(*) FILTER (o_orderstatus <> 'F'), count(*) FROM d UNION ALL
    SELECT 'reminders', 'repeated id', (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)), 0""")
def checked_write_refused(spark, sf_dir):
    """Tables with rows that break constraints are refused in the pass that writes them, and what was there before stays."""
    order, customer = tables.table(spark, sf_dir, "orders"), tables.table(spark, sf_dir, "customer")
    users = customer.where("c_acctbal > -500").select(F.col("c_custkey").cast("string").alias("id"))
    status = F.when(F.col("o_orderstatus") == "F", "analyzed").when(F.col("o_orderstatus") == "O", "received").otherwise("pending")
    documents = order.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), status.alias("status"))
    good = documents.where("status <> 'pending'").join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi").select(*documents.columns)
    state = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "draft").otherwise("pending_approval")
    drafts = order.select(F.col("o_orderkey").cast("string").alias("id"), state.alias("status"), F.when(state == "approved", now()).alias("approved_at"))
    reminders = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.lit("scheduled").alias("status"))
    out = []
    for name, first, then, parents, before in (
        ("documents", good, documents, {"users": users}, None), ("drafts", drafts, drafts.withColumn("status", F.lit("sent")), {}, drafts), ("reminders", reminders.limit(0), reminders, {}, None),
    ):
        path = scratch.folder(spark, f"checked-{name}")
        partitions.checked_write(first, name, path, parents)
        try:
            partitions.checked_write(then, name, path, parents, before)
        except partitions.RefusedError as refused:
            after = spark.read.parquet(path).count()
            out += [(name, what, n, after) for what, n in refused.counts.items()]
    return spark.createDataFrame(out, "table_name string, violation string, n long, rows_after long")


@query("""
    WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey * 37 % 86400) AS at FROM orders),
    scan AS (SELECT unnest(generate_series(TIMESTAMP '1992-01-01 00:00:00', TIMESTAMP '2005-01-08 00:00:00', INTERVAL 30 MINUTE)) AS scanned_at),
    night AS (SELECT unnest(generate_series(TIMESTAMP '1992-01-01 03:00:00', TIMESTAMP '2005-01-08 03:00:00', INTERVAL 1 DAY)) AS purged_at),
    week AS (SELECT purged_at + INTERVAL '5 hours 15 minutes' AS reported_at FROM night WHERE dayofweek(purged_at) IN (1, 4) AND month(purged_at) <> 8)
    SELECT o_orderkey, scanned_at, purged_at, reported_at FROM t ASOF JOIN scan ON t.at <= scanned_at ASOF JOIN night ON t.at <= purged_at ASOF JOIN week ON t.at <= reported_at""")
def next_scans(spark, sf_dir):
    """When a half-hourly scan, a nightly purge and a report on Mondays and Thursdays, not in August, first come to each order."""
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") * 37 % 86400).cast("decimal(18,6)"))
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"))
    fires = {"scanned_at": "*/30 * * * *", "purged_at": "0 3 * * *", "reported_at": "15 8 * 1-7,9-12 1,4"}
    return rows.select("o_orderkey", *[schedule.next_fire(F.col("at"), cron).alias(c) for c, cron in fires.items()])


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    order, item = tables.table(spark, sf_dir, "orders"), tables.table(spark, sf_dir, "lineitem")
    line = F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber")
    return {
        "users": tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"),
        "documents": order.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")),
        "analyses": order.select((-F.col("o_orderkey")).alias("id"), F.col("o_orderkey").alias("document_id")),
        "drafts": item.select(line.alias("id"), (-F.col("l_orderkey")).alias("analysis_id")),
        "audit_log": order.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")),
    }


@query("""
    WITH d AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < -500)
    SELECT 'users' AS table_name, count(*) AS deleted_count FROM customer WHERE c_acctbal < -500 UNION ALL SELECT 'documents', count(*) FROM d UNION ALL SELECT 'analyses', count(*) FROM d UNION ALL
    SELECT 'drafts', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM d)""")
def delete_user_cascade(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return store.cascaded(graph, graph["users"].where("c_acctbal < -500"))[1]


@query("""
    WITH d AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < -500), l AS (SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM d))
    SELECT 'users' AS table_name, count(*) AS deleted_count FROM customer WHERE c_acctbal < -500 UNION ALL SELECT 'documents', count(*) FROM d UNION ALL SELECT 'analyses', count(*) FROM d UNION ALL
    SELECT 'drafts', n FROM l UNION ALL SELECT 'reminders', n FROM l UNION ALL SELECT 'pii_vault', n FROM l""")
def cascade_all_edges(spark, sf_dir):
    """Reminders that hang on an analysis alone, and vault rows that hang on a document alone, go with their user too."""
    graph = _graph(spark, sf_dir)
    item = tables.table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber"))
    nobody = F.lit(None).cast("long").alias("user_id")
    graph |= {"reminders": item.select("id", nobody, (-F.col("l_orderkey")).alias("analysis_id")), "pii_vault": item.select("id", nobody, F.col("l_orderkey").alias("document_id"))}
    return store.cascaded(graph, graph["users"].where("c_acctbal < -500"))[1]


@query("SELECT o_orderkey AS id, CASE WHEN c_acctbal < -500 THEN -1 ELSE o_custkey END AS user_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def audit_after_delete(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return store.cascaded(graph, graph["users"].where("c_acctbal < -500"))[0]["audit_log"].select("id", F.coalesce("user_id", F.lit(-1)).alias("user_id"))


@query("""
    SELECT violation, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 1 THEN CASE WHEN l_linestatus = 'F' THEN 'inserted as sent' END
        WHEN l_linestatus = 'F' AND NOT (l_returnflag = 'R' AND l_quantity > 25) THEN 'sent without approval' END AS violation FROM lineitem) GROUP BY violation""")
def draft_gate_violations(spark, sf_dir):
    item = tables.table(spark, sf_dir, "lineitem")
    old = F.when(F.col("l_linenumber") > 1, F.when(F.col("l_returnflag") == "R", "approved").otherwise("draft"))
    at = F.when(F.col("l_quantity") > 25, F.col("l_shipdate").cast("timestamp"))
    new = F.when(F.col("l_linestatus") == "F", "sent").otherwise("approved")
    return item.select(store.draft_gate(old, at, new).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


# ---- vault


def _vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masking.masked(ltr.letters(spark, sf_dir)).withColumns({"user_id": F.col("c_custkey").cast("string"), "document_id": F.col("o_orderkey").cast("string")})
    return vault.sealed_matches(rows, KEY)


@query(f"WITH {LETTERS} SELECT unnest(['NAME', 'ADDRESS', 'AKTENZEICHEN', 'DATE', 'EMAIL']) AS entity_type, unnest([1, 2, 1, 1, 1]) * (SELECT count(*) FROM letters) AS n, unnest([true, true, true, true, true]) AS all_open")
def vault_roundtrip(spark, sf_dir):
    rows = vault.opened_vault(_vault(spark, sf_dir), KEY)
    plain = ltr.letters(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("document_id"), "text")
    return rows.join(plain, "document_id").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.contains("text", "original")).alias("all_open"))


@query(f"WITH {LETTERS} SELECT 12 * count(*) AS n, 12 * count(*) AS n_ivs FROM letters")
def vault_nonce_unique(spark, sf_dir):
    """Sealing two tables with one and the same column gives no iv twice."""
    rows = masking.masked(ltr.letters(spark, sf_dir)).select("c_custkey", "o_orderkey", F.explode("matches").alias("m")).select("c_custkey", "o_orderkey", "m.token", F.col("m.original").alias("value"))
    one = vault.seal(F.col("value"), KEY, vault.scope(F.col("c_custkey"), F.col("o_orderkey"), F.col("token"))).alias("sealed")
    path = scratch.folder(spark, "values")  # both tables are sealed from it, so that letters are masked once
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    both = rows.select(one).unionAll(rows.withColumn("value", F.upper("value")).select(one))
    return both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sealed.iv").alias("n_ivs"))


@query("SELECT 0 AS opened")
def vault_wrong_owner(spark, sf_dir):
    return vault.opened_vault(_vault(spark, sf_dir).withColumn("user_id", F.lit("another")), KEY).agg(F.count(F.lit(1)).cast("int").alias("opened"))


@query(f"WITH {LETTERS} SELECT 6 * count(*) AS total, 0::BIGINT AS unreadable, 0::BIGINT AS unverified FROM letters")
def vault_rotation(spark, sf_dir):
    return vault.rotated(_vault(spark, sf_dir), KEY, OTHER_KEY)[1]


@query("""SELECT CAST(c_custkey AS VARCHAR) AS user_id, nullif(trim(c_name), '') AS full_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS city FROM customer""")
def profile_unpivot_pivot(spark, sf_dir):
    users = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("full_name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_mktsegment"), F.lit("  "))).otherwise(" ").alias("city"))
    return vault.opened_profiles(vault.sealed_profiles(users, KEY, ("full_name", "city")), KEY, ("full_name", "city"))


@query("SELECT count(DISTINCT lower(c_mktsegment)) AS segments, count(*) AS customers, 32 AS digits FROM customer")
def fingerprint_dedupe(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "customer").select(vault.fingerprint(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")), KEY).alias("f"))
    return rows.agg(F.countDistinct("f").alias("segments"), F.count(F.lit(1)).alias("customers"), F.max(F.length("f")).alias("digits"))


# ---- model output


@query("""
    SELECT event_id, CASE event_id % 4 WHEN 2 THEN -1 ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events""")
def json_extract(spark, sf_dir):
    fenced = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Hier:\n```json\n"), "props", F.lit("\n```\nfertig"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("x "), "props", F.lit(" y"))).when(F.col("event_id") % 4 == 2, F.lit("kein Ergebnis")).otherwise(F.col("props"))
    return tables.table(spark, sf_dir, "events").select("event_id", F.from_json(jsonx.json_payload(fenced), "k int")["k"].alias("k")).na.fill(-1, ["k"])


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'deadline_token' WHEN 2 THEN 'risk_level,confidence' ELSE 'json,authority,request_type,summary,risk_level,missing_documents,next_steps,confidence,in_scope' END AS errors FROM orders""")
def json_validate(spark, sf_dir):
    answer = lambda token, risk, conf: f'{{"authority":"A","request_type":"R","summary":"S","deadline_token":{token},"risk_level":"{risk}","missing_documents":[{{"label":"L","required":true}}],"next_steps":[],"confidence":{conf},"in_scope":true,"more":1}}'
    answers = (answer('"[[DATE_1]]"', "low", 0.5), answer('"DATE_1"', "low", 1), answer("null", "none", 1.5), "no answer")
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", ltr.pick(answers, F.col("o_orderkey")).alias("answer"))
    return jsonx.parsed_analysis(rows, "answer").select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query(f"""
    WITH {LETTERS}, d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS deadline, date_diff('day', DATE '1998-08-02', CAST(o_orderdate AS DATE)) AS days FROM letters)
    SELECT o_orderkey, CAST(deadline AS VARCHAR) AS deadline, CASE WHEN days <= 3 THEN 'critical' WHEN days <= 7 THEN 'high' ELSE 'medium' END AS risk, true AS ok,
        CAST(len(list_filter([14, 7, 3, 1], lambda x: CAST(deadline AS TIMESTAMP) - to_days(CAST(x AS INTEGER)) > TIMESTAMP '{NOW}')) AS INTEGER) AS n_reminders FROM d""")
def letter_analysis(spark, sf_dir):
    return ltr.analysed(ltr.letters(spark, sf_dir), now()).select("o_orderkey", F.col("deadline").cast("string").alias("deadline"), "risk", "ok", F.size("reminders").alias("n_reminders"))


@query(f"""
    WITH {LETTERS} SELECT o_orderkey, 'Sehr geehrte Damen und Herren,' || chr(10) || 'anbei erhalten Sie die angeforderten Unterlagen.' || chr(10) || 'Mit freundlichen Grüßen' || chr(10) || name AS body, 0 AS n_leaks FROM letters""")
def letter_draft(spark, sf_dir):
    rows = masking.masked(ltr.letters(spark, sf_dir)).withColumn("draft", jsonx.stand_in_draft(F.col("masked_text")))
    out = F.concat_ws("\n", "draft.subject", "draft.body")
    return rows.select("o_orderkey", masking.unmasked(F.col("draft.body"), F.col("matches")).alias("body"), F.size(masking.leaks(out, F.col("matches"))).alias("n_leaks"))


# ---- events


@query("""
    SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'approval' WHEN turn % 5 = 3 THEN 'command:draft' WHEN length(trim(text)) > 80 THEN 'document' WHEN conv_id % 2 = 0 THEN 'onboarding_answer' ELSE 'unsupported' END AS route
    FROM conversations""")
def event_dispatch(spark, sf_dir):
    conv = tables.table(spark, sf_dir, "conversations")
    say = lambda c: F.to_json(F.struct(F.col("turn").alias("update_id"), F.struct(F.concat_ws("/", "conv_id", "turn").alias("chat_id"), c.alias("text")).alias("message")))
    call = F.to_json(F.struct(F.col("turn").alias("update_id"), F.struct(F.concat(F.lit("approve:"), F.col("conv_id").cast("string")).alias("data"), F.concat_ws("/", "conv_id", "turn").alias("chat_id")).alias("callback_query")))
    raw = F.when(F.col("turn") % 5 == 4, call).when(F.col("turn") % 5 == 3, say(F.lit("/Entwurf@bot now"))).otherwise(say(F.col("text")))
    rows = ev.incoming(conv.select(raw.alias("value")))
    conv_id = F.split("user", "/")[0].cast("long")
    return rows.select(conv_id.alias("conv_id"), F.split("user", "/")[1].cast("long").alias("turn"), ev.route(F.col("kind"), F.col("text"), conv_id % 2 == 0).alias("route"))


@query("""
    WITH e AS (SELECT user_id AS watch, ts, event_id, CASE event_type WHEN 'purchase' THEN 'available' WHEN 'error' THEN 'error' ELSE 'none' END AS outcome FROM events),
    f AS (SELECT watch, min(ts) FILTER (outcome <> 'none') AS stop FROM e GROUP BY watch)
    SELECT e.watch, coalesce(max(CASE WHEN ts = stop AND outcome = 'available' THEN 'found' WHEN ts = stop AND outcome = 'error' THEN 'error' END), 'active') AS status, count(*) AS check_count
    FROM e JOIN f USING (watch) WHERE stop IS NULL OR ts <= stop GROUP BY e.watch""")
def watch_fsm(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "purchase", "available").when(F.col("event_type") == "error", "error").otherwise("none")
    checks = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("watch"), F.col("ts").alias("at"), outcome.alias("outcome"), F.col("event_type").alias("message"))
    return ev.watch_states(checks).select("watch", "status", "check_count")


@query("""
    SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'approval' WHEN turn % 5 = 3 THEN 'command:draft' WHEN length(trim(text)) > 80 THEN 'document' WHEN conv_id % 2 = 0 THEN 'onboarding_answer' ELSE 'unsupported' END AS route
    FROM conversations""")
def updates_delivered_again(spark, sf_dir):
    """A stream in which every update comes twice and every third one three times, routed once each."""
    conv = tables.table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 100_000 + F.col("turn")
    say = lambda c: F.to_json(F.struct(key.alias("update_id"), F.struct(F.concat_ws("/", "conv_id", "turn").alias("chat_id"), c.alias("text")).alias("message")))
    call = F.to_json(F.struct(key.alias("update_id"), F.struct(F.concat(F.lit("approve:"), F.col("conv_id").cast("string")).alias("data"), F.concat_ws("/", "conv_id", "turn").alias("chat_id")).alias("callback_query")))
    raw = F.when(F.col("turn") % 5 == 4, call).when(F.col("turn") % 5 == 3, say(F.lit("/Entwurf@bot now"))).otherwise(say(F.col("text")))
    updates = conv.select(key.alias("update_id"), raw.alias("value"), F.timestamp_seconds(key % 86_400 + 86_400).alias("at"))
    stream = scratch.streamed([updates, updates.union(updates.where("update_id % 3 = 0")).repartition(4, "at")], files=2)
    rows = ev.incoming(scratch.run_through(ev.unrepeated(stream, at="at", late="2 days").select("value")))
    conv_id = F.split("user", "/")[0].cast("long")
    return rows.select(conv_id.alias("conv_id"), F.split("user", "/")[1].cast("long").alias("turn"), ev.route(F.col("kind"), F.col("text"), conv_id % 2 == 0).alias("route"))


def _batches(rows: DataFrame, key: str, n: int = 3) -> list[DataFrame]:
    """The rows in n batches that have nothing to do with their times."""
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


@query("""
    WITH e AS (SELECT user_id AS watch, ts, event_type, CASE event_type WHEN 'purchase' THEN 'available' WHEN 'error' THEN 'error' ELSE 'none' END AS outcome FROM events),
    b AS (SELECT *, coalesce(sum(CASE WHEN outcome <> 'none' THEN 1 ELSE 0 END) OVER (PARTITION BY watch ORDER BY ts, outcome, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e)
    SELECT CAST(watch AS VARCHAR) AS watch, coalesce(max(CASE outcome WHEN 'available' THEN 'found' WHEN 'error' THEN 'error' END), 'active') AS status, count(*) AS check_count,
        max(ts) AS last_checked_at, max(ts) FILTER (outcome = 'available') AS found_at, max(event_type) FILTER (outcome = 'error') AS error_message
    FROM b WHERE ended = 0 GROUP BY watch""")
def watch_stream(spark, sf_dir):
    """Checks that come as a stream, in batches that have nothing to do with their times, the last state of each watch."""
    outcome = F.when(F.col("event_type") == "purchase", "available").when(F.col("event_type") == "error", "error").otherwise("none")
    checks = tables.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("watch"), F.col("ts").cast("timestamp").alias("at"), outcome.alias("outcome"), F.col("event_type").alias("message"), "event_id")
    clock = checks.agg(F.lit(None).cast("string").alias("watch"), (F.max("at") + F.expr("INTERVAL 500 DAYS")).alias("at"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("message"))
    out = scratch.run_through(timed.watch_stream(scratch.streamed([*(b.drop("event_id") for b in _batches(checks, "event_id")), clock]), late="400 days"))
    last = out.where("watch IS NOT NULL").groupBy("watch").agg(F.max_by(F.struct("status", "check_count", "last_checked_at", "found_at", "error_message"), "check_count").alias("x")).select("watch", "x.*")
    return last.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_checked_at", "found_at")})


@query(f"""
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CAST(any_value(l_suppkey) AS VARCHAR) AS user_id, CAST(min(l_shipdate) AS TIMESTAMP) AS due_date FROM lineitem
    WHERE l_linestatus = 'O' GROUP BY 1 HAVING min(l_shipdate) <= TIMESTAMP '{NOW}' AND NOT bool_or(l_returnflag = 'N' AND l_linenumber = 5)""")
def reminder_timers(spark, sf_dir):
    """Reminders come as a stream, all of them twice and some cancelled between, then the clock moves: each that is due then fires once."""
    line = tables.table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rows = line.groupBy("id").agg(F.any_value(F.col("l_suppkey").cast("string")).alias("user_id"), F.min(F.col("l_shipdate").cast("timestamp")).alias("due_date"), F.bool_or(F.expr("l_returnflag = 'N' AND l_linenumber = 5")).alias("off"))
    none = lambda kind: F.lit(None).cast(kind)
    said = lambda df, status, at: df.select("id", "user_id", "due_date", F.lit(status).alias("status"), at.cast("timestamp").alias("at"))
    asked = said(rows, "scheduled", F.lit("1990-01-01"))
    off = said(rows.where("off").withColumns({"user_id": none("string"), "due_date": none("timestamp")}), "cancelled", F.lit("1990-01-02"))
    tick = said(spark.range(1).select(none("string").alias("id"), none("string").alias("user_id"), none("timestamp").alias("due_date")), "tick", now())
    fired = scratch.run_through(timed.reminder_stream(scratch.streamed([asked, off.unionByName(asked), tick, asked], files=1000)))
    return fired.select("id", "user_id", F.col("due_date").cast("timestamp_ntz").alias("due_date"))


def _move(state: str) -> str:
    return f"""CASE WHEN command = 'present' AND {state} = 'draft' THEN 'pending_approval' WHEN command = 'approve' AND {state} IN ('draft', 'pending_approval', 'approved') THEN 'approved'
            WHEN command = 'reject' AND {state} IN ('draft', 'pending_approval', 'rejected') THEN 'rejected' WHEN command = 'send' AND {state} = 'approved' THEN 'sent' END"""


@query(f"""
    WITH RECURSIVE c AS (
        SELECT l_orderkey AS draft, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,
            CASE WHEN l_returnflag = 'A' THEN 'approve' WHEN l_returnflag = 'R' THEN 'reject' WHEN l_linestatus = 'F' THEN 'send' ELSE 'present' END AS command FROM lineitem),
    s AS (
        SELECT draft, seq, command, 'draft' AS before, {_move("'draft'")} AS moved, coalesce({_move("'draft'")}, 'draft') AS after FROM c WHERE seq = 1
        UNION ALL
        SELECT c.draft, c.seq, c.command, s.after, {_move("s.after").replace("command =", "c.command =")}, coalesce({_move("s.after").replace("command =", "c.command =")}, s.after) FROM s JOIN c ON c.draft = s.draft AND c.seq = s.seq + 1)
    SELECT draft, seq, command, before, after, CASE WHEN moved IS NULL THEN command || ' from ' || before END AS error FROM s""")
def draft_fsm(spark, sf_dir):
    cmd = F.when(F.col("l_returnflag") == "A", "approve").when(F.col("l_returnflag") == "R", "reject").when(F.col("l_linestatus") == "F", "send").otherwise("present")
    seq = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("long")
    return ev.draft_states(tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft"), seq.alias("seq"), cmd.alias("command")))


@query("""
    WITH RECURSIVE a AS (
        SELECT CAST(user_id AS VARCHAR) AS u, event_id AS seq, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'ab' ELSE event_type END AS said,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    s AS (
        SELECT u, seq, k, 'name' AS asked, CASE WHEN said = '' OR length(said) >= 3 THEN 'address' ELSE 'name' END AS step, said = '' OR length(said) >= 3 AS accepted,
            CASE WHEN length(said) >= 3 THEN said END AS name, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS city FROM a WHERE k = 1
        UNION ALL
        SELECT a.u, a.seq, a.k, s.step, CASE WHEN NOT (said = '' OR length(said) >= 3) THEN s.step WHEN s.step = 'name' THEN 'address' WHEN s.step = 'address' THEN 'city' ELSE 'done' END,
            said = '' OR length(said) >= 3, CASE WHEN length(said) >= 3 AND s.step = 'name' THEN said ELSE s.name END,
            CASE WHEN length(said) >= 3 AND s.step = 'address' THEN said ELSE s.address END, CASE WHEN length(said) >= 3 AND s.step = 'city' THEN said ELSE s.city END
        FROM s JOIN a ON a.u = s.u AND a.k = s.k + 1 WHERE s.step <> 'done')
    SELECT u AS "user", seq, asked, step, accepted, name, address, city FROM s""")
def onboarding_fsm(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "ab").otherwise(F.col("event_type")).alias("answer"))
    return ev.onboarding_batch(rows)


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS last_analysis FROM orders GROUP BY o_custkey")
def last_analysis_per_user(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_analysis"))


@query("SELECT doc_id, length(replace(text, chr(10), '')) AS characters, CASE WHEN length(text) <= 4096 THEN 1 ELSE 0 END AS parts_if_short FROM documents")
def split_messages(spark, sf_dir):
    rows = sinks.message_chunks(tables.table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.length(F.replace("chunk", F.lit("\n"), F.lit("")))
    return rows.groupBy("doc_id").agg(F.sum(size).cast("long").alias("characters"), F.when(F.max(F.length("text")) <= 4096, F.count(F.lit(1)).cast("int")).otherwise(0).alias("parts_if_short"))


@query("""SELECT p_partkey, ['image/jpeg', 'image/png', 'image/gif', 'image/webp', 'application/pdf', 'image/heic', NULL, NULL][p_partkey % 8 + 1] AS mime FROM part""")
def mime_sniff(spark, sf_dir):
    heads = ("FFD8FFE000104A4649460001", "89504E470D0A1A0A0000000D", "474946383961010001000000", "524946460000000057454250", "255044462D312E370A250000", "00000018667479706D696631", "000102030405060708090A0B", "FFD8FF")
    return tables.table(spark, sf_dir, "part").select("p_partkey", binary.mime_of(F.unhex(ltr.pick(heads, F.col("p_partkey")))).alias("mime"))


@query(r"""
    WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1)) AS x FROM pages),
    t AS (SELECT page_id, trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS item FROM i)
    SELECT page_id, item, count(*) AS n FROM t WHERE item <> '' GROUP BY page_id, item""")
def page_items(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "pages").select("page_id", F.explode(page.page_items(F.col("html"))).alias("item"))
    return rows.groupBy("page_id", "item").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'tr' WHEN 1 THEN 'de' ELSE 'en' END AS locale, CASE n_nationkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' END AS action, CASE WHEN n_nationkey % 3 < 2 THEN 'd:' || n_nationkey END AS draft_id,
    ['leak', 'ocr', 'format', 'other'][n_nationkey % 4 + 1] AS failure FROM nation""")
def text_classifiers(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "nation")
    n = F.col("n_nationkey")
    code = ltr.pick((" TR-tr", "de_AT", "fr", "English", "x"), n)
    call = F.concat(ltr.pick(("approve:", "reject:", "unknown:"), n), F.lit("d:"), n.cast("string"))
    failure = ltr.pick(("PII leak found", "OCR unavailable", "bad JSON", "timeout"), n)
    return rows.select("n_nationkey", text.locale_of(code).alias("locale"), text.approval(call)["action"].alias("action"), text.approval(call)["draft_id"].alias("draft_id"), text.error_class(failure).alias("failure"))


# ---- evaluations


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("lang", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 0).alias("clean"), (F.col("n_chars") % 4).cast("int").alias("expected"), F.least(F.col("n_chars") % 4, F.col("doc_id") % 3).cast("int").alias("overlap"))


@query("""
    WITH r AS (SELECT quality = 1 AS q, toxic = 0 AS c FROM documents JOIN labels USING (doc_id))
    SELECT 'quality' AS field, count(*) FILTER (q) AS correct, count(*) AS total, round(100.0 * count(*) FILTER (q) / count(*), 0) AS pct FROM r UNION ALL
    SELECT 'clean', count(*) FILTER (c), count(*), round(100.0 * count(*) FILTER (c) / count(*), 0) FROM r""")
def eval_accuracy(spark, sf_dir):
    return evals.accuracy(_results(spark, sf_dir), "quality", "clean")


@query("SELECT round(avg(CASE WHEN n_chars % 4 > 0 THEN least(n_chars % 4, doc_id % 3) / (n_chars % 4) ELSE 1.0 END), 9) AS recall FROM documents JOIN labels USING (doc_id)")
def eval_recall(spark, sf_dir):
    return evals.mean_recall(_results(spark, sf_dir), "expected", "overlap").select(F.round("recall", 9).alias("recall"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS quality_ok, count(*) FILTER (toxic = 0) AS clean_ok FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang))")
def eval_rollup(spark, sf_dir):
    return evals.by_subset(_results(spark, sf_dir), "lang", "quality", "clean")


@query(f"WITH {LETTERS}, n AS (SELECT count(*) AS n FROM letters) SELECT unnest(['NAME', 'ADDRESS', 'AKTENZEICHEN', 'DATE', 'EMAIL']) AS type, unnest([1, 2, 1, 1, 1]) * n AS n_clean, unnest([1, 2, 1, 1, 0]) * n AS n_damaged, unnest([0, 0, 0, 0, 1]) * n AS lost FROM n")
def token_parity(spark, sf_dir):
    """Tokens of clean letters against those of letters whose mail signs were misread and whose ß became B."""
    clean = ltr.letters(spark, sf_dir)
    damaged = clean.withColumn("text", F.translate("text", "@ß", "©B"))
    return evals.token_parity(masking.token_census(masking.masked(clean)), masking.token_census(masking.masked(damaged)))


@query("""
    WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role)
    SELECT conv_id, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY first, role) AS n FROM f""")
def dense_token_numbers(spark, sf_dir):
    first = tables.table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.select("conv_id", "role", F.dense_rank().over(W.partitionBy("conv_id").orderBy("first", "role")).cast("long").alias("n"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS overlap FROM orders""")
def listed_overlap(spark, sf_dir):
    want = F.array(F.lit("Reisepass Kopie"), F.lit("Mietvertrag"))
    got = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("kopie vom Reisepass"), F.lit("MIETVERTRAG (Original)"))).otherwise(F.array(F.lit("Mietvert")))
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", want.alias("w"), got.alias("g")).select("o_orderkey", joins.listed_overlap("w", "g").alias("overlap"))


@query("""
    SELECT a.p_partkey, count(*) AS n_near FROM part a JOIN part b ON contains(lower(b.p_name), substr(lower(a.p_name), 1, 8)) OR contains(lower(a.p_name), substr(lower(b.p_name), 1, 8)) GROUP BY a.p_partkey""")
def overlapping_parts(spark, sf_dir):
    """For each part how many parts' names hold the beginning of its own, or the other way round; SQL compares all pairs."""
    parts = tables.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return secrets.overlap_counts(parts, parts, "p_partkey", "p_name")


@query("""
    SELECT 'documents' AS table_name, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS owner, 'kunde' || o_custkey || '@mail.example' AS value FROM orders WHERE o_orderkey % 97 = 0 UNION ALL
    SELECT 'analyses', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), 'Torstraße "' || o_custkey || '"' FROM orders WHERE o_orderkey % 89 = 0 UNION ALL
    SELECT 'reminders', l_orderkey || '-' || l_linenumber || '-' || l_partkey, CAST(o_custkey AS VARCHAR), 'kunde' || o_custkey || '@mail.example' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 101 = 0 UNION ALL
    SELECT 'audit_log', CAST(event_id AS VARCHAR), CAST(c_custkey AS VARCHAR), 'Torstraße "' || c_custkey || '"' FROM events JOIN customer ON user_id = c_custkey WHERE event_id % 53 = 0""")
def secrets_in_stored_rows(spark, sf_dir):
    """Two secrets of every customer, looked for in all rows of four tables, some of which hold one."""
    mail = lambda c: F.concat(F.lit("kunde"), c.cast("string"), F.lit("@mail.example"))
    street = lambda c: F.concat(F.lit('Torstraße "'), c.cast("string"), F.lit('"'))
    customer = tables.table(spark, sf_dir, "customer").select("c_custkey")
    known = customer.select(F.col("c_custkey").cast("string").alias("owner"), F.explode(F.array(mail(F.col("c_custkey")), street(F.col("c_custkey")), F.lit("Ort"))).alias("value"))
    order = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", "o_orderdate")
    item = tables.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), "l_orderkey", "l_partkey", "l_shipdate")
    item = item.join(order.select(F.col("id").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    event = tables.table(spark, sf_dir, "events").join(customer, F.col("user_id") == F.col("c_custkey"), "left")
    said = lambda when, what: F.when(when, F.concat(F.lit("Brief an "), what, F.lit(", erledigt"))).otherwise(F.lit("Brief an [[EMAIL_1]]"))
    stored = {
        "documents": order.withColumn("masked_text", said(F.col("id") % 97 == 0, mail(F.col("o_custkey")))), "analyses": order.withColumn("steps", F.array(F.lit("a"), said(F.col("id") % 89 == 0, street(F.col("o_custkey"))))),
        "reminders": item.withColumn("message", said(F.col("l_partkey") % 101 == 0, mail(F.col("o_custkey")))),
        "audit_log": event.select(F.col("event_id").alias("id"), F.create_map(F.lit("detail"), said((F.col("event_id") % 53 == 0) & F.col("c_custkey").isNotNull(), street(F.col("user_id")))).alias("detail")),
    }
    return secrets.stored_secrets(stored, known)


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_hour(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.windowed_counts(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))
