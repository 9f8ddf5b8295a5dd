"""Finding personal data, replacing it by numbered tokens, and proving that nothing was left.

Texts are searched once, in Arrow batches with patterns compiled once for each worker; all else is Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import finding
from ..functions.patterns import PARTICLES, RECOGNISERS

TOKEN = r"\[\[([A-Z]+)_([0-9]+)\]\]"
SPAN = "struct<start:int,end:int,original:string,type:string,strategy:string,ord:int>"
NO_SPANS = f"array<{SPAN}>"
MATCHES = "array<struct<token:string,original:string,type:string,strategy:string>>"
#: Profile fields with the type that their values get, in the order they are looked for.
PROFILE_FIELDS = {
    "full_name": "NAME", "given_name": "NAME", "family_name": "NAME", "date_of_birth": "DOB", "address": "ADDRESS", "city": "ADDRESS", "postal_code": "POSTALCODE",
    "email": "EMAIL", "phone": "PHONE", "auslaendernummer": "AUSLNR", "steuer_id": "STEUERID", "passport_number": "PASSPORT", "insurance_number": "INSURANCE",
}


def _checked(check: Callable[[str], bool]) -> Callable[[Column], Column]:
    """What the recognisers check of a value, for a column of values; null for null."""

    def column(value: Column) -> Column:
        @F.arrow_udf(T.BooleanType())
        def run(values: pa.Array) -> pa.Array:
            return pa.array([None if v is None else check(v) for v in values.to_pylist()], pa.bool_())

        return run(value)

    return column


plausible_name, plausible_tax_id, phone_length = map(_checked, (finding.plausible_name, finding.plausible_tax_id, finding.phone_length))
iban_valid, iban_readable = map(_checked, (finding.valid_iban, finding.readable_iban))


def neutralised(text: Column) -> Column:
    """Token-like text of the input loses its brackets, so it can never stand for a value."""
    return F.regexp_replace(text, TOKEN, "⟦⟧$1_$2⟦⟧")


def has_tokens(text: Column) -> Column:
    return text.rlike(TOKEN)


def _chosen(types: Sequence[str] | None) -> list[tuple]:
    """The recognisers there are now, of those types if given, as the helpers take them."""
    check = {None: None} | {f.__name__: f for f in (finding.plausible_name, finding.plausible_tax_id, finding.readable_iban, finding.phone_length)}
    return [(i, r.kind, r.pattern, r.group, check[r.check], r.hints, r.signs, (r.starts, r.low_starts, r.digits, r.behind, r.core, r.lead, r.head, r.quick)) for i, r in enumerate(RECOGNISERS) if types is None or r.kind in types]


def pattern_spans(text: Column, types: Sequence[str] | None = None) -> Column:
    """All spans that the recognisers find, in their order; only those of `types`, if given. A null text has none."""
    chosen = _chosen(types)

    @F.arrow_udf(NO_SPANS)
    def found(texts: pa.Array) -> pa.Array:
        rows = [[s._asdict() for s in finding.pattern_spans(t, chosen)] if t else [] for t in texts.to_pylist()]
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("original", pa.string()), ("type", pa.string()), ("strategy", pa.string()), ("ord", pa.int32())])
        return pa.array(rows, pa.list_(kind))

    return found(text)


def name_parts(name: Column) -> Column:
    """Parts of a name of three characters or more, without particles."""
    parts = F.filter(F.split(name, r"[\s,]+"), lambda p: (F.length(p) >= 3) & ~F.lower(p).isin(list(PARTICLES)))
    return F.coalesce(parts, F.array().cast("array<string>"))


def known_values(profile: Column, fields: Sequence[str]) -> Column:
    """array<struct<value, type>> of a profile's values of two characters or more, longest first; a full name's parts and both reversed orders too."""
    entry = lambda v, kind: F.struct(F.trim(v).alias("value"), F.lit(kind).alias("type"))
    groups = []
    for f, kind in PROFILE_FIELDS.items():
        if f in fields:
            groups.append(F.array(entry(profile[f], kind)))
        if f == "family_name" and "full_name" in fields:
            groups.append(F.transform(name_parts(profile["full_name"]), lambda p: entry(p, "NAME")))
    if "extra" in fields:
        groups.append(F.coalesce(F.transform(profile["extra"], lambda e: F.struct(F.trim(e["value"]).alias("value"), e["type"].alias("type"))), F.array().cast("array<struct<value:string,type:string>>")))
    if "given_name" in fields and "family_name" in fields:
        swapped = lambda sep: entry(F.concat(F.nullif(profile["family_name"], F.lit("")), F.lit(sep), F.nullif(profile["given_name"], F.lit(""))), "NAME")
        groups.append(F.array(swapped(", "), swapped(" ")))
    usable = F.filter(F.concat(*groups), lambda e: F.length(F.trim(e["value"])) >= 2)
    ranked = F.transform(usable, lambda e, i: F.struct((-F.length(e["value"])).alias("k"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(ranked), lambda r: r["e"])


def _strings(array: pa.Array) -> list[str | None]:
    """What to_pylist gives for an array of strings, without an object of Arrow's for each."""
    return array.to_numpy(zero_copy_only=False).tolist()


def _lists(rows: Iterable[Sequence[tuple[str, ...]]], names: Sequence[str]) -> tuple[pa.Array, pa.Array]:
    """Lists of tuples of strings as an array of lists of structs, and their lengths."""
    rows = list(rows)
    sizes = np.fromiter(map(len, rows), np.int32, len(rows))
    flat = [x for row in rows for x in row]
    structs = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.string()) for k in range(len(names))], list(names))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), structs), pa.array(sizes)


def masked(df: DataFrame, text: str = "text", profile: str | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """df with masked_text, matches and n_masked.

    matches: array<struct<token, original, type, strategy>> in order of first appearance. Steps: token-like text is neutralised; known values of
    the profile and recognisers give candidates; overlaps are resolved; every value found once is looked for in the whole text, and overlaps are
    resolved again; equal values of a type share a numbered token. A null text is masked to an empty one.
    """
    columns = [c for c in df.columns if c not in ("masked_text", "matches", "n_masked")]
    known = F.array().cast("array<struct<value:string,type:string>>")
    if profile:
        known = known_values(F.col(profile), df.schema[profile].dataType.names)
        if only is not None:
            known = F.filter(known, lambda e: e["type"].isin(list(only)))
    chosen = _chosen(only)

    @F.arrow_udf(f"struct<masked_text:string,matches:{MATCHES},n_masked:int>")
    def run(texts: pa.Array, values: pa.Array) -> pa.Array:
        ends = values.offsets.to_numpy()
        kinds = list(zip(*(_strings(values.values.field(k)) for k in ("value", "type")), strict=True))
        rows = finding.masked_many(_strings(texts), chosen, [kinds[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        matches, sizes = _lists((tokens for _, tokens in rows), ("token", "original", "type", "strategy"))
        return pa.StructArray.from_arrays([pa.array([new for new, _ in rows], pa.string()), matches, sizes], ["masked_text", "matches", "n_masked"])

    # not deterministic for Spark, which then neither repeats it nor pulls a filter on what it makes below an exchange, and so masks a text once
    made = df.select(*[F.col(f"`{c}`") for c in columns], run.asNondeterministic()(F.coalesce(neutralised(F.col(text)), F.lit("")), known).alias("__made"))
    return made.select(*[F.col(f"`{c}`") for c in columns], "__made.masked_text", "__made.matches", "__made.n_masked")


PLACES = T.ArrayType(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))


@F.arrow_udf(PLACES)
def value_places(texts: pa.Array, values: pa.Array) -> pa.Array:
    """For each value of an array, the places (start, end) of a text at which it stands, however it may have been misread. Null without text or values; a null value stands nowhere."""
    out = []
    for text, many in zip(texts.to_pylist(), values.to_pylist(), strict=True):
        found = None if text is None or many is None else finding.places(text, tuple(v or "" for v in many))
        out.append(found and [[{"start": a, "end": b} for a, b in places] for places in found])
    return pa.array(out, pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))


#: Values that one automaton looks for; of more, several are made and the texts are read once for each.
MOST_VALUES = 50_000


def known_places(df: DataFrame, values: DataFrame, key: str, text: str = "text", most: int = MOST_VALUES) -> DataFrame:
    """key, value, start, end: where the values (a column `value`) stand in the texts, however they may have been misread.

    Each of the distinct values is looked for, whatever their number: at most `most` at a time reach the driver and go to the tasks, where one
    automaton finds them in one run over each text. Null texts hold nothing; null and empty values stand nowhere; without values there are no rows.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    distinct = values.select(F.col("value").cast("string").alias("value")).where("value <> ''").distinct()
    parts = max(1, -(-distinct.count() // (most // 2)))  # half as many as may be, so that no part by hash comes near the most
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text <> ''")

    def looked_for(part: int) -> DataFrame:
        own = tuple(sorted(r.value for r in distinct.where(F.pmod(F.xxhash64("value"), F.lit(parts)) == part).collect()))
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            machine = finding.automaton(shared.value)
            for b in batches:
                hits = [(row, i, a, e) for row, text in enumerate(b.column("text").to_pylist()) for i, places in machine.found(text).items() for a, e in places]
                at, found, starts, ends = zip(*hits, strict=True) if hits else ((), (), (), ())
                columns = [b.column("key").take(pa.array(at, pa.int64())), pa.array([shared.value[i] for i in found], pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "value", "start", "end"])

        return rows.mapInArrow(run, f"key {kind}, value string, start int, end int")

    out = looked_for(0)
    for part in range(1, parts):
        out = out.union(looked_for(part))
    return out.withColumnRenamed("key", key)


def unmasked(text: Column, matches: Column) -> Column:
    """Tokens back to originals; a token that has none stays. Tokens end in brackets and originals hold none, so order does not matter."""
    return F.aggregate(matches, F.coalesce(text, F.lit("")), lambda acc, m: F.replace(acc, m["token"], m["original"]))


def unmasked_deep(value: Column, kind: object, matches: Column) -> Column:
    """unmasked for every string in a nested value; map keys and other types stay. kind: the value's DataType."""
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), unmasked(value, matches))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: unmasked_deep(x, kind.elementType, matches))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: unmasked_deep(v, kind.valueType, matches))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[unmasked_deep(value[f.name], f.dataType, matches).alias(f.name) for f in kind.fields]))
    return value


@F.arrow_udf(T.ArrayType(T.StringType()))
def _left(texts: pa.Array, matches: pa.Array) -> pa.Array:
    ends, there = matches.offsets.to_pylist(), matches.is_valid().to_pylist()
    originals, kinds = (_strings(matches.values.field(k)) for k in ("original", "type"))
    folds = {x: finding.folded(x or "") for x in set(originals)}  # values come again in other rows
    values, out = [folds[x] for x in originals], []
    for text, given, a, b in zip(_strings(texts), there, ends[:-1], ends[1:], strict=True):
        hay = finding.folded(text or "")
        out.append(list(dict.fromkeys(kind for kind, value in zip(kinds[a:b], values[a:b], strict=True) if len(value) > 3 and value in hay)) if given else None)
    return pa.array(out, pa.list_(pa.string()))


def leaks(text: Column, matches: Column) -> Column:
    """The distinct types of originals of more than three characters that the text still holds; compatibility forms, letter case and spacing aside."""
    return _left(text, F.transform(matches, lambda m: F.struct(m["original"].alias("original"), m["type"].alias("type"))))


def gated(df: DataFrame, text: str = "masked_text", matches: str = "matches") -> tuple[DataFrame, DataFrame]:
    """(rows that may go on, rows with leaks and their types), see gate. Each of the two goes over df; who needs both at once takes gate."""
    checked = gate(df, text, matches)
    return checked.where("passes").drop("leaks", "passes"), checked.where("NOT passes").drop("passes")


def gate(df: DataFrame, text: str = "masked_text", matches: str = "matches") -> DataFrame:
    """df with leaks and passes. Nothing that leaks ever passes, whoever reads it; nor does a row without matches to check, whose leaks are null."""
    return df.withColumn("leaks", leaks(F.col(text), F.col(matches))).withColumn("passes", F.coalesce(F.size("leaks") == 0, F.lit(False)))


def token_census(df: DataFrame, text: str = "masked_text") -> DataFrame:
    """type, n: how many tokens of each type stand in the texts."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(1))).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def density(text: Column) -> Column:
    """Tokens over white-space words."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.regexp_count(text, F.lit(TOKEN)) / F.greatest(F.size(words), F.lit(1))


def dense_enough(text: Column) -> Column:
    """Whether density stays within its limit: 15 % from 150 words on, 32 % below."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return density(text) <= F.when(words >= 150, 0.15).otherwise(0.32)


def stored_leaks(row: Column, secrets: Column) -> Column:
    """Which secrets of more than three characters stand in a stored row, written as JSON."""
    return F.filter(secrets, lambda s: (F.length(s) > 3) & F.contains(F.to_json(row), s))
