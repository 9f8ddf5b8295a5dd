"""Secrets that stored rows still hold, and entries of two lists that overlap: containment as joins by pieces of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each of its entries, and its most bits: 32 MB, however many secrets there are.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Bytes of rows that are held against the filter at a time, or as many as the longest secret has.
STRETCH = 1 << 18
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)
#: A number for each byte.
_BYTES = np.frombuffer(hashlib.shake_256(b"bytes").digest(256 * 8), np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def _mixed(raw: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Numbers of pieces from their sums; they tell the length too, which is negative for heads."""
    with np.errstate(over="ignore"):
        x = raw + np.asarray(length).astype(np.uint64) * _MIX
        return (x ^ (x >> np.uint64(32))) * _MIX


def _places(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each number."""
    return tuple(((code >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (3, 35))


def _passed(code: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where numbers have both of their bits in the filter."""
    last = np.uint64((len(marks) << 6) - 1)

    def bit(code: np.ndarray, shift: int) -> np.ndarray:
        place = (code >> np.uint64(shift)) & last
        return np.flatnonzero((marks[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))

    at = bit(code, 3)
    return at[bit(code[at], 35)]


def _head(length: int) -> int:
    """How many first bytes of a secret of so many bytes are looked up alone: the largest power of two in it."""
    return 1 << (length.bit_length() - 1)


def _numbers(values: pa.Array) -> pa.Array:
    """Of each value its number (code), that of its head, and its length in bytes."""
    texts = values.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(texts) else np.empty(0, np.uint8)
    first, length = (ends[:-1] - ends[0], np.diff(ends)) if len(texts) else (np.empty(0, np.int64), np.empty(0, np.int64))
    head = np.array([_head(n) for n in length.tolist()], np.int64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers(_STEP, len(data)))])
        raw = [(sums[first + n] - sums[first]) * _powers(_BACK, len(data) + 1)[first] for n in (length, head)]
        whole = [_mixed(r, n.astype(np.uint64)) for r, n in zip(raw, (length, -head), strict=True)]
    return pa.StructArray.from_arrays([*(pa.array(x.view(np.int64)) for x in whole), pa.array(length.astype(np.int32))], ["code", "head", "length"])


def _filter(coded: DataFrame, bits: int) -> np.ndarray:
    """Bits of all numbers, put together by Spark: at most MOST_BITS reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_places(b.column("code").to_numpy(zero_copy_only=False).astype(np.uint64), bits)))
            words, first = np.unique(at >> 6, return_index=True)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(masks.view(np.int64))], ["word", "mask"])

    rows = coded.select("code").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(bits >> 6, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def stored_secrets(tables: Mapping[str, DataFrame], secrets: DataFrame, key: str = "id") -> DataFrame:
    """table_name, key, owner, value: secrets (owner, value) of more than three characters that stand somewhere in stored rows, written as JSON.

    The numbers of all secrets and of their heads, the longest beginnings whose length is a power of two, make a filter of fixed size. Each
    row is held against it in one pass, whatever the number of secrets: where a head may stand, whole secrets are tried, in all lengths that
    there are. Pieces that pass are joined with the secrets of the same number, so a beginning that many secrets share costs no more than
    another, and these are looked for in the row. Values that JSON escapes are looked for as it writes them. Null keys, owners and columns
    do no harm; a secret of several owners is found for each.
    """
    spark = secrets.sparkSession
    known = secrets.select("owner", F.col("value").cast("string").alias("value")).where(F.length("value") > 3).distinct()
    known = known.withColumn("escaped", F.expr("substring(to_json(named_struct('x', value)), 7, length(to_json(named_struct('x', value))) - 8)"))

    numbers = F.arrow_udf(_numbers, "struct<code:long,head:long,length:int>")
    known = known.withColumn("numbers", numbers("escaped")).select("owner", "value", "escaped", "numbers.*")
    lengths: dict[int, list[int]] = {}
    for r in known.select("length").distinct().collect():
        lengths.setdefault(_head(r.length), []).append(r.length)
    longest = max((n for many in lengths.values() for n in many), default=1)
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (2 * BITS_EACH * known.count()).bit_length()))
    shared = spark.sparkContext.broadcast(_filter(known.select(F.explode(F.array("code", "head")).alias("code")).distinct(), bits))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, stretch = shared.value, max(STRETCH, longest)
        powers, back = (_powers(base, stretch + longest) for base in (_STEP, _BACK))
        for b in batches:
            texts = b.column("row").cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at, codes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for lo in range(int(ends[0]), int(ends[-1]), stretch):  # all texts of a batch side by side, a stretch at a time
                own = _BYTES[data[lo : min(lo + stretch + longest - 1, int(ends[-1]))]]
                own *= powers[: len(own)]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])
                for head, many in lengths.items():
                    n = min(len(own) - head + 1, stretch)
                    if n <= 0:
                        continue
                    likely = _passed(_mixed((sums[head : head + n] - sums[:n]) * back[:n], -head), marks)
                    row = np.searchsorted(ends, lo + likely, "right") - 1
                    for length in many:
                        whole = np.flatnonzero(lo + likely + length <= ends[row + 1])  # not from one text into the next
                        first = likely[whole]
                        code = _mixed((sums[first + length] - sums[first]) * back[first], length)
                        hit = _passed(code, marks)
                        at.append(row[whole[hit]])
                        codes.append(code[hit])
            pairs = np.unique(np.stack([np.concatenate(at), np.concatenate(codes).view(np.int64)]), axis=1)
            taken = b.take(pa.array(pairs[0]))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(pairs[1])], [*b.schema.names, "code"])

    rows = None
    for name, table in tables.items():
        one = table.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])).alias("row"))
        rows = one if rows is None else rows.unionAll(one)
    likely = rows.mapInArrow(hits, "table_name string, key string, row string, code long")
    return likely.join(known.select("owner", "value", "escaped", "code"), "code").where(F.contains("row", "escaped")).select("table_name", "key", "owner", "value")


def overlap_counts(wanted: DataFrame, got: DataFrame, key: str, text: str, width: int = 8) -> DataFrame:
    """key, n_near: for each entry wanted, how many entries got hold its first `width` characters, or it theirs, letter case aside.

    An entry shorter than that counts with all of it; null and empty ones are near none. No pair is made: entries are counted by their
    beginnings and by the pieces they hold, and for those near in both ways by both together, so a beginning that many share stays a row.
    """
    head, low = F.substring("low", 1, width), F.lower(F.col(text).cast("string"))
    want = wanted.select(F.col(key).alias("key"), low.alias("low")).withColumn("head", head)
    have = got.select(low.alias("low")).where("low <> ''").groupBy("low").agg(F.count(F.lit(1)).alias("n")).withColumn("head", head)

    def pieces(df: DataFrame, lengths: list[int]) -> DataFrame:
        """df with each distinct piece of those lengths: no more than `width` of them."""
        of = lambda n: lambda i: F.substr("low", i, F.lit(n))
        cut = [F.when(F.length("low") >= n, F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), of(n))).otherwise(F.array().cast("array<string>")) for n in lengths]
        return df.withColumn("piece", F.explode(F.array_distinct(F.concat(*cut)))) if cut else df.withColumn("piece", F.lit(None).cast("string")).limit(0)

    lengths = lambda df: sorted(r.n for r in df.where("low <> ''").select(F.length("head").alias("n")).distinct().collect())
    texts = want.where("low <> ''").select("low", "head").distinct()
    held = pieces(have, lengths(want))
    by_piece = held.groupBy(F.col("piece").alias("head")).agg(F.sum("n").alias("holding"))
    by_both = held.groupBy(F.col("head").alias("piece"), F.col("piece").alias("head")).agg(F.sum("n").alias("twice"))
    by_head = have.groupBy(F.col("head").alias("piece")).agg(F.sum("n").alias("held"))
    mine = pieces(texts, lengths(have)).join(by_head, "piece").join(by_both, ["piece", "head"], "left")
    mine = mine.groupBy("low").agg(F.sum(F.col("held") - F.coalesce("twice", F.lit(0))).alias("held"))
    near = texts.join(by_piece, "head", "left").join(mine, "low", "left").select("low", (F.coalesce("holding", F.lit(0)) + F.coalesce("held", F.lit(0))).alias("n_near"))
    return want.join(near, "low", "left").select(F.col("key").alias(key), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
