"""Quality rules kept as a ledger of failure bits and measurements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_APART = np.zeros(256, bool)
_APART[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(text: pa.Scalar | str | None) -> tuple[int, ...]:
    """MEASURES of one whole text; a null text has no words and no lines."""
    data = wordhash.raw(text)
    code, _, _ = wordhash.words(data)
    chars = symbols = 0
    for lo in range(0, len(data), wordhash.BLOCK):
        part = data[lo : lo + wordhash.BLOCK]
        chars += int(np.count_nonzero(((part & 0xC0) != 0x80) & ~_APART[part]))
        symbols += int(np.count_nonzero(_SYMBOL[part]))
    lines = [x for x in data.tobytes().split(b"\n") if x.strip()]
    return len(code), chars, symbols, len(lines) - len(set(lines)), _in_repeated(code), len(lines)


def _in_repeated(code: np.ndarray, width: int = 5) -> int:
    """Words in windows of `width` words that are found more than once. Windows whose hashes meet count only if their words are equal too."""
    w = wordhash.windows(code, width)
    if not len(w):
        return 0
    order = np.argsort(w, kind="stable")
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(w[a] == w[b])
    for k in range(width):
        same = same[code[a[same] + k] == code[b[same] + k]]
    if not len(same):
        return 0
    cover = np.zeros(len(code) + 1, np.int64)
    at = np.unique(np.concatenate([a[same], b[same]]))
    cover[at] += 1
    cover[at + width] -= 1
    return int((np.cumsum(cover) > 0).sum())


#: Each rule has the bit of its place; places never change, new rules are added at the end.
RULE_SQL = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
    "short_words": "n_words > 0 AND word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}


def mask_of(names: tuple[str, ...]) -> int:
    places = list(RULE_SQL)
    return sum(1 << places.index(n) for n in names)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failures`, a bit for each rule that the document fails. Every text is read once and whole.

    A null text measures zero throughout, an empty one likewise; repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t) for t in b.column("text")]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for place, sql in enumerate(RULE_SQL.values()):
        bits = bits + F.when(F.expr(sql), F.lit(1 << place).cast("long")).otherwise(F.lit(0).cast("long"))
    return measured.withColumn("failures", bits)


def judged(rows: DataFrame, version: int = 2) -> DataFrame:
    """The ledger with base_failed (policy 1 rejects), kept (neither it nor the given policy rejects) and sole_rule.

    sole_rule is the policy's only rule that the document fails, without which it would pass; null if it passes or fails several.
    Works on a stored ledger of any number of rows, repeated ones too; nothing is read or measured again.
    """
    failed = lambda v: F.col("failures").bitwiseAND(F.lit(mask_of(POLICIES[v]))) != 0
    bits = F.col("failures").bitwiseAND(F.lit(mask_of(POLICIES[version])))
    sole = F.lit(None).cast("string")
    for name in POLICIES[version]:
        sole = F.when(bits == mask_of((name,)), F.lit(name)).otherwise(sole)
    return rows.withColumns({"base_failed": failed(1), "kept": ~failed(1) & ~failed(version), "sole_rule": sole})


def ablations(rows: DataFrame, version: int = 2) -> DataFrame:
    """For each rule of a policy: rule, failed (documents), only (documents that no other rule of it rejects), kept_without.

    Documents are first counted by their failure bits, so what follows works on at most 2 ** rules rows. An empty ledger gives no rows.
    """
    mask = mask_of(POLICIES[version])
    counts = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask_of((n,))).cast("long").alias("bit")) for n in POLICIES[version]])).alias("r")
    each = counts.select("bits", "n", names).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
