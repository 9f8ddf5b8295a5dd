"""Fill-in-the-middle: documents cut at two units and written with sentinels, so that a model learns to write what is missing.

Units are counted by one run of a lazy matcher over a text's bytes; a second run stops at the two units where the text is cut. What is
kept of a text besides its bytes is a count and two places, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash

#: A unit is a run of ASCII letters or any other character; here over UTF-8, where all bytes of a character but the first are 80 to BF.
UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xBF][\x80-\xBF]*")
#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def count_units(data: np.ndarray) -> int:
    """First pass: the number of units."""
    return sum(1 for _ in UNIT.finditer(data.data))


def ends(data: np.ndarray, ranks: tuple[int, ...]) -> Iterator[int]:
    """Second pass: where the first r units end, for each r of ascending ranks; the matcher goes no further than the last."""
    units, done, at = UNIT.finditer(data.data), 0, 0
    for r in ranks:
        if r > done:
            at, done = next(islice(units, r - done - 1, None)).end(), r
        yield at


def _chars(data: np.ndarray) -> int:
    return sum(int(np.count_nonzero((data[k : k + wordhash.BLOCK] & 0xC0) != 0x80)) for k in range(0, len(data), wordhash.BLOCK))


def cut(data: np.ndarray, first: int | None, second: int | None) -> tuple[int, int | None, int | None]:
    """Number of units n, and the characters of prefix and middle: the text is cut after the smaller and the larger of first % (n + 1) and second % (n + 1) units."""
    n = count_units(data)
    if first is None or second is None:
        return n, None, None
    a, b = ends(data, tuple(sorted((first % (n + 1), second % (n + 1)))))
    return n, _chars(data[:a]), _chars(data[a:b])


_CUTS = ("n", "prefix_chars", "middle_chars")


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in _CUTS]))
def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    rows = [cut(wordhash.raw(t), a, b) for t, a, b in zip(texts, first.to_pylist(), second.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_CUTS))], list(_CUTS))


def fill_in_middle(docs: DataFrame, seed: str = "1", transformed: int = 90, suffix_first: int = 20) -> DataFrame:
    """Documents with their middle moved to the end.

    The hash of seed, colon and doc_id decides: two of its numbers where the text is cut, a third whether it is transformed at all (so many of
    100 are), a fourth whether the suffix comes first (so many of 100 that are). An empty text, or one that contains a sentinel, stays plain.

    Columns: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output. A null text counts as empty, a
    null doc_id as an empty one; repeated rows change alike; an empty table gives no rows; other columns are ignored.
    """
    p, s, m = SENTINELS
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")
    spelled = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | spelled | (number(3) % 100 >= transformed)
    rows = rows.withColumn("form", F.when(plain, "plain").when(number(4) % 100 < suffix_first, "spm").otherwise("psm"))
    at = lambda k: F.when(F.col("form") != "plain", number(k))
    rows = rows.withColumn("cuts", _cuts("text", at(1), at(2)))
    a, b = F.col("cuts.prefix_chars").cast("int"), F.col("cuts.middle_chars").cast("int")
    text = F.col("text")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b), F.substring(text, a + b + 1, F.length(text))
    psm = F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle)
    spm = F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("doc_id", "cuts.n", "form", "cuts.prefix_chars", "cuts.middle_chars", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of: what stands between sentinels, in the order prefix, middle, suffix."""
    p, s, m = SENTINELS
    halves = F.split(output, m, 2)
    psm, spm = F.split(halves[0], s, 2), F.split(halves[0], p, 2)
    turned = F.concat(F.substring(psm[0], F.lit(len(p) + 1), F.length(output)), halves[1], psm[1])
    swapped = F.concat(spm[1], halves[1], F.substring(spm[0], F.lit(len(s) + 1), F.length(output)))
    return F.when(form == "psm", turned).when(form == "spm", swapped).otherwise(output)
