"""Patterns that find a known value in text that was read by a machine."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import WS

#: Readings of letter pairs and of single characters, the shortest value they are used for, and the four i's that always fold.
DIGRAPHS = {"ss": ("ss", "ß", "B", "fs"), "ae": ("ae", "ä"), "oe": ("oe", "ö"), "ue": ("ue", "ü"), "rn": ("rn", "m")}
CONFUSIONS = {
    "ß": ("ß", "ss", "B", "b", "fs", "13"), "ä": ("ä", "a", "ae", "à", "á", "â", "ã"), "ö": ("ö", "o", "oe", "é", "ó", "ò", "ô", "0"), "ü": ("ü", "u", "ue", "ù", "ú", "û", "ii"),
    "0": ("0", "O", "o", "Q", "D"), "1": ("1", "l", "I", "i", "ı", "|"), "2": ("2", "Z", "z"), "5": ("5", "S", "s"), "6": ("6", "G", "b"), "7": ("7", "T"), "8": ("8", "B"), "9": ("9", "g", "q"),
    "O": ("O", "0", "Q", "D"), "S": ("S", "5"), "B": ("B", "8", "ß"), "G": ("G", "6"), "Z": ("Z", "2"), "l": ("l", "1", "I", "|"),
    "i": ("i", "ı", "I", "İ", "1", "l", "|"), "ı": ("ı", "i", "I", "İ", "1", "l", "|"), "I": ("I", "i", "ı", "İ", "1", "l", "|"), "İ": ("İ", "I", "i", "ı", "1", "l", "|"),
}
I_FAMILY = ("i", "ı", "I", "İ")
TOLERANT_FROM = 5


def _cased(options: tuple[str, ...]) -> tuple[str, ...]:
    """The readings with each letter in either case, longest first; a single i stands for itself, as its family is spelled out."""
    either = lambda c: dict.fromkeys(x for x in (c, c.lower(), c.upper()) if len(x) == 1)
    cased = dict.fromkeys("".join(v) for r in options for v in ([r] if r in I_FAMILY else product(*map(either, r))))
    return tuple(sorted(cased, key=len, reverse=True))


_PIECE = re.compile(r"\s+|.", re.S)
_WIDE_PIECE = re.compile(rf"\s+|(?i:{'|'.join(DIGRAPHS)})|.", re.S)


@lru_cache(maxsize=1 << 14)
def _read(piece: str, wide: bool) -> tuple[str, ...] | None:
    if piece.isspace():
        return None
    if len(piece) == 2:
        return _cased(DIGRAPHS[piece.lower()])
    if wide:
        known = next((CONFUSIONS[k] for k in (piece, piece.lower(), piece.upper()) if k in CONFUSIONS), None)
    else:
        known = I_FAMILY if piece in I_FAMILY else None
    return _cased(known or (piece,))


@lru_cache(maxsize=1 << 12)  # values hardly come again, and each takes some kB
def readings(value: str) -> tuple[tuple[str, ...] | None, ...]:
    """What each piece of the value may have been read as, in order of preference; None for white space, which matches any. Short values only fold the four i's."""
    wide = len(value) >= TOLERANT_FROM
    return tuple(_read(x, wide) for x in (_WIDE_PIECE if wide else _PIECE).findall(value))


@lru_cache(maxsize=4096)
def tolerant_pattern(value: str) -> str:
    """A pattern for the value as it may have been misread (see readings)."""
    return "".join(f"{WS}+" if unit is None else "(?:" + "|".join(map(re.escape, unit)) + ")" for unit in readings(value))


@F.pandas_udf(T.ArrayType(T.StringType()))
def tolerant_patterns(values: pd.Series) -> pd.Series:
    """tolerant_pattern of each value of an array."""
    return values.map(lambda v: None if v is None else [tolerant_pattern(x) for x in v])


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility forms (full-width letters, ligatures) as what they stand for."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def folded(text: Column) -> Column:
    """Lower-cased, white space collapsed and trimmed. Compatibility forms are the caller's matter (see nfkc)."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), f"{WS}+", " "), "^ | $", "")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
