"""Byte-level BPE: texts to ids and back, by the ranks of a vocabulary file.

A piece of a text is merged in a segment tree over its byte positions: a leaf holds the rank of the pair of parts that begins there, an
inner node, over FAN others, the least rank below it, so that the leftmost of the least is found by one descent and a merge changes three
leaves and what stands over them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash

#: The vocabulary file that the query uses, the longest piece whose ids a worker remembers, and how many it does.
VOCABULARY, SHORT, REMEMBERED = "byte_bpe_multi_50k.tiktoken", 32, 1 << 19
#: From this many bytes on a piece's numbers are held as an array.
LONG = 4096
#: Up to this many bytes a piece is merged without a tree.
BRIEF = 64
#: Characters of a text whose pieces are held at the same time.
AT_ONCE = 1 << 20
#: Children of a node: the least of a few is found faster than a binary tree of them is climbed.
FAN = 16
#: Above every rank: there is no such pair.
NONE = 0x7FFFFFFF


def _merged_brief(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As `merged`, in plain lists that shrink with each merge, which for a few parts is faster than a tree."""
    rank, at = ranks.get, list(range(len(piece) + 1))  # where parts begin
    pairs = [rank(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != NONE:
        i = pairs.index(least)
        del pairs[i], at[i + 1]
        if i < len(pairs):
            pairs[i] = rank(piece[at[i] : at[i + 2]], NONE)
        if i:
            pairs[i - 1] = rank(piece[at[i - 1] : at[i + 1]], NONE)
    return [ranks[piece[a:b]] for a, b in pairwise(at)]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: of all neighbouring parts whose bytes together have a rank, those of the least, the leftmost of equal ones, are joined until none has.

    Takes some 13 bytes for each byte of a long piece, and a logarithm of its length for each merge.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, rank = len(piece), ranks.get
    if n <= BRIEF:
        return _merged_brief(piece, ranks)
    numbers = list if n < LONG else lambda x: array("i", x)
    leaves = numbers([rank(piece[i : i + 2], NONE) for i in range(n - 1)])
    leaves.append(NONE)
    levels = [leaves]  # from the leaves to the root's children
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append(numbers([min(below[k : k + FAN]) for k in range(0, len(below), FAN)]))
    top, inner, climb = levels[-1], levels[-2::-1], list(zip(levels[:-1], levels[1:], strict=True))
    after, before = numbers(range(1, n + 1)), numbers(range(-1, n - 1))  # of each part, by its first byte
    while (least := min(top)) != NONE:
        i = top.index(least)
        for level in inner:  # down to the leftmost leaf that holds it
            i = level.index(least, i * FAN)
        j = after[i]
        k = after[i] = after[j]
        leaves[j] = NONE
        if k < n:
            before[k] = i
            leaves[i] = rank(piece[i : after[k]], NONE)
        else:
            leaves[i] = NONE
        if i:
            h = before[i]
            leaves[h] = rank(piece[h:k], NONE)
        if climb:
            for at in (j, i, h) if i else (j, i):
                for below, above in climb:
                    at //= FAN
                    least = min(below[at * FAN : (at + 1) * FAN])
                    if above[at] == least:
                        break
                    above[at] = least
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _ranges(chars: set[str]) -> str:
    """Characters as the ranges of a pattern's set."""
    points = np.array(sorted(map(ord, chars)))
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1) if len(points) else []
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


@lru_cache(maxsize=1)
def _classes() -> tuple[dict[str, str], set[str]]:
    """Class escapes with the sets that the tokenizer library means by them, whose Unicode is another version's than that of `regex`; and the characters that they differ in."""
    import tiktoken

    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    sets, differ = {}, set()
    for escape in (r"\p{L}", r"\p{N}"):
        found = tiktoken.Encoding("class", pat_str=escape, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(text)
        theirs, ours = set(bytes(found).decode()), set(regex.findall(escape, text))
        less = _ranges(ours - theirs)
        sets[escape] = "[" + (f"[{escape}--[{less}]]" if less else escape) + _ranges(theirs - ours) + "]"
        differ |= ours ^ theirs
    return sets, differ


class _Pieces(dict):
    """Ids of pieces, worked out when they are first asked for; short ones are remembered, anew from nothing when there are REMEMBERED of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> list[int]:
        ids = merged(piece.encode(), self.ranks)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class BytePairs:
    """Encoder and decoder of a vocabulary file of ranks; texts are first split by a pattern into pieces that no merge crosses."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.plain = _ranks(path), regex.compile(pattern)
        sets, differ = _classes()
        for escape, chars in sets.items():
            pattern = pattern.replace(escape, chars)
        self.exact = regex.compile(pattern, regex.VERSION1)
        # Python's own engine looks up the first 65,536 characters in a table, so most texts are cleared by one fast search
        self.suspect = re.compile(f"[{_ranges({c for c in differ if c < chr(0x10000)})}\\U00010000-\\U0010FFFF]")
        self.differ = re.compile(f"[{_ranges(differ)}]" if differ else "(?!)")
        self.parts = {v: k for k, v in self.ranks.items()}
        self._remembered = _Pieces(self.ranks)

    def splitter(self, text: str) -> regex.Pattern:
        """The pattern as it is, unless the text has a character that the two libraries class differently: then one with exact sets, which is slower."""
        return self.exact if not text.isascii() and self.suspect.search(text) and self.differ.search(text) else self.plain

    def encode(self, text: str) -> np.ndarray:
        pattern = self.splitter(text)
        # pieces of most texts are split off at once; of a very long one they come one by one, as a list of them takes many times its bytes
        pieces = pattern.findall(text) if len(text) <= AT_ONCE else (m[0] for m in pattern.finditer(text))
        return np.fromiter(chain.from_iterable(map(self._remembered.__getitem__, pieces)), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def _codec(vocabulary: str) -> BytePairs:
    import public_tokenizers

    return BytePairs(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the ids of each whole text, an array of int.

    A null text counts as empty and has no ids; bytes that are no UTF-8 count as U+FFFD; repeated rows and null doc_ids stay. An empty table
    gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for row, data, at in wordhash.stretches(texts):
                found = [codec.encode(data[lo:hi].tobytes().decode("utf-8", "replace")) for lo, hi in zip(at[:-1], at[1:], strict=True)]
                ends = np.cumsum([0, *map(len, found)])
                values = pa.array(np.concatenate(found).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(found)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


@F.arrow_udf(T.StringType())
def _digest(ids: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(row.values.to_numpy(zero_copy_only=False).astype("<u4").data).hexdigest() if row.is_valid else None for row in ids], pa.string())


def decoded(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """rows with `decoded`, the bytes that their ids stand for; null where ids are null. A column of that name is replaced, all others stay."""

    @F.arrow_udf("binary")
    def plain(ids: pa.Array) -> pa.Array:
        codec = _codec(vocabulary)
        return pa.array([codec.decode(row.values.to_numpy(zero_copy_only=False)) if row.is_valid else None for row in ids], pa.binary())

    return rows.withColumn("decoded", plain("ids"))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit numbers) and decoded_sha256 of rows with ids and decoded."""
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
