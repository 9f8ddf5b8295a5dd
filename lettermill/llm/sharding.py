"""Minimax contiguous sharding with atomic groups of equal texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, text_bytes, written

#: Hex digits by which a slice of the key range is cut finer: 4096 parts.
DIGITS = 3
#: A slice with at most so many groups is resolved into its groups.
EXACT_GROUPS = 256
#: Cells into which a shard's rows are dealt to be numbered in parallel.
CELLS = 1024


class _Order:
    """Sizes along the ordered groups, as finely as the search has needed so far.

    The driver holds sums over key slices, never all groups: 4096 slices at first; those in which a cut may fall are cut finer.
    """

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.leaves: dict[str, tuple[int, int]] = {}
        self._add(groups.groupBy(F.substring("key", 1, DIGITS).alias("part")))
        self._index()

    def _add(self, grouped) -> None:
        for r in grouped.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
            self.leaves[r["part"]] = (r["size"], r["n"])

    def _index(self) -> None:
        self.parts = sorted(self.leaves)
        self.ends = np.cumsum([self.leaves[p][0] for p in self.parts], dtype=np.int64)
        self.single = np.array([self.leaves[p][1] == 1 for p in self.parts], bool)
        self.total = int(self.ends[-1]) if len(self.parts) else 0

    def refine(self, places: set[int]) -> None:
        by_length: dict[tuple[int, bool], list[str]] = {}
        for i in places:
            part = self.parts[i]
            by_length.setdefault((len(part), self.leaves[part][1] <= EXACT_GROUPS), []).append(part)
        for (length, exact), parts in by_length.items():
            for p in parts:
                del self.leaves[p]
            child = F.col("key") if exact else F.substring("key", 1, length + DIGITS)
            self._add(self.groups.where(F.substring("key", 1, length).isin(parts)).groupBy(child.alias("part")))
        self._index()

    def walk(self, capacity: int, shards: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Lowest and highest place that each greedy shard may end at, and the slices that leave it open."""
        low = high = 0
        bounds, open_ = [], set()
        for _ in range(shards):
            a = int(np.searchsorted(self.ends, low + capacity, "right"))
            b = int(np.searchsorted(self.ends, high + capacity, "right"))
            target = high + capacity
            low = int(self.ends[a - 1]) if a else 0
            if b < len(self.ends) and not self.single[b]:
                high = target
            else:
                high = int(self.ends[b - 1]) if b else 0
            if low != high:
                open_.update(i for i in range(a, min(b, len(self.ends) - 1) + 1) if not self.single[i])
            bounds.append((low, high))
        return bounds, open_

    def decide(self, capacity: int, shards: int) -> bool:
        while True:
            bounds, open_ = self.walk(capacity, shards)
            low, high = bounds[-1]
            if low >= self.total:
                return True
            if high < self.total:
                return False
            self.refine(open_)

    def cuts(self, capacity: int, shards: int) -> list[str]:
        """For each shard but the last, a bound above the keys of it and all before."""
        while True:
            bounds, open_ = self.walk(capacity, shards)
            if all(a == b for a, b in bounds):
                break
            self.refine(open_)
        places = [int(np.searchsorted(self.ends, a, "right")) for a, _ in bounds[:-1]]
        return [self.parts[i - 1] + "g" if i else "" for i in places]


def assign_shards(docs: DataFrame, shards: int = 24, cells: int = CELLS) -> DataFrame:
    """Deals documents into `shards` shards of nearly equal bytes; equal texts stay together.

    Groups of equal texts are ordered by a digest of the text. The smallest capacity for which a greedy pass needs no more
    than `shards` shards is found by binary search, and the cuts are made there. A group larger than an even share of what
    the other shards hold can't be evened out; it gets a shard of its own first, so the rest stay even.

    Columns: doc_id, size (UTF-8 bytes plus 8), text_crc32, law 'bytes', shard, slot (gapless in the shard), grown_shard null.
    A null text counts as none (size 8, crc32 0) and forms one group with other nulls, apart from empty texts. Repeated rows
    get slots of their own; a null doc_id is kept. An empty table gives no rows. Other columns are ignored.
    """
    slim = written(
        docs.select(
            "doc_id",
            (text_bytes(F.col("text")) + 8).alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.substring(F.sha2("text", 256), 1, 40), F.lit("0" * 40)).alias("key"),
        ),
        "shard-docs",
    )
    groups = written(slim.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    total, left = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], shards
    large: list[str] = []
    for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        if left > 1 and r["size"] * left > total:
            large.append(r["key"])
            total, left = total - r["size"], left - 1
        else:
            break
    rest = groups.where(~F.col("key").isin(large)) if large else groups
    order = _Order(rest)
    low, high = max(1, -(-order.total // left), rest.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]), max(1, order.total)
    while low < high:
        middle = (low + high) // 2 if high - low < order.total // left else low + (high - low) // 16
        if order.decide(middle, left):
            high = middle
        else:
            low = middle + 1
    cuts = order.cuts(low, left) if order.total else []
    discard(groups)

    shard = F.lit(len(large))
    for bound in cuts:
        shard = shard + (F.col("key") >= bound).cast("int")
    for i, key in enumerate(large):
        shard = F.when(F.col("key") == key, i).otherwise(shard)
    placed = slim.withColumns({"shard": shard.cast("int"), "cell": F.pmod(F.xxhash64("doc_id", "key"), F.lit(cells))})
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("shard", "cell").orderBy("doc_id", "key")
    return (
        placed.join(F.broadcast(offsets), ["shard", "cell"])  # at most shards x cells rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.row_number().over(within) - 1 + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
