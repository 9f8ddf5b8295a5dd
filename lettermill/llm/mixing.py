"""Mixing sources to target weights with Sainte-Laguë block quotas."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import WORD, discard, written

WEIGHTS = (5, 2, 1)
#: Words in a block, and the fewest blocks of a source: those of a small one are shorter, down to a word.
BLOCK, FEWEST = 64, 16
#: Cells into which a source's documents are dealt, so that its running word count needs no single task.
CELLS = 1024
#: Shards into which a mix is dealt; each has quotas of its own.
SHARDS = 32
#: Up to so many sources (a row of some 400 bytes each with SHARDS shards) their plan is broadcast; beyond it Spark picks the join.
BROADCAST_SOURCES = 20_000
#: The plan is made by the driver, a row for each source; more sources than this are an error, not a mix.
MOST_SOURCES = 1_000_000


def targets_for(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """`share` of all words, by weight; no target above `most` times its source, the excess reshared by weight."""
    out, active, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while active:
        each = left / sum(weights[i] for i in active)
        full = [i for i in active if each * weights[i] > most * sizes[i]]
        if not full:
            for i in active:
                out[i] = each * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        active = [i for i in active if i not in set(full)]
    return out


def apportion(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Sainte-Laguë: seats go one by one to the highest votes / (2 * held + 1); ties to the earlier entry.

    A divisor that gives all but a few seats at once is found by bisection, and the heap hands out those left.
    """
    caps = caps or [seats] * len(votes)
    held_at = lambda d: [min(c, math.floor(v / d + 0.5)) for v, c in zip(votes, caps, strict=True)]
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    low, high = total / seats / 4, total / seats * 4 + 2 * max(votes)
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if sum(held_at(middle)) <= seats else (middle, high)
    held = held_at(high)
    queue = [(-v / (2 * h + 1), i) for i, (v, h) in enumerate(zip(votes, held, strict=True)) if v > 0 and h < caps[i]]
    heapq.heapify(queue)
    for _ in range(seats - sum(held)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        held[i] += 1
        if held[i] < caps[i]:
            heapq.heappush(queue, (-votes[i] / (2 * held[i] + 1), i))
    return held


def shard_quotas(votes: list[float], seats: int, shards: int, caps: list[int]) -> list[list[int]]:
    """Quotas of each shard: what each further share of the seats adds. Highest-quotient seats are only ever added, so none is negative."""
    before, out = [0] * len(votes), []
    for k in range(1, shards + 1):
        upto = apportion(votes, seats * k // shards, caps)
        out.append([b - a for a, b in zip(before, upto, strict=True)])
        before = upto
    return out


def _shuffle_of(seed: int, source: str | None, n: int) -> tuple[int, int]:
    """A seeded rearrangement b -> (a * b + c) mod n of n blocks, which needs no sort; a is small enough for 64 bits to hold a * b + c."""
    digest = hashlib.sha256(f"{seed}:{source!r}".encode("utf-8", "surrogatepass")).digest()
    most = max(1, min(n, (1 << 62) // n))
    a, c = 1 + int.from_bytes(digest[:8], "big") % most, int.from_bytes(digest[8:16], "big") % n
    while math.gcd(a, n) != 1:
        a += 1
    return a, c


def source_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 42, shards: int = SHARDS) -> list[dict]:
    """One entry per source, in code-point order with null last: size, target, words in a block, quotas per shard and its block rearrangement.

    Blocks are equal, but a source of fewer than FEWEST of them is cut into FEWEST shorter ones, so that its quota can come near its target.
    """
    by_source = written(docs.groupBy("source").agg(F.sum("size").alias("size")), "mix-sources")
    if by_source.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = by_source.collect()
    discard(by_source)
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in found]
    goal = targets_for(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    words = [max(1, min(block, -(-n // FEWEST))) for n in sizes]
    blocks = [-(-n // w) for n, w in zip(sizes, words, strict=True)]
    votes = [g / w for g, w in zip(goal, words, strict=True)]
    quotas = shard_quotas(votes, round(sum(votes)), shards, [math.ceil(most) * n for n in blocks])
    plan = []
    for i, r in enumerate(found):
        own = [q[i] for q in quotas]
        a, c = _shuffle_of(seed, r["source"], max(1, blocks[i]))
        plan.append({"source": r["source"], "source_size": sizes[i], "target": goal[i], "block": words[i], "quotas": own, "ends": np.cumsum(own).tolist(), "blocks": max(1, blocks[i]), "a": a, "c": c})
    return plan


def _placed(docs: DataFrame, plan: list[dict], seed: int, cells: int) -> DataFrame:
    """docs (with size) and each one's first word in its source's seeded stream, and its source's plan.

    Rows are dealt by source and cell once, for both the numbering within a cell and the join with the cells' offsets.
    """
    spark = docs.sparkSession
    fields = {"source": "string", "source_size": "long", "target": "double", "block": "long", "blocks": "long", "a": "long", "c": "long", "ends": "array<long>"}
    plans = spark.createDataFrame([tuple(p[k] for k in fields) for p in plan], ", ".join(f"{k} {v}" for k, v in fields.items()))
    plans = plans.select(_named(F.col("source")).alias("__named"), *[F.col(k).alias(f"__{k}") for k in list(fields)[1:]])
    plans = F.broadcast(plans) if len(plan) <= BROADCAST_SOURCES else plans
    celled = docs.withColumns({"__named": _named(F.col("source")), "__cell": F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(cells))})
    before = W.partitionBy("__named").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = celled.groupBy("__named", "__cell").agg(F.sum("size").alias("n")).select("__named", "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    within = W.partitionBy("__named", "__cell").orderBy("doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    started = celled.withColumn("__inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["__named", "__cell"])
    return started.withColumn("__start", F.col("__inside") + F.col("__offset")).join(plans, "__named").drop("__named", "__cell", "__inside", "__offset")


def _named(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def takes(start: np.ndarray, size: np.ndarray, blocks: np.ndarray, a: np.ndarray, c: np.ndarray, ends: np.ndarray, block: np.ndarray | int) -> dict[str, np.ndarray]:
    """What a mix takes of documents: runs of words (row, time, shard, first, end), in order. block: words in a block of each one's source.

    A source's picks are numbered: whole passes over its stream in order, then blocks by its rearrangement (rank b -> (a * b + c) mod
    blocks). ends[k] is the number of picks that shards 0 to k take, so a pick's number gives its shard.
    """
    block = np.broadcast_to(block, size.shape)
    n = np.where(size > 0, (start + size - 1) // block - start // block + 1, 0)
    row = np.repeat(np.arange(len(size)), n)
    b = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (start // block)[row]
    lo, hi = np.maximum(0, b * block[row] - start[row]), np.minimum(size[row], (b + 1) * block[row] - start[row])
    passes, rest = ends[:, -1] // blocks, ends[:, -1] % blocks
    picks = [(np.flatnonzero(passes[row] > t), t) for t in range(int(passes.max(initial=0)))]
    parts = [(at, np.full(len(at), t), t * blocks[row[at]] + b[at]) for at, t in picks]
    rank = (a[row] * b + c[row]) % blocks[row]
    at = np.flatnonzero(rank < rest[row])
    parts.append((at, passes[row[at]], passes[row[at]] * blocks[row[at]] + rank[at]))
    at, time, pick = (np.concatenate(x) for x in zip(*parts, strict=True))
    shard = np.zeros(len(at), np.int64)
    for k in range(0, len(at), 1 << 16):
        part = slice(k, k + (1 << 16))
        shard[part] = (ends[row[at[part]]] <= pick[part, None]).sum(axis=1)
    order = np.lexsort((lo[at], shard, time, row[at]))
    at, time, shard = at[order], time[order], shard[order]
    row, lo, hi = row[at], lo[at], hi[at]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (time[1:] != time[:-1]) | (shard[1:] != shard[:-1]) | (lo[1:] != hi[:-1])
    edge = np.flatnonzero(new)
    return {"row": row[edge], "time": time[edge], "shard": shard[edge], "first": lo[edge], "end": hi[np.append(edge[1:], len(at))[: len(edge)] - 1]}


def _taken(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    start, size, block, blocks, a, c = (b.column(k).to_numpy() for k in ("__start", "__size", "__block", "__blocks", "__a", "__c"))
    ends = b.column("__ends")
    ends = ends.flatten().to_numpy().reshape(len(start), -1) if len(start) else np.zeros((0, 1), np.int64)
    return takes(start, size, blocks, a, c, ends, block)


def _sized(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 42, cells: int = CELLS, **plan_options) -> DataFrame:
    """How many words of each document the mix takes, and for which shards.

    Sizes are words of the whole text (null: none). Equal-token blocks are apportioned to sources by highest quotients, shard by shard, and
    each shard's quota of a source is met by the next picks of its seeded stream: whole passes, then blocks in a seeded rearrangement.

    Columns: doc_id, size, source_size, target, taken, shard_words (shard and words, by shard). Null sources form one source; repeated
    rows are documents of their own; documents without words take nothing. An empty table gives no rows. Other columns are ignored.
    """
    slim = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), _sized(docs).alias("size")), "mix-docs")
    placed = _placed(slim, source_plan(slim, block=block, seed=seed, **plan_options), seed, cells)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = _taken(b)
            words = t["end"] - t["first"]
            taken = np.bincount(t["row"], weights=words, minlength=b.num_rows).astype(np.int64)
            shards = int(t["shard"].max(initial=0)) + 1
            cell, at = np.unique(t["row"] * shards + t["shard"], return_inverse=True)
            by_shard = pa.StructArray.from_arrays([pa.array((cell % shards).astype(np.int32)), pa.array(np.bincount(at, weights=words, minlength=len(cell)).astype(np.int64))], ["shard", "words"])
            edges = np.searchsorted(cell // shards, np.arange(b.num_rows + 1)).astype(np.int32)
            columns = [b.column(k) for k in ("doc_id", "__size", "__source_size", "__target")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(taken), pa.ListArray.from_arrays(pa.array(edges), by_shard)], ["doc_id", "size", "source_size", "target", "taken", "shard_words"])

    slim = placed.withColumnRenamed("size", "__size").drop("source")
    return slim.mapInArrow(run, f"doc_id {kind}, size long, source_size long, target double, taken long, shard_words array<struct<shard: int, words: long>>")


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 42, cells: int = CELLS, shard: str | None = None, **plan_options) -> DataFrame:
    """The mix itself, with the columns of docs: for each document, time and shard a row with the words that shard takes of it; `shard` names a column for that.

    A whole document is a row as it is; of a part, runs of words stand on lines of their own. n_chars, where present, follows the text.
    Documents of which nothing is taken go, those without words among them. Null sources form one source, repeated rows are documents of
    their own; an empty table gives no rows, and other columns, whatever their names, pass through.
    """
    columns, types = docs.columns, docs.schema
    if shard in columns:
        raise ValueError(f"there is a column {shard} already")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), "doc_id", F.col("source").cast("string").alias("source"), _sized(docs).alias("size"))
    slim = written(sized.select("source", "size"), "mix-sizes")
    plan = source_plan(slim, block=block, seed=seed, **plan_options)
    discard(slim)
    placed = _placed(sized.where("size > 0"), plan, seed, cells).withColumnRenamed("size", "__size").drop("doc_id", "source")
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = _taken(b)
            if not len(t["row"]):
                continue
            rows = b.column("__row")
            text = rows.field("text")
            key = np.stack([t["row"], t["time"], t["shard"]], axis=1)
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            whole = b.column("__size").to_numpy()
            at, texts, last, spans = t["row"][edge], [], None, []
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(key)], strict=True):
                i = int(t["row"][lo])
                if t["first"][lo] == 0 and t["end"][lo] == whole[i]:
                    texts.append(text[i].as_py())
                    continue
                if last != i:
                    last, body = i, text[i].as_py()
                    spans = [m.span() for m in word.finditer(body)]
                texts.append("\n".join(body[spans[x][0] : spans[y - 1][1]] for x, y in zip(t["first"][lo:hi].tolist(), t["end"][lo:hi].tolist(), strict=True)))
            taken = rows.take(pa.array(at))
            arrays = {f.name: taken.field(k) for k, f in enumerate(taken.type)} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in arrays:
                arrays["n_chars"] = pa.array([len(x) for x in texts], pa.int64()).cast(arrays["n_chars"].type)
            out = [arrays[c] for c in columns] + ([pa.array(t["shard"][edge].astype(np.int32))] if shard else [])
            yield pa.RecordBatch.from_arrays(out, [*columns, *([shard] if shard else [])])

    if shard:
        types = StructType([*types.fields, StructField(shard, IntegerType())])
    return placed.mapInArrow(run, types)
