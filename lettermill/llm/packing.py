"""Packing token windows with lexically close neighbours from a sharded BM25 index."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Tokens in a sequence, and remainders in a shard of the index.
WINDOW, SHARD = 1024, 2048
#: BM25's saturation and length normalisation, and the rarest terms that Bm25.scores looks up unless it is told otherwise; packing looks up all.
K1, B, QUERY_TERMS = 1.2, 0.75, 24
#: Heaviest terms of a remainder that say where it is indexed, and the most partitions of the index; one holds as many shards as it needs.
ROUTE_TERMS, PARTITIONS = 8, 4096
#: The id that ends a document.
END = 0
#: A run of so much white space is encoded by the tokenizer file.
LONG_SPACE = 10_000


@lru_cache(maxsize=4)
def _encoder(name: str):
    """A function from texts to id lists: the byte-level BPE of the vocabulary file `name`.json.

    Where the same vocabulary lies beside it as ranks, those are used: the ids are the same and come four times as fast. A text in
    which a special token is spelled out, or which has a run of LONG_SPACE blanks, goes through the tokenizer file itself: the other
    library looks back over such runs step by step and has no room for a million steps.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    @lru_cache(maxsize=1)
    def whole() -> Tokenizer:
        return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    space = re.compile(rf"\s{{{LONG_SPACE}}}")

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or len(text) >= LONG_SPACE and space.search(text):
            return whole().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


PIECE = "doc_id {0}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(name: str, window: int):
    """Of each document: its full windows (kind 0), and what is left of it with its ids (kind 1). Of each task: how many of its remainders have each id (kind 2: start is the id, length the number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(name)
        held, none = np.zeros(0, np.int64), None
        for b in batches:
            none = b.column("doc_id").type
            at, kinds, starts, sizes, crcs, totals, rest = [], [], [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                found = encode(text.as_py() or "")
                found.append(END)
                ids = np.fromiter(found, "<u4", len(found))
                full = len(ids) // window * window
                for k in range(0, len(ids), window):
                    piece = ids[k : k + window]
                    at.append(i)
                    kinds.append(0 if k < full else 1)
                    starts.append(k)
                    sizes.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
                    rest.append(None if k < full else piece.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes())
                    if k >= full:
                        held = _added(held, piece)
            docs = b.column("doc_id").take(pa.array(at, pa.int64()))
            longs = [pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), docs, *longs, pa.array(rest, pa.binary())], names)
        at = np.flatnonzero(held)
        if len(at):
            nothing = pa.array(np.zeros(len(at), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2, np.int32)), pa.nulls(len(at), none), pa.array(at), pa.array(held[at]), nothing, nothing, pa.nulls(len(at), pa.binary())], names)

    names = ["kind", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    return run


def _added(held: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """held with one more for each distinct one of the terms."""
    if len(terms) and terms.max() >= len(held):
        held = np.concatenate([held, np.zeros(int(terms.max()) + 1 - len(held), np.int64)])
    held[terms] += 1  # a term that comes again is set to the same number again
    return held


def _bag(ids: bytes, length: int) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if len(ids) > 2 * length else "<u2")


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def _by_term(counts: DataFrame) -> np.ndarray:
    """Sums of (term, n) by term: one number for each id of the vocabulary, whatever the input."""
    rows = counts.groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["term"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out


def heaviest(bags: list[np.ndarray], df: np.ndarray, n: int, mean: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each remainder: its ROUTE_TERMS heaviest terms that others of the table have too, and their weights, the heaviest first."""
    size = np.array([len(x) for x in bags], np.int64)
    if not size.sum():
        return [(np.empty(0, np.int64), np.empty(0))] * len(bags)
    vocabulary = len(df)
    pair = np.sort(np.repeat(np.arange(len(bags)) * vocabulary, size) + np.concatenate(bags))
    edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    tf = np.diff(np.append(edge, len(pair)))
    doc, term = np.divmod(pair[edge], vocabulary)
    keep = df[term] > 1
    doc, term, tf = doc[keep], term[keep], tf[keep]
    weight = _idf(n, df[term]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
    order = np.argsort(doc - weight / 1024, kind="stable")  # weights stay far below that
    first = np.searchsorted(doc, np.arange(len(bags) + 1))
    tops = (order[lo : min(hi, lo + ROUTE_TERMS)] for lo, hi in zip(first[:-1], first[1:], strict=True))
    return [(term[at], weight[at]) for at in tops]


def _tops(df, n: int, mean: float):
    """Adds to each remainder its heaviest terms (as bytes of uint32) and their weights (of float32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [_bag(ids.as_buffer(), length) for ids, length in zip(b.column("ids"), b.column("length").to_pylist(), strict=True)]
            found = [x for k in range(0, len(bags), SHARD) for x in heaviest(bags[k : k + SHARD], df.value, n, mean)]
            terms, weights = (pa.array([x[k].astype(kind).tobytes() for x in found], pa.binary()) for k, kind in ((0, "<u4"), (1, "<f4")))
            yield pa.RecordBatch.from_arrays([*b.columns, terms, weights], [*b.schema.names, "terms", "weights"])

    return run


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's remainders: how many have each term among their heaviest."""
    held = np.zeros(0, np.int64)
    for b in batches:
        terms = np.frombuffer(b"".join(b.column("terms").to_pylist()), "<u4")
        n = np.bincount(terms, minlength=len(held))
        n[: len(held)] += held
        held = n
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["term", "n"])


def _routes(sharing, fit: float):
    """Puts a remainder's heaviest terms in the order of what neighbours that fill its window (`fit` of them) can score by them: those alike are near each other in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            routes = []
            for t, w in zip(b.column("terms"), b.column("weights"), strict=True):
                terms = np.frombuffer(t.as_buffer(), "<u4")
                gain = np.frombuffer(w.as_buffer(), "<f4") * np.minimum(sharing.value[terms] - 1, fit)
                routes.append(terms[np.argsort(-gain, kind="stable")].astype(">u4").tobytes())
            names = [k for k in b.schema.names if k not in ("terms", "weights")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(routes, pa.binary())], [*names, "route"])

    return run


class Bm25:
    """An inverted index of a shard's remainders over their token ids: postings by term, with BM25 weights worked out at once.

    table: number of remainders, their mean length and each term's df in the whole table; without it the bags are the table.
    """

    def __init__(self, bags: list[np.ndarray], table: tuple[int, float, np.ndarray] | None = None):
        size = np.array([len(x) for x in bags], np.int64)
        doc = np.repeat(np.arange(len(bags)), size)
        term = np.concatenate(bags).astype(np.int64) if len(bags) else np.empty(0, np.int64)
        pair, tf = np.unique(term * len(bags) + doc, return_counts=True)
        term, self.docs = pair // max(1, len(bags)), pair % max(1, len(bags))
        self.terms, self.first, df = np.unique(term, return_index=True, return_counts=True)
        self.last = self.first + df
        n, mean, of_term = table or (len(bags), size.mean() if len(size) else 1.0, None)
        self.idf = _idf(n, df if of_term is None else of_term[self.terms])
        norm = K1 * (1 - B + B * size / max(1.0, mean))
        self.weight = np.repeat(self.idf, df) * tf * (K1 + 1) / (tf + norm[self.docs])
        self.n = len(bags)
        common = np.flatnonzero(16 * df > self.n)  # these have a row of weights for all remainders: at most 16 times their postings
        self.row = np.full(len(self.terms), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n), np.float32)
        many = np.repeat(self.row, df)
        self.rows[many[many >= 0], self.docs[many >= 0]] = self.weight[many >= 0]

    def scores(self, bag: np.ndarray, terms: int | None = QUERY_TERMS) -> np.ndarray:
        """BM25 scores of all remainders for the seed's rarest shared terms, or, with None, for all of them."""
        i = np.searchsorted(self.terms, np.unique(bag).astype(np.int64))
        i = i[self.last[i] - self.first[i] > 1]
        if terms is not None:
            i = i[np.argsort(-self.idf[i], kind="stable")[:terms]]
        row = self.row[i]
        out = self.rows[row[row >= 0]].sum(axis=0, dtype=np.float64)
        for t in i[row < 0].tolist():
            at = slice(self.first[t], self.last[t])
            out[self.docs[at]] += self.weight[at]
        return out


def _best_first(score: np.ndarray, few: int = 64) -> Iterator[int]:
    """Places with a score, the highest first, of equal ones the earlier: first the best few, so that the rest is only sorted if it is asked for."""
    near = np.flatnonzero(score)
    best = score[near]
    if len(near) > 4 * few:
        least = np.partition(best, len(best) - few)[len(best) - few]
        top = near[best >= least]
        yield from top[np.argsort(-score[top], kind="stable")].tolist()
        near = near[best < least]
    yield from near[np.argsort(-score[near], kind="stable")].tolist()


def fill(bags: list[np.ndarray], window: int, table: tuple[int, float, np.ndarray] | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (bag, first id, end): each begins with an unused seed, the longest first, and takes its best unused
    neighbours until it is full. What doesn't fit of the last one stays for later. Without scoring neighbours the longest unused go in."""
    index = Bm25(bags, table)
    begin, size = np.zeros(len(bags), np.int64), np.array([len(x) for x in bags], np.int64)
    left = size.copy()
    order = np.argsort(-size, kind="stable")
    seed = 0
    while True:
        while seed < len(order) and not left[order[seed]]:
            seed += 1
        if seed == len(order):
            return
        first = order[seed]
        room, out = window, []

        def take(i: int) -> None:
            nonlocal room
            n = min(room, int(left[i]))
            out.append((int(i), int(begin[i]), int(begin[i]) + n))
            begin[i] += n
            left[i] -= n
            room -= n

        take(first)
        if room:
            score = index.scores(bags[first], None)
            score[left == 0] = 0
            for i in _best_first(score):
                if not room:
                    break
                take(i)
            for i in order[seed:] if room else ():
                if not room:
                    break
                if left[i]:
                    take(i)
        yield out


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Cuts documents into pieces and packs these into sequences of at most `window` ids.

    A document's ids end with END. Its full windows are sequences by themselves. Remainders go to index shards of about `shard` of them
    by content: each is ordered by its heaviest terms under the whole table's BM25 statistics, first that by which its neighbours can score most,
    and a shard is a stretch of that order, so those alike meet wherever they come from. In a shard, a BM25 index over token ids, with
    idf and mean length of the whole table, gives each seed's unused neighbours, which fill its window, cut where it is full. So only
    a shard's last sequence is short, by less than a window.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text counts as empty: END alone. Repeated rows
    and null ids are packed as documents of their own. An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _cut(tokenizer, window), f"kind int, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    )
    pieces = written(cut, "pack-pieces")
    full, rest = pieces.where("kind = 0"), pieces.where("kind = 1")
    n, total = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    mean, shards = max(1.0, total / max(1, n)), max(1, -(-n // shard))
    fields = PIECE.format(kind)
    context = docs.sparkSession.sparkContext
    df = context.broadcast(_by_term(pieces.where("kind = 2").select(F.col("start").alias("term"), F.col("length").alias("n"))))
    tops = written(rest.drop("kind").mapInArrow(_tops(df, n, mean), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, terms binary, weights binary"), "pack-tops")
    sharing = context.broadcast(_by_term(tops.select("terms").mapInArrow(_sharing, "term long, n long")))
    fit = max(1.0, window / mean)

    def pack_shard(rows: pd.DataFrame, first: int) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bags = [_bag(x, size) for x, size in zip(rows["ids"], rows["length"], strict=True)]
        at, starts, sizes, crcs, sequences, offsets = [], [], [], [], [], []
        for k, sequence in enumerate(fill(bags, window, (n, mean, df.value))):
            offset = 0
            for i, a, b in sequence:
                at.append(i)
                starts.append(a)
                sizes.append(b - a)
                crcs.append(zlib.crc32(bags[i][a:b].astype("<u4").tobytes()))
                sequences.append(first + 2 * k)
                offsets.append(offset)
                offset += b - a
        out = rows.iloc[at].reset_index(drop=True)
        return pd.DataFrame({"doc_id": out["doc_id"], "start": out["start"] + starts, "length": sizes, "ids_crc32": crcs, "doc_tokens": out["doc_tokens"], "sequence_id": sequences, "offset": offsets})

    def pack_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sorted remainders of a partition, a shard at a time; the last ones are shared out evenly."""
        first = (TaskContext.get().partitionId() << 40) * 2 + 1
        held = pd.DataFrame()
        for batch in batches:
            held = pd.concat([held, batch], ignore_index=True) if len(held) else batch
            while len(held) >= 3 * shard:
                yield (out := pack_shard(held[:shard], first))
                first, held = int(out["sequence_id"].iloc[-1]) + 2, held[shard:]
        parts = max(1, round(len(held) / shard))
        for k in range(parts if len(held) else 0):
            yield (out := pack_shard(held[len(held) * k // parts : len(held) * (k + 1) // parts], first))
            first = int(out["sequence_id"].iloc[-1]) + 2

    salted = tops.withColumn("salt", F.xxhash64("doc_id", "ids_crc32", "length", F.monotonically_increasing_id()))
    routed = salted.mapInArrow(_routes(sharing, fit), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, salt long, route binary")
    dealt = routed.repartitionByRange(min(shards, PARTITIONS), "route", "salt").sortWithinPartitions("route", "salt")
    packed = written(dealt.mapInPandas(pack_partition, fields), "pack-sequences")
    discard(tops)
    alone = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.union(packed)
