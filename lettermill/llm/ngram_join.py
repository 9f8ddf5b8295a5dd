"""Exact Jaccard self-join of documents on word shingles: grouped prefix join.

Documents with equal sets are one *set*; sets with the same size and the same ordered prefix are one *group*. Groups, not sets, are
indexed by the shingles of their prefix; pairs of groups are filtered, then expanded to their sets and verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import discard, if_small, tasks_for, written
from .components import components

#: Cells of the frequency sketch: what is broadcast is one byte for each, whatever the input.
CELLS = 1 << 21
#: A prefix shingle shared by up to so many groups has its groups paired off at once; those of longer runs meet in tiles. Groups of more sets do too.
SHORT_RUN = 8
#: From this level of the sketch on (shingles that recurred some 2 ** HOT times) a run is not gathered: its entries go to the tiles where they are.
HOT = 12
#: Bits of the filter that keeps texts nobody needs out of a shuffle.
FILTER_BITS = 1 << 24
#: Sets and shingles in a tile, about.
TILE_SETS, TILE_SHINGLES = 2048, 1 << 20
#: Pairs of one tile that are compared in one place.
HUB = 32
#: Rows, shingles or pairs that a task holds at a time.
CHUNK = 1 << 20
#: Bytes of a shingle in a prefix. Different shingles that agree in them only add candidates.
KEPT = 6
PROFILE = ["kind", "doc_id", "n", "h1", "h2"]


def _mixed(flat: np.ndarray, sizes: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit hash for each of the sets that lie side by side in flat."""
    first = np.cumsum(sizes) - sizes
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    with np.errstate(over="ignore"):
        if some.any():
            out[some] = np.add.reduceat(wordhash.mix(flat ^ np.uint64(salt)), first[some])
        return wordhash.mix(out + sizes.astype(np.uint64)).view(np.int64)


def _signatures(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    return _mixed(flat, sizes, 0), _mixed(flat, sizes, 0x5851F42D4C957F2D)


def _bits(s: np.ndarray) -> bytes:
    """Parity of how many shingles fall on each of 1 to 2 bits a shingle; two such maps differ in no more bits than the sets differ in shingles."""
    m = max(128, 1 << len(s).bit_length())
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The map of `size` bytes of the same set: halves on top of each other."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _least(n, num: int, den: int):
    """Shingles of a set's prefix: n - ceil(t n) + 1."""
    return n + (-num * n) // den + 1


def _need(x, y, num: int, den: int):
    """Common shingles that sets of these sizes need."""
    return -(-num * (x + y) // (num + den))


# ---- sets, groups and their prefixes


def _profile(width: int):
    """Of each document its set's size and signature (kind 0); of each CHUNK of shingles the sketch cells of those that several sets hold (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held, rows = b.column("doc_id"), [], 0
            seen: set[int] = set()
            for row, sizes, flat in wordhash.shingle_sets(b.column("text"), width):
                h1, h2 = _signatures(flat, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), ids.slice(row, len(sizes)), pa.array(sizes), pa.array(h1), pa.array(h2)], PROFILE)
                new = np.array([not (h in seen or seen.add(h)) for h in h1.tolist()], bool)
                held.append(flat[np.repeat(new, sizes)])
                rows += len(held[-1])
                if rows >= CHUNK:
                    yield _recurring(held, ids.type)
                    held, rows, seen = [], 0, set()
            if held:
                yield _recurring(held, ids.type)

    return run


def _recurring(held: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    s = np.sort(np.concatenate(held))
    edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)
    times = np.diff(np.append(edge, len(s)))
    code, times = s[edge[times > 1]], times[times > 1]
    arrays = [np.ones(len(code), np.int32), pa.nulls(len(code), kind), times.astype(np.int64), (code % np.uint64(CELLS)).astype(np.int64), np.zeros(len(code), np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in arrays], PROFILE)


def _sketch(profile: DataFrame) -> np.ndarray:
    """log2 of how often shingles of each cell recur: a fixed CELLS bytes. It orders shingles and tells hot ones; links don't depend on it."""
    cells = profile.where("kind = 1").groupBy("h1").agg(F.sum("n").alias("n")).where("n >= 4").select(F.col("h1").cast("int"), F.ceil(F.log2("n")).cast("byte").alias("level")).toPandas()
    out = np.zeros(CELLS, np.uint8)
    out[cells["h1"].to_numpy()] = cells["level"].to_numpy()
    return out


def _prefixes(width: int, num: int, den: int, sketch):
    """Of each set, once in a task: signature, size, the hash of its prefix in order (g1, g2), the prefix itself, and its parity map.

    A prefix is the set's n - ceil(t n) + 1 rarest shingles in one global order, so sets that can be similar share one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sketch.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for _, sizes, flat in wordhash.shingle_sets(b.column("text"), width):
                key = (level[(flat % np.uint64(CELLS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (flat >> np.uint64(8))
                stop = np.cumsum(sizes)
                prefixes, bits, at = [], [], []
                h1, h2 = _signatures(flat, sizes)
                for i, (x, y) in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    n = int(sizes[i])
                    if not n or (x, y) in seen:
                        continue
                    seen.add((x, y))
                    s, k = flat[stop[i] - n : stop[i]], key[stop[i] - n : stop[i]]
                    p = _least(n, num, den)
                    first = np.argpartition(k, p - 1)[:p] if p < n else np.arange(n)
                    first = first[np.lexsort((s[first], k[first]))]
                    prefixes.append(s[first])
                    bits.append(_bits(s))
                    at.append(i)
                if not at:
                    continue
                size = np.array([len(x) for x in prefixes])
                whole = np.concatenate(prefixes)
                place = (np.arange(len(whole)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    ordered = whole + place * np.uint64(0x9E3779B97F4A7C15)
                g1, g2 = _signatures(ordered, size)
                packed = whole.view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()
                stops = KEPT * np.cumsum(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[at]), pa.array(h2[at]), pa.array(sizes[at].astype(np.int32)), pa.array(g1), pa.array(g2), pa.array([packed[e - KEPT * k : e] for e, k in zip(stops.tolist(), size.tolist(), strict=True)], pa.binary()), pa.array(bits, pa.binary())],
                    ["h1", "h2", "n", "g1", "g2", "prefix", "bits"],
                )

    return run


def _entries(sketch):
    """Rows (s, gid, at, spread) of each group's prefix; at is place << 32 | size << 1 | wide. spread is 0 but for hot shingles, whose entries it keeps apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sketch.value
        for b in batches:
            for lo, packed, ends in wordhash.stretches(b.column("prefix"), KEPT * CHUNK):
                part = np.diff(ends) // KEPT
                eight = np.zeros((len(packed) // KEPT, 8), np.uint8)
                eight[:, :KEPT] = packed.reshape(-1, KEPT)
                s = eight.view(np.uint64).ravel()
                hot = level[(s % np.uint64(CELLS)).astype(np.int64)] >= HOT
                gid, n, wide = (np.repeat(b.column(k).slice(lo, len(part)).to_numpy(zero_copy_only=False), part) for k in ("id", "n", "wide"))
                pos = np.arange(len(s)) - np.repeat(np.cumsum(part) - part, part)
                at = pos << 32 | n.astype(np.int64) << 1 | wide.astype(np.int64)
                yield _batch({"s": s.view(np.int64), "gid": gid, "at": at, "spread": np.where(hot, 1 + gid % 65_521, 0).astype(np.int32)})

    return run


# ---- runs of one shingle


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Rows of batches sorted by s and for each how many its run has. Runs of over SHORT_RUN rows may come in parts, each row with a length over it, so a task never holds one whole."""
    held = {k: np.empty(0) for k in names}
    open_s = None
    for b in batches:
        c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in names}
        if not b.num_rows:
            continue
        if len(held["s"]):
            c = {k: np.concatenate([held[k], c[k]]) for k in names}
        cut = int(np.searchsorted(c["s"], c["s"][-1], "left"))
        if len(c["s"]) - cut > SHORT_RUN or c["s"][-1] == open_s:  # the last run is known to be long
            cut, held = len(c["s"]), {k: np.empty(0) for k in names}
        else:
            held = {k: v[cut:] for k, v in c.items()}
        if cut:
            c = {k: v[:cut] for k, v in c.items()}
            yield c, _lengths(c["s"], open_s)
            open_s = c["s"][-1] if not len(held["s"]) else None
    if len(held["s"]):
        yield held, _lengths(held["s"], open_s)


def _lengths(s: np.ndarray, open_s: int | None) -> np.ndarray:
    edge = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]))
    size = np.diff(edge)
    out = np.repeat(size, size)
    if open_s is not None:
        out[s == open_s] = SHORT_RUN + 1
    return out


def _likely(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of groups can still reach the threshold if this is their first common shingle: size and position filters, the second of which implies the shorter prefix of the smaller one."""
    x, y = n[i], n[j]
    return (den * np.minimum(x, y) >= num * np.maximum(x, y)) & (np.minimum(x - pos[i], y - pos[j]) >= _need(x, y, num, den))


def _first_round(num: int, den: int):
    """Of sorted entries: pairs of groups that share a short run (kind 0), and the entries of long runs, of hot shingles and of runs with a wide group (kind 1: a is s, b is the group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, length in _runs(batches, ("s", "gid", "at", "spread")):
            late = (length > SHORT_RUN) | (c["spread"] > 0)
            pos, n, wide = c["at"] >> 32, (c["at"] & 0xFFFFFFFF) >> 1, (c["at"] & 1).astype(bool)
            if wide.any():
                late |= np.isin(c["s"], np.unique(c["s"][wide])) & (length > 1)
            if late.any():
                yield _batch({"kind": np.ones(int(late.sum()), np.int32), "a": c["s"][late], "b": c["gid"][late]})
            pairs = []
            for step in range(1, SHORT_RUN):  # groups of a run that are `step` places apart
                i = np.flatnonzero((c["s"][step:] == c["s"][:-step]) & ~late[step:]) if len(c["s"]) > step else np.empty(0, np.int64)
                if not len(i):
                    break
                j = i + step
                ok = _likely(n, pos, i, j, num, den)
                pairs.append(np.stack([np.minimum(c["gid"][i[ok]], c["gid"][j[ok]]), np.maximum(c["gid"][i[ok]], c["gid"][j[ok]])], axis=1))
            if pairs:
                both = np.unique(np.concatenate(pairs), axis=0)
                yield _batch({"kind": np.zeros(len(both), np.int32), "a": both[:, 0].copy(), "b": both[:, 1].copy()})

    return run


def _plausible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of sets that parity maps leave."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y, n_x, n_y in zip(*(b.column(k).to_pylist() for k in ("bits_a", "bits_b", "n_a", "n_b")), strict=True):
                size = min(len(x), len(y))
                x, y = (_folded(np.frombuffer(bits, np.uint8), size).view(np.uint64) for bits in (x, y))
                keep.append(bool(_parity_allows(x, y, n_x, n_y, num, den)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    side = lambda t: sets.select(F.col("id").alias(t), F.col("n").alias(f"n_{t}"), F.col("bits").alias(f"bits_{t}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long")


def _parity_allows(x: np.ndarray, y: np.ndarray, n_x, n_y, num: int, den: int) -> np.ndarray:
    """Whether sets with these parity maps (rows) can still reach the threshold: they differ in at least as many shingles as their maps in bits."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= n_x + n_y - 2 * _need(n_x, n_y, num, den)


# ---- tiles


def _housed(sketch):
    """Adds to each group with late shingles its home, a frequent one of them that similar sets likely have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sketch.value
        for b in batches:
            homes = []
            for many in b.column("s"):
                s = many.values.to_numpy()
                of = level[(s.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)]
                homes.append(int(s[of >= int(of.max()) - 1].min()))
            yield pa.RecordBatch.from_arrays([b.column("gid"), b.column("s"), pa.array(homes, pa.int64())], ["gid", "s", "home"])

    return run


def _tiled(late: DataFrame, members: DataFrame, sets: DataFrame, sketch, num: int, den: int) -> DataFrame:
    """(tile, id, n, band, copies, bits, s) of the sets in long runs. A tile holds sets with one home and similar sizes, at most about TILE_SETS and TILE_SHINGLES."""
    wide = members.where(F.col("m") > SHORT_RUN)
    own = wide.select(F.xxhash64("gid").alias("s"), "gid").distinct()  # the sets of a wide group meet too
    shingles = late.union(own).groupBy("gid").agg(F.collect_set("s").alias("s"))
    housed = shingles.mapInArrow(_housed(sketch), "gid long, s array<long>, home long")
    band = F.floor(F.log("n") / math.log(den / num)).cast("int")
    placed = housed.join(members.select("gid", "id", "n", "copies"), "gid").withColumn("band", band)
    placed = written(placed, "shingle-placed")
    parts = placed.groupBy("home", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_SETS), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("parts")).where("parts > 1")
    parts = written(parts, "shingle-parts")
    tile = F.concat_ws("/", "home", "band", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    tiled = placed.join(if_small(parts), ["home", "band"], "left").withColumn("tile", tile)
    out = written(tiled.join(sets.select("id", "bits"), "id").select("tile", "id", "n", "band", "copies", "s", "bits"), "shingle-tiled")
    discard(placed, parts)
    return out


def _tile_pairs(tiled: DataFrame) -> DataFrame:
    """Tiles that share a shingle of a long run, and whose sizes allow a link."""
    meets = tiled.select("tile", "band", F.explode("s").alias("s")).groupBy("tile", "band", "s").agg(F.count(F.lit(1)).alias("n"))
    a, b = (meets.select("s", *[F.col(c).alias(f"{c}_{t}") for c in ("tile", "band", "n")]) for t in "ab")
    return a.join(b, "s").where("(tile_a < tile_b OR tile_a = tile_b AND n_a > 1) AND abs(band_a - band_b) <= 1").select("tile_a", "tile_b").distinct()


def _met(pairs: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pairs of tile names (a stored table) with the contents of both. The pairs of a tile with more than HUB of them are spread over several tasks, which all get it."""
    stored = pairs
    for t in "ab":
        name = f"tile_{t}"
        hubs = if_small(written(stored.groupBy(name).agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("hub")).where("hub > 1"), "shingle-hubs"))
        of = F.coalesce("hub", F.lit(1))
        spread = pairs.join(hubs, name, "left").withColumn("part", F.pmod(F.xxhash64("tile_a", "tile_b"), of).cast("int")).drop("hub")
        side = tiles.toDF(name, f"sets_{t}").join(hubs, name, "left").select(name, f"sets_{t}", F.explode(F.sequence(F.lit(0), of - 1)).alias("part"))
        pairs = spread.join(side, [name, "part"]).drop("part")
    return pairs


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], dict, dict]]:
    for batch in batches:
        for k in range(batch.num_rows):
            names = [batch.column(f"tile_{t}")[k].as_py() for t in "ab"]
            x = _unpacked(batch.column("sets_a")[k].values)
            yield names, x, x if names[0] == names[1] else _unpacked(batch.column("sets_b")[k].values)  # a tile's sets come in any order


def _unpacked(sets: pa.StructArray) -> dict:
    """A tile's sets: ids, sizes, parity maps folded to one length and, where they are there, numbers of copies and shingles."""
    column = {sets.type.field(i).name: c for i, c in enumerate(sets.flatten())}
    bits = [np.frombuffer(x, np.uint8) for x in column["bits"].to_pylist()]
    size = min(map(len, bits))
    out = {"id": column["id"].to_numpy(), "n": column["n"].to_numpy().astype(np.int64), "bits": np.stack([_folded(x, size) for x in bits])}
    if "shingles" in column:
        out["copies"] = column["copies"].to_numpy()
        out["shingles"] = [np.frombuffer(x, np.uint64) for x in column["shingles"].to_pylist()]
    return out


def _maybe(x: dict, y: dict, same: bool, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of two tiles that sizes and parity maps leave, some CHUNK bytes of maps at a time."""
    size = min(x["bits"].shape[1], y["bits"].shape[1])
    maps_x, maps_y = (np.stack([_folded(r, size) for r in t["bits"]]).view(np.uint64) for t in (x, y))
    rows = max(1, 8 * CHUNK // (size * len(y["id"])))
    for lo in range(0, len(x["id"]), rows):
        n_x, n_y = x["n"][lo : lo + rows, None], y["n"][None, :]
        near = den * np.minimum(n_x, n_y) >= num * np.maximum(n_x, n_y)
        if same:
            near &= (lo + np.arange(near.shape[0]))[:, None] < np.arange(near.shape[1])[None, :]
        i, j = np.nonzero(near)
        i += lo
        ok = _parity_allows(maps_x[i], maps_y[j], x["n"][i], y["n"][j], num, den)
        yield i[ok], j[ok]


def _promising(num: int, den: int):
    """Pairs of tiles that may hold a link, with the sets of those links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, x, y in _both(batches):
            hit_x, hit_y = np.zeros(len(x["id"]), bool), np.zeros(len(y["id"]), bool)
            for i, j in _maybe(x, y, names[0] == names[1], num, den):
                hit_x[i], hit_y[j] = True, True
            if hit_x.any():
                ids = np.unique(np.concatenate([x["id"][hit_x], y["id"][hit_y]]))
                yield pa.RecordBatch.from_arrays([*(pa.array([t]) for t in names), pa.array([ids])], ["tile_a", "tile_b", "ids"])

    return run


def _compare(num: int, den: int):
    """Of pairs of tiles: of each set how many documents its links there lead to (kind 1: a, n), and what joins the linked ones (kind 0: a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, x, y in _both(batches):
            i, j = (np.concatenate(side) for side in zip(*_maybe(x, y, names[0] == names[1], num, den), strict=True))
            both = _overlaps(x["shingles"], y["shingles"], i, j)
            ok = den * both >= num * (x["n"][i] + y["n"][j] - both)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            ids, at = np.unique(np.concatenate([x["id"][i], y["id"][j]]), return_inverse=True)
            u, v = at[: len(i)], at[len(i) :]
            others = np.bincount(u, weights=y["copies"][j], minlength=len(ids)) + np.bincount(v, weights=x["copies"][i], minlength=len(ids))
            root = _labels(len(ids), u, v)
            apart = np.flatnonzero(root != np.arange(len(ids)))
            yield _batch(
                {
                    "kind": np.repeat(np.array([1, 0], np.int32), [len(ids), len(apart)]), "a": np.concatenate([ids, ids[apart]]),
                    "b": np.concatenate([ids, ids[root[apart]]]), "n": np.concatenate([others.astype(np.int64), np.zeros(len(apart), np.int64)]),
                }
            )

    return run


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least place that links u - v reach from each of n places."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        for at in (u, v, label[u], label[v]):
            np.minimum.at(after, at, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _overlaps(sets_x: list[np.ndarray], sets_y: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common shingles of each pair of sets: one by one, or, of many pairs, by products of incidence matrices over 4096 shingles at a time."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(sets_x[a], sets_y[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    sides = []
    for sets, at in ((sets_x, i), (sets_y, j)):
        rows = np.unique(at)
        sides.append((rows, np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows]), np.concatenate([sets[r] for r in rows])))
    shared = np.intersect1d(sides[0][2], sides[1][2])
    out = np.zeros((len(sides[0][0]), len(sides[1][0])), np.float32)
    for lo in range(0, len(shared), 4096):
        part = shared[lo : lo + 4096]
        maps = []
        for rows, owner, s in sides:
            k = np.searchsorted(part, s)
            hit = part[np.minimum(k, len(part) - 1)] == s
            maps.append(np.zeros((len(rows), len(part)), np.float32))
            maps[-1][owner[hit], k[hit]] = 1
        out += maps[0] @ maps[1].T
    return out[np.searchsorted(sides[0][0], i), np.searchsorted(sides[1][0], j)].astype(np.int64)


# ---- whole sets


def _shingles(ids: DataFrame, members: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the given sets, built again from their whole texts; shingles are the bytes of their sorted hashes."""
    wanted = ids.join(members.select("id", "doc_id", "h1", "h2"), "id")
    texts = _among(docs, wanted).join(wanted, "doc_id").select("id", "h1", "h2", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_, x, y = (b.column(k).to_numpy() for k in ("id", "h1", "h2"))
            for row, sizes, flat in wordhash.shingle_sets(b.column("text"), width):
                h1, h2 = _signatures(flat, sizes)
                stop = np.cumsum(sizes)
                same = np.flatnonzero((h1 == x[row : row + len(sizes)]) & (h2 == y[row : row + len(sizes)]))
                ids, sets = id_[row + same], [flat[stop[k] - sizes[k] : stop[k]].tobytes() for k in same.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])

    out = written(texts.mapInArrow(build, "id long, shingles binary"), "shingle-whole")
    if out.groupBy("id").count().where("count > 1").isEmpty():
        return out
    once = written(out.dropDuplicates(["id"]), "shingle-whole")  # repeated rows
    discard(out)
    return once


def _among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs that may be among the wanted, by a bitmap of FILTER_BITS hashed ids: at most FILTER_BITS / 8 bytes are broadcast, whatever the input.

    It only keeps texts out of the shuffle that follows; a text let through by a shared bit is dropped there.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    maps = wanted.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    placed = docs.withColumns({"__bucket": F.bitmap_bucket_number(slot), "__bit": F.bitmap_bit_position(slot)})
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(__bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("CAST(__bit % 8 AS INT)")
    return placed.join(F.broadcast(maps), F.col("__bucket") == F.col("bucket")).where(F.getbit(byte, hit) == 1).select(*docs.columns)


def _verified(pairs: DataFrame, shingles: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    joined = pairs.join(shingles.toDF("a", "sa"), "a").join(shingles.toDF("b", "sb"), "b")
    return joined.mapInArrow(check, "a long, b long")


# ---- the join


def _grouped(docs: DataFrame, profile: DataFrame, width: int, num: int, den: int, sketch) -> tuple[DataFrame, DataFrame]:
    """The distinct sets (id, n, prefix, bits), and of each set (members) its group, the number m of sets in that, its smallest doc_id and its copies.

    A group is named by the smallest id of its sets.
    """
    rows = docs.where("doc_id IS NOT NULL").mapInArrow(_prefixes(width, num, den, sketch), "h1 long, h2 long, n int, g1 long, g2 long, prefix binary, bits binary")
    sets = written(rows.dropDuplicates(["h1", "h2"]).withColumn("id", F.monotonically_increasing_id()), "shingle-sets")
    classes = profile.where("kind = 0 AND n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    light = sets.select("id", "h1", "h2", "n", "g1", "g2")
    groups = light.groupBy("n", "g1", "g2").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = light.join(classes, ["h1", "h2"]).join(groups, ["n", "g1", "g2"], "left")
    members = members.select("id", "h1", "h2", "n", "doc_id", "copies", F.coalesce("gid", "id").alias("gid"), F.coalesce("m", F.lit(1)).alias("m"))
    return sets, written(members, "shingle-members")


def similar(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """Links documents whose shingle sets have den * common >= num * united, and returns each one's component and number of links.

    Sets hold the distinct shingles of `width` words (A to Z lower-cased) of the whole text; a shorter text is one shingle.
    A set's prefix holds its rarest shingles in one global order, so sets that can be similar share a shingle of their prefixes. Sets
    with the same size and prefix form a group, which is indexed once. Groups that share a short run of a shingle are paired behind
    size, prefix and position filters and expanded to their sets; what parity maps leave is verified. Sets in long runs, and those
    of groups with many sets, meet in tiles: those with a frequent shingle in common and similar sizes, compared tile by tile in
    memory, first by parity maps. All links are verified and counted; only counts and what joins the linked leaves a task.

    Columns: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (other documents, copies among them, that
    reach the threshold with this one). Null or empty texts have no shingles and link with nothing, nor does a row whose
    doc_id is null (its component_id is null). Repeated rows are equal sets. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    profile = written(docs.mapInArrow(_profile(width), f"kind int, doc_id {kind}, n long, h1 long, h2 long"), "shingle-profile")
    sketch = spark.sparkContext.broadcast(_sketch(profile))
    sets, members = _grouped(docs, profile, width, num, den, sketch)

    marked = members.where("m > 1").select("id", F.col("gid").alias("of"), (F.col("m") > SHORT_RUN).alias("wide"))
    indexed = sets.select("id", "n", "prefix").join(if_small(marked), "id", "left").where("of IS NULL OR of = id").select("id", "n", "prefix", F.coalesce("wide", F.lit(False)).alias("wide"))
    entries = indexed.mapInArrow(_entries(sketch), "s long, gid long, at long, spread int")
    dealt = entries.repartition(4 * tasks_for(spark), "s", "spread").sortWithinPartitions("s", "gid")
    found = written(dealt.mapInArrow(_first_round(num, den), "kind int, a long, b long"), "shingle-pairs")
    of = lambda t: members.where(F.col("m") <= SHORT_RUN).select(F.col("gid").alias(f"g{t}"), F.col("id").alias(t))
    across = found.where("kind = 0").select(F.col("a").alias("ga"), F.col("b").alias("gb")).distinct().join(of("a"), "ga").join(of("b"), "gb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    small = members.where(F.col("m").between(2, SHORT_RUN))
    inside = small.select("gid", F.col("id").alias("a")).join(small.select("gid", F.col("id").alias("b")), "gid").where("a < b").select("a", "b")
    pairs = written(_plausible(across.union(inside).distinct(), sets, num, den), "shingle-candidates")

    tiled = _tiled(found.where("kind = 1").select(F.col("a").alias("s"), F.col("b").alias("gid")), members, sets, sketch, num, den)
    meeting = written(_tile_pairs(tiled), "shingle-meeting")
    light = tiled.groupBy("tile").agg(F.collect_list(F.struct("id", "n", "bits")).alias("sets"))
    near = written(_met(meeting, light).mapInArrow(_promising(num, den), "tile_a string, tile_b string, ids array<long>"), "shingle-near")

    needed = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(near.select(F.explode("ids"))).distinct(), "shingle-needed")
    shingles = _shingles(needed, members, docs, width)
    first = written(_verified(pairs, shingles, num, den), "shingle-links")
    full = tiled.join(near.select(F.explode("ids").alias("id")).distinct(), "id").join(shingles, "id").groupBy("tile").agg(F.collect_list(F.struct("id", "n", "bits", "copies", "shingles")).alias("sets"))
    second = written(_met(near.select("tile_a", "tile_b"), full).mapInArrow(_compare(num, den), "kind int, a long, b long, n long"), "shingle-links")

    tile = lambda t: tiled.select(F.col("id").alias(t), F.col("tile").alias(f"of_{t}"))
    named = first.join(tile("a"), "a", "left").join(tile("b"), "b", "left").withColumns({"tile_a": F.least("of_a", "of_b"), "tile_b": F.greatest("of_a", "of_b")})
    both = F.col("of_a").isNotNull() & F.col("of_b").isNotNull()
    apart = named.where(~both).select("a", "b").union(named.where(both).join(meeting, ["tile_a", "tile_b"], "left_anti").select("a", "b"))  # tiles count the others
    copies = members.select(F.col("id").alias("b"), "copies")
    ends = apart.union(apart.select("b", "a")).join(copies, "b").select("a", F.col("copies").alias("n"))
    others = written(ends.union(second.where("kind = 1").select("a", "n")).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others")), "shingle-counts")

    roots = components(first.union(second.where("kind = 0").select("a", "b")))
    placed = members.join(roots, members["id"] == roots["node"], "left").join(others, "id", "left")
    placed = written(placed.select("h1", "h2", "doc_id", F.coalesce("root", "id").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "shingle-placed")
    discard(sets, members, found, pairs, tiled, meeting, near, needed, shingles, first, second, others, roots)
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = placed.join(least, "root").select("h1", "h2", "component_id", "n_links")
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return (
        profile.where("kind = 0")
        .join(component, ["h1", "h2"], "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(linkable, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.when(linkable, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        )
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest doc_id of each component, all columns as they are; of repeated rows one stays, rows without doc_id all do.

    Documents without words are in no group and stay. An empty table gives no rows.
    """
    rows = written(similar(docs, **options).where("doc_id IS NOT NULL"), "shingle-result")
    keep = rows.where("doc_id = component_id").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count(F.lit(1)).alias("kept_n"))
    stay = docs.where("doc_id IS NOT NULL").join(keep.select("kept_id"), F.col("doc_id") == F.col("kept_id"), "left_semi")
    if not keep.where("kept_n > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id", "text"])
    return stay.union(docs.where("doc_id IS NULL"))
