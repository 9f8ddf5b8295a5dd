"""Near-duplicate embeddings: PCA-ordered tiles, suffix-norm bounds and an exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import if_small, tasks_for, written
from .components import components

#: Vectors in a tile, leading dimensions compared first, and bins of the first principal axis.
TILE, LEAD, BINS = 1024, 16, 512
#: Principal axes along which tiles are cut, and along which they find their neighbours.
CUT_AXES, CELL_AXES = 6, 2
#: Bytes of numbers that pairs are worked out with at a time, however many pairs two tiles have.
PAIRS_BYTES = 32 << 20
#: Rounding that the bounds allow for; the check that decides works on the given vectors in double precision.
SLACK = 1e-9


def _moments(vectors: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """Sum of x x^T over unit vectors, added up by Spark: dims * dims numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dims, dims)), 0
        for b in batches:
            x = _matrix(b.column("unit"), dims)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims + 1)), pa.array(np.append(total.ravel(), n))], ["at", "x"])

    got = vectors.select("unit").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")["x"].to_numpy()
    return (got[:-1].reshape(dims, dims), int(got[-1])) if len(got) else (np.eye(dims), 0)


def _matrix(column, dims: int) -> np.ndarray:
    """Vectors stored as the bytes of their doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _rotated(vectors: DataFrame, axes: np.ndarray, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(_matrix(b.column("unit"), dims) @ axes)
            rows = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("cls"), b.column("n"), b.column("raw"), pa.array(rows, pa.binary()), pa.array(list(x[:, :CUT_AXES].copy()), pa.list_(pa.float64()))], ["label", "cls", "n", "raw", "turned", "axes"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("label", "cls", "n", "raw", "unit").mapInArrow(run, f"label {kind}, cls long, n long, raw binary, turned binary, axes array<double>")


def _tile_pairs(tiles: DataFrame, reach: float) -> DataFrame:
    """Tiles of one label whose boxes come within reach along the leading axes together.

    They meet in cells as wide as the reach along the first axes, a box and what is around it, so one label's pairs are found in many tasks.
    """
    width = max(reach, 1.0 / 64)
    cells = lambda lo, hi, k, more: F.sequence(F.floor((F.element_at(lo, k) - more) / width), F.floor((F.element_at(hi, k) + more) / width))
    axes = range(1, CELL_AXES + 1)

    def side(t: str, more: float) -> DataFrame:
        out = tiles.select("label", *[F.col(c).alias(f"{c}_{t}") for c in ("tile", "lo", "hi")])
        for k in axes:
            dims = F.size(f"lo_{t}")
            out = out.withColumn(f"cell{k}", F.explode(F.when(dims >= k, cells(F.col(f"lo_{t}"), F.col(f"hi_{t}"), k, more)).otherwise(F.array(F.lit(0).cast("long")))))
        return out

    gap = F.aggregate(
        F.zip_with(F.arrays_zip("lo_a", "hi_a"), F.arrays_zip("lo_b", "hi_b"), lambda x, y: F.greatest(F.lit(0.0), x["lo_a"] - y["hi_b"], y["lo_b"] - x["hi_a"])),
        F.lit(0.0), lambda acc, g: acc + g * g,
    )
    both = side("a", 0.0).join(side("b", reach + SLACK), ["label", *[f"cell{k}" for k in axes]])
    return both.where((F.col("tile_a") <= F.col("tile_b")) & (gap <= (reach + SLACK) ** 2)).select("label", "tile_a", "tile_b").distinct()


def _linked_rows(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which vectors of a block link with which of the other side: a matrix of truth values.

    The leading dimensions are multiplied first; pairs whose bound reaches the threshold get further dimensions a few at a time, PAIRS_BYTES of
    them together. Where most pairs are left the block is multiplied whole, and only pairs within SLACK of the threshold are looked at singly.
    """
    dims = a.shape[1]
    lead = min(LEAD, dims)
    head = a[:, :lead] @ b[:, :lead].T
    near = head + np.outer(np.linalg.norm(a[:, lead:], axis=1), np.linalg.norm(b[:, lead:], axis=1)) >= threshold - SLACK
    i, j = np.nonzero(near)
    norm_a, norm_b = np.sqrt(np.einsum("ij,ij->i", raw_a, raw_a)), np.sqrt(np.einsum("ij,ij->i", raw_b, raw_b))
    chunk = max(1, PAIRS_BYTES // (8 * dims))
    if 8 * len(i) > near.size:
        cos = raw_a @ raw_b.T
        cos /= norm_a[:, None]
        cos /= norm_b
        linked = near & (cos >= threshold)
        i, j = np.nonzero(near & (np.abs(cos - threshold) <= SLACK))
    else:
        linked = np.zeros(near.shape, bool)
        kept = [(i[k : k + chunk], j[k : k + chunk]) for k in range(0, len(i), chunk)]
        for at in range(lead, dims, LEAD):
            stop = min(dims, at + LEAD)
            rest_a, rest_b = np.linalg.norm(a[:, stop:], axis=1), np.linalg.norm(b[:, stop:], axis=1)
            for k, (x, y) in enumerate(kept):
                part = head[x, y] + np.einsum("ij,ij->i", a[x, lead:stop], b[y, lead:stop])
                still = part + rest_a[x] * rest_b[y] >= threshold - SLACK
                kept[k] = x[still], y[still]
        i, j = (np.concatenate([pair[k] for pair in kept]) if kept else i for k in (0, 1))
    for k in range(0, len(i), chunk):
        x, y = i[k : k + chunk], j[k : k + chunk]
        linked[x, y] = np.einsum("ij,ij->i", raw_a[x], raw_b[y]) / (norm_a[x] * norm_b[y]) >= threshold
    return linked


def _compare(threshold: float, dims: int):
    """Of pairs of tiles: for each vector the vectors it links with (kind 0: a, n) and links enough to join what is linked (kind 1: a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                ids_a, ids_b = (np.frombuffer(row[f"cls_{s}"], np.int64) for s in "ab")
                n_a, n_b = (np.frombuffer(row[f"n_{s}"], np.int64) for s in "ab")
                a, b = (np.frombuffer(row[f"turned_{s}"], np.float64).reshape(-1, dims) for s in "ab")
                raw_a, raw_b = (np.frombuffer(row[f"raw_{s}"], np.float64).reshape(-1, dims) for s in "ab")
                block = max(1, PAIRS_BYTES // (8 * len(b)))
                linked = np.concatenate([_linked_rows(a[x : x + block], b, raw_a[x : x + block], raw_b, threshold) for x in range(0, len(a), block)])
                if row["tile_a"] == row["tile_b"]:
                    linked &= np.tri(len(a), len(b), -1, dtype=bool).T  # each pair once
                count_a, count_b = linked @ n_b, n_a @ linked
                one, two = np.flatnonzero(count_a), np.flatnonzero(count_b)
                u, v = _forest(linked)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([0, 1], np.int32), [len(one) + len(two), len(u)])),
                        pa.array(np.concatenate([ids_a[one], ids_b[two], ids_a[u]])),
                        pa.array(np.concatenate([np.zeros(len(one) + len(two), np.int64), ids_b[v]])),
                        pa.array(np.concatenate([count_a[one], count_b[two], np.zeros(len(u), np.int64)])),
                    ],
                    ["kind", "a", "b", "n"],
                )

    return run


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between two sides, those that a spanning forest keeps, fewer than there are vectors: each group is walked from one side to the other and back."""
    rows_left, columns_left = linked.any(axis=1), linked.any(axis=0)
    u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while rows_left.any():
        rows = np.array([int(np.argmax(rows_left))])
        rows_left[rows] = False
        while len(rows):
            columns = np.flatnonzero(linked[rows].any(axis=0) & columns_left)
            if not len(columns):
                break
            columns_left[columns] = False
            u.append(rows[np.argmax(linked[np.ix_(rows, columns)], axis=0)])
            v.append(columns)
            rows = np.flatnonzero(linked[:, columns].any(axis=1) & rows_left)
            rows_left[rows] = False
            u.append(rows)
            v.append(columns[np.argmax(linked[np.ix_(rows, columns)], axis=1)] if len(rows) else rows)
    return np.concatenate(u), np.concatenate(v)


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """Links vectors of one label whose cosine reaches the threshold.

    Equal vectors form one class. Vectors are turned to their principal axes and cut into tiles along the first, full ones along further axes; tiles farther
    apart than sqrt(2 - 2 * threshold) are never compared. In a pair of tiles the leading dimensions are multiplied first; with the norms of
    what follows they bound the cosine, and only pairs that can still reach the threshold go on. Links are counted, and a spanning
    forest of them is kept, so neither tasks nor tables hold all pairs.

    Columns: vec_id, n_links, component_id (smallest vec_id reachable), kept. Vectors that are null, empty, zero or not finite, or whose
    label is null, link with nothing; vectors of different lengths never link. Repeated rows are vectors of their own that
    link with each other; a row whose vec_id is null is returned with a null component and kept false. An empty table gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    usable = (
        F.col("label").isNotNull() & (F.coalesce(F.size("x"), F.lit(0)) > 0) & F.col("vec_id").isNotNull()
        & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False))
    )
    plain = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    good = rows.where(usable).withColumn("cls_key", F.sha2(F.to_json(F.struct("label", F.transform("x", lambda v: v + 0.0).alias("x"))).cast("binary"), 256))
    good = written(good, "vectors")
    classes = written(good.groupBy("cls_key").agg(F.min("vec_id").alias("cls_id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("x").alias("x")), "vector-classes")
    sizes = [r[0] for r in classes.select(F.size("x")).distinct().collect()]  # the embeddings' lengths: one, as a rule
    classes = classes.withColumn("cls", F.xxhash64("cls_key"))
    found = None
    for dims in sorted(sizes):
        links = _linked(classes.where(F.size("x") == dims), dims, threshold, tile)
        found = links if found is None else found.union(links)
    if found is None:
        return plain
    found = written(found, "vector-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    roots = components(found.where("kind = 1").select("a", "b"))
    named = classes.select("cls_key", "cls", "cls_id", F.col("n").alias("copies")).join(counts, "cls", "left")
    named = named.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
    named = written(named, "vector-named")
    least = named.groupBy("root").agg(F.min("cls_id").alias("component_id"))
    of_class = named.join(least, "root").select("cls_key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), "component_id")
    linked = good.select("vec_id", "cls_key").join(of_class, "cls_key").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.union(plain)


def _linked(classes: DataFrame, dims: int, threshold: float, tile: int) -> DataFrame:
    spark = classes.sparkSession

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist(), np.float64).reshape(-1, dims)
            scaled = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
            unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            yield pd.DataFrame({"label": b["label"], "cls": b["cls"], "n": b["n"], "raw": [r.tobytes() for r in scaled], "unit": [r.tobytes() for r in unit]})

    kind = classes.schema["label"].dataType.simpleString()
    vectors = written(classes.select("label", "cls", "n", "x").mapInPandas(pack, f"label {kind}, cls long, n long, raw binary, unit binary"), "vector-units")
    moments, _ = _moments(vectors, dims)
    _, axes = np.linalg.eigh(moments)
    turned = written(_rotated(vectors, np.ascontiguousarray(axes[:, ::-1]), dims), "vector-turned")

    # along each axis in turn, what is still too full is cut where its running number of vectors passes a tile's; only equal stretches are cut by hash
    cut = turned.withColumn("tile", F.lit(""))
    for k in range(min(CUT_AXES, dims)):
        full = written(cut.groupBy("label", "tile").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > (0 if k == 0 else 2 * tile)), "vector-full")
        if full.isEmpty():
            break
        binned = cut.withColumn("bin", F.floor((F.element_at("axes", k + 1) + 1) / 2 * BINS).cast("int")).join(if_small(full), ["label", "tile"], "left")
        before = W.partitionBy("label", "tile").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        places = binned.where("held IS NOT NULL").groupBy("label", "tile", "bin").agg(F.count(F.lit(1)).alias("n"))
        places = places.select("label", "tile", "bin", F.when(F.col("n") > tile, F.concat(F.lit("="), "bin")).otherwise(F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / tile).cast("string")).alias("place"))
        placed = binned.join(if_small(written(places, "vector-places")), ["label", "tile", "bin"], "left")
        cut = placed.withColumn("tile", F.when(F.col("held").isNull(), F.col("tile")).otherwise(F.concat_ws("/", "tile", "place"))).drop("bin", "held", "place")
        cut = written(cut, "vector-cut")
    full = written(cut.groupBy("label", "tile").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts")).where("parts > 2"), "vector-full")
    tiled = cut.join(if_small(full), ["label", "tile"], "left").withColumn("tile", F.concat_ws("#", "tile", F.when(F.col("parts").isNotNull(), F.pmod("cls", "parts"))))
    tiled = tiled.select("label", "tile", "cls", "n", "raw", "turned")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows["turned"]), np.float64).reshape(-1, dims)[:, :LEAD]
        return pd.DataFrame(
            {
                "label": rows["label"].iloc[:1], "tile": rows["tile"].iloc[:1], "cls": [rows["cls"].to_numpy(np.int64).tobytes()], "n": [rows["n"].to_numpy(np.int64).tobytes()],
                "raw": [b"".join(rows["raw"])], "turned": [b"".join(rows["turned"])], "lo": [x.min(axis=0).tolist()], "hi": [x.max(axis=0).tolist()],
            }
        )

    tiles = written(tiled.groupBy("label", "tile").applyInPandas(join, f"label {kind}, tile string, cls binary, n binary, raw binary, turned binary, lo array<double>, hi array<double>"), "vector-tiles")
    pairs = _tile_pairs(tiles, float(np.sqrt(max(0.0, 2 - 2 * threshold))))
    side = lambda s: tiles.select(F.col("label"), *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "cls", "n", "raw", "turned")])
    both = pairs.repartition(4 * tasks_for(spark)).join(side("a"), ["label", "tile_a"]).join(side("b"), ["label", "tile_b"])
    return both.mapInArrow(_compare(threshold, dims), "kind int, a long, b long, n long")
