"""Toxic passages as maximal-scoring segments of token log-odds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import discard, written

#: Labelled documents that the model is fitted on at most, taken by a hash of their ids.
SAMPLE_DOCS = 20_000
#: Prior mass, as a share of all counted tokens, and the z that a token's log-odds must reach.
PRIOR_SHARE, LEAST_Z = 0.05, 3.0
#: What each token costs a segment, so that segments end.
DRIFT = 0.05
#: A segment is reported below this p-value, and a document predicted toxic from this score.
SIGNIFICANT, TOXIC = 0.01, 0.7
#: Lengths of stems, in characters.
STEMS = (3, 4, 5, 6, 7, 8)
_EULER = 0.5772156649015329
_TOP = 20.0

SEGMENT = "struct<first_token: long, end_token: long, score: double, p_value: double>"


def _vocabularies(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of a column of whole texts, in stretches: the first row, where each text's tokens begin and the last's end, each token's place in the stretch's vocabulary, and the vocabulary.

    Tokens are lower-cased runs between spaces and ASCII punctuation. The vocabulary has a column for each distinct token: its hash, and
    that of its first characters for each length in STEMS, 0 where it has no more. A text longer than a block comes in several stretches.
    """
    for row, data, at in wordhash.stretches(pc.utf8_lower(texts)):
        for part, places in [(data, at)] if len(at) > 2 else [(x, np.array([0, len(x)])) for x in list(wordhash.pieces(data)) or [data]]:
            whole, first, start, end = wordhash.words_of(part, places, punctuated=True)
            _, where, of = np.unique(whole, return_index=True, return_inverse=True)
            start, end = start[where], end[where]
            known = np.zeros((1 + len(STEMS), len(where)), np.uint64)
            known[0] = whole[where]
            head = (part & 0xC0) != 0x80
            letter = np.cumsum(head) - 1
            ends = np.append(np.flatnonzero(head), len(part))
            order = np.argsort(start)
            for k, length in enumerate(STEMS, 1) if len(where) else ():
                stop = ends[np.minimum(letter[start] + length, len(ends) - 1)]
                long = order[(stop < end)[order]]
                known[k, long] = wordhash.mix(wordhash.spanned(part, start[long], stop[long]) + np.uint64(length))
            yield row, first, of, known


def _by_text(stretches: Iterator[tuple[int, list]]) -> Iterator[tuple[int, list]]:
    """Puts the parts of each text together: (row, its parts) from (first row, a part of each text)."""
    row, held = 0, []
    for first, parts in stretches:
        for k, part in enumerate(parts):
            if held and first + k != row:
                yield row, held
                held = []
            row = first + k
            held.append(part)
    if held:
        yield row, held


def maximal_segments(at: np.ndarray, weight: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, in one pass, of a sequence that scores weight (of either sign) at the places `at` and -drift elsewhere.

    Returns (first place, end, score). Each candidate keeps the sum before it, the sum at its end and a link to the last earlier one with a
    lower sum before it; a new one is merged with those as long as that raises the score. The links keep the pass linear. Only places with a
    positive weight can begin or end a segment.
    """
    after = np.cumsum(weight) - drift * (at - np.arange(len(at)))
    up = np.flatnonzero(weight > 0)
    found: list[list[float]] = []
    for p, begin, total in zip(at[up].tolist(), (after - weight)[up].tolist(), after[up].tolist(), strict=True):
        item = [p, p + 1, begin, total, -1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= item[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= item[3]:
                item[4] = j
                found.append(item)
                break
            item = [found[j][0], item[1], found[j][2], item[3], -1]
            j, before = found[j][4], j
            del found[before:]
    return [(int(a), int(b), e - s) for a, b, s, e, _ in found]


@dataclass
class ToxicModel:
    """Weighted tokens and stems (sorted hashes), the extreme-value parameters of the best score by chance, and its map to a probability.

    A token weighs as the strongest of its own hash and its stems', for or against; one without any weighs nothing.
    """

    codes: np.ndarray
    weights: np.ndarray
    scale: float
    k: float
    intercept: float
    slope: float

    def weigh(self, known: np.ndarray) -> np.ndarray:
        """Weights of the tokens of a vocabulary."""
        if not len(self.codes) or not known.size:
            return np.zeros(known.shape[1])
        i = np.minimum(np.searchsorted(self.codes, known), len(self.codes) - 1)
        weight = np.where(self.codes[i] == known, self.weights[i], 0.0)
        return weight[np.abs(weight).argmax(axis=0), np.arange(known.shape[1])]

    def segments(self, weight: np.ndarray) -> list[tuple[int, int, float]]:
        at = np.flatnonzero(weight)
        return maximal_segments(at, weight[at] - DRIFT, DRIFT) if len(at) else []

    def read(self, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
        """Row, number of tokens and segments of each text of a column."""

        def weighed() -> Iterator[tuple[int, list]]:
            for row, first, of, known in _vocabularies(texts):
                yield row, np.split(self.weigh(known)[of], first[1:-1])

        for row, parts in _by_text(weighed()):
            weight = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield row, len(weight), self.segments(weight)

    def excess(self, score: float, n: int) -> float:
        """The score on the Gumbel scale, for a text of n tokens."""
        return self.scale * score - math.log(self.k * max(1, n))

    def p_value(self, score: float, n: int) -> float:
        return -math.expm1(-math.exp(-max(-50.0, min(self.excess(score, n), 50.0))))

    def probability(self, score: float, n: int) -> float:
        z = self.intercept + self.slope * max(-_TOP, min(self.excess(score, n), _TOP))
        return 1 / (1 + math.exp(-max(-50.0, min(z, 50.0))))


def _training(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """Labelled documents to learn from: at most SAMPLE_DOCS by a hash of their ids, equal texts once."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    if n > SAMPLE_DOCS:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # at most SAMPLE_DOCS rows of two numbers
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))  # repeated ids count once
    return written(sample.dropDuplicates(["text", "label"]), "toxic-sample")


def _counted(sample: DataFrame) -> DataFrame:
    def features(texts: pa.Array) -> Iterator[tuple[int, list]]:
        for row, first, of, known in _vocabularies(texts):
            yield row, [known[:, np.unique(x)].ravel() for x in np.split(of, first[1:-1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: dict[int, list[np.ndarray]] = {0: [], 1: []}
            labels = b.column("label").to_pylist()
            for row, many in _by_text(features(b.column("text"))):
                parts[1 if labels[row] else 0].append(np.unique(np.concatenate(many)))  # each document counts a token once
            for label, many in parts.items():
                if many:
                    code, n = np.unique(np.concatenate(many), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(np.full(len(code), label, np.int32)), pa.array(n.astype(np.int64))], ["code", "label", "n"])

    rows = sample.select("text", "label").mapInArrow(run, "code long, label int, n long")
    side = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"y{k}")
    return rows.groupBy("code").agg(side(0), side(1))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> ToxicModel:
    """Learns token weights and their calibration. `usable` tells, of a label's row, whether it may be learned from.

    A token's weight is its log-odds in toxic against other documents with an informative Dirichlet prior, for or against; those whose
    z is within LEAST_Z of 0 weigh nothing. The scale of chance scores solves sum(p * exp(scale * weight)) = 1 over the tokens of other documents;
    K follows from their observed best scores by the mean of a Gumbel variable. Without labels of both kinds nothing weighs.
    """
    sample = _training(docs, labels, F.lit(True) if usable is None else usable)
    counts = written(_counted(sample), "toxic-counts")
    counts_of = counts.where(F.col("code") != 0)
    n0, n1 = (x or 0 for x in counts_of.agg(F.sum("y0"), F.sum("y1")).first())
    prior = PRIOR_SHARE * (n0 + n1)
    codes, weights, chance = np.empty(0, np.uint64), np.empty(0), np.empty(0)
    if n0 and n1:
        a = F.lit(prior / (n0 + n1)) * (F.col("y0") + F.col("y1"))
        odds = lambda y, n: F.log((F.col(y) + a) / (F.lit(n + prior) - F.col(y) - a))
        weighed = counts_of.select("code", (odds("y1", n1) - odds("y0", n0)).alias("w"), F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a)).alias("sd"), ((F.col("y0") + a) / (n0 + prior)).alias("p"))
        z = F.abs(F.col("w") / F.col("sd"))
        kept = weighed.where(z >= LEAST_Z).toPandas()  # tokens of at most SAMPLE_DOCS documents
        code = kept["code"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(code)
        codes, weights, chance = code[order], kept["w"].to_numpy()[order], kept["p"].to_numpy()[order]
    scale = 1.0
    if len(codes):
        low, high = 1e-6, 50.0
        for _ in range(100):
            scale = (low + high) / 2
            over = float((chance * np.exp(np.minimum(scale * (weights - DRIFT), 700.0))).sum() + (1 - chance.sum()) * math.exp(-scale * DRIFT)) > 1
            low, high = (low, scale) if over else (scale, high)
    model = ToxicModel(codes, weights, scale, 1.0, 0.0, 0.0)
    best = _scored(sample.select("label", "text"), "label", model).select("label", "best", "n_tokens").toPandas()  # at most SAMPLE_DOCS rows
    label, score, n = best["label"].to_numpy(float), best["best"].to_numpy(float), np.maximum(1, best["n_tokens"].to_numpy(float))
    chance_hits = (label == 0) & (score > 0)
    if chance_hits.any():
        model.k = float(np.clip(math.exp((scale * score[chance_hits] - np.log(n[chance_hits])).mean() - _EULER), 1e-4, 1.0))
    x = np.clip(scale * score - np.log(model.k * n), -_TOP, _TOP)
    rate = (label.sum() + 1) / (len(label) + 2) if len(label) else 0.5
    beta = np.array([math.log(rate / (1 - rate)), 0.0])
    if len(codes) and 0 < label.sum() < len(label):
        design = np.stack([np.ones_like(x), x], axis=1)
        for _ in range(50):  # Newton steps of a one-variable logistic regression, lightly ridged
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (label - p) - 1e-3 * beta)
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
    model.intercept, model.slope = float(beta[0]), max(0.0, float(beta[1]))
    discard(sample, counts)
    return model


def _scored(docs: DataFrame, keep: str, model: ToxicModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            sizes, bests, scores, segments = [], [], [], []
            for _, n, found in m.read(b.column("text")):
                top = max((s for _, _, s in found), default=0.0)
                sizes.append(n)
                bests.append(top)
                scores.append(m.probability(top, n))
                tested = [(i, j, s, m.p_value(s, n)) for i, j, s in found]
                segments.append([dict(zip(("first_token", "end_token", "score", "p_value"), x, strict=True)) for x in tested if x[3] < SIGNIFICANT])
            kind = pa.list_(pa.struct([("first_token", pa.int64()), ("end_token", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))
            arrays = [b.column(keep), pa.array(sizes, pa.int64()), pa.array(bests, pa.float64()), pa.array(scores, pa.float64()), pa.array(segments, kind)]
            yield pa.RecordBatch.from_arrays(arrays, [keep, "n_tokens", "best", "score", "segments"])

    kind = docs.schema[keep].dataType.simpleString()
    return docs.select(keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{keep} {kind}, n_tokens long, best double, score double, segments array<{SEGMENT}>")


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, n_tokens, best, score (0 to 1) and every significant toxic passage, of each whole text.

    Null and empty texts have no tokens and score as a text without a segment. Repeated rows stay; an empty table gives no rows;
    labels, languages and sources are not looked at, and other columns are ignored.
    """
    return _scored(docs, "doc_id", model)


def fold(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 3. Fold 1 is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 3


def toxic_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages for all documents, learned from the labels of folds 0 and 2."""
    model = fit(docs, labels, usable=fold(F.col("doc_id")) != 1)
    rows = score_toxicity(docs, model)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("segments").cast("long").alias("n_passages"))


def without_toxic(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The documents that score below TOXIC, all columns as they are. A document without text stays, repeated rows stay or go alike; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            keep = [m.probability(max((s for _, _, s in found), default=0.0), n) < TOXIC for _, n, found in m.read(b.column("text"))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
