import base64
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lettermill.llm import bytepair
from lettermill.llm.bytepair import VOCABULARY, BytePairs, _codec, decoded, digests, encoded, merged
from lettermill.llm.centroids import Tree, clustered, with_inertia
from lettermill.llm.middle import SENTINELS, count_units, ends, fill_in_middle, restored
from lettermill.llm.wordhash import raw

TEXTS = [None, "", " ", "a", "abc", "ein Satz, mit Ämtern und 日本語 🤦🏽!", "x<P>y", "a <S> b", "<M>", "<P", "S><", "a\n\tb\r\n" * 40, "é" * 99, "wort " * 3000 + "ende", "gleich", "gleich", "<" * 50 + ">S<P" * 20]


def test_documents_with_their_middle_at_the_end(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS * 12)] + [(None, "ohne Nummer steht dies", "x", 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    got = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        text = texts[r.doc_id] or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        digest = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        parts = ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
        form = "plain" if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}", "spm": f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"}[form]
        want = (len(units), form, None if form == "plain" else len(parts[0]), None if form == "plain" else len(parts[1]), output, text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) == want
    assert fill_in_middle(docs.limit(0)).collect() == []
    assert {r.form for r in fill_in_middle(docs, transformed=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle(docs, transformed=100, suffix_first=100).collect()} == {"plain", "spm"}


def test_units_of_long_texts_are_never_held():
    import tracemalloc

    data = raw("wort Ä🤦 " * 300_000)
    tracemalloc.start()
    assert count_units(data) == 5 * 300_000
    assert list(ends(data, (0, 1, 3, 1_499_999))) == [0, 4, 7, len(data) - 1]
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()
    assert count_units(raw("a" * 5_000_000)) == 1 and count_units(raw(None)) == 0


@pytest.fixture(scope="module")
def oracle():
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(oracle):
    codec, rnd = _codec(VOCABULARY), random.Random(5)
    alphabet = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "\t", "1", "99", "'s", "'ll", "ä", "ß", "日", "本", "🤦", "́", " ", "　", ".", "--", "==", "\x00", "\x1c", "\x85", "<|endoftext|>", "й", "ع", "ก"]
    for _ in range(1500):
        text = "".join(rnd.choices(alphabet, k=rnd.randrange(0, 80)))
        ids = codec.encode(text)
        assert ids.tolist() == oracle.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()
    for text in ["a" * 5000, "ab" * 3000, " " * 4000, " " * 4000 + "x", "=" * 3001, "日" * 2000, "".join(rnd.choices("abcdefgh", k=9000))]:
        assert codec.encode(text).tolist() == oracle.encode_ordinary(text)


def test_all_characters_fall_into_the_pieces_of_the_library(oracle):
    codec = _codec(VOCABULARY)
    for k in range(0, 0x30000, 0x400):
        text = "".join(f"a{c}1{c}.{c} {c}" for c in map(chr, range(k, k + 0x400)) if not 0xD800 <= ord(c) < 0xE000)
        assert codec.encode(text).tolist() == oracle.encode_ordinary(text), hex(k)


def test_merges_against_a_plain_search():
    rnd = random.Random(3)
    for _ in range(400):
        ranks = {bytes([b]): b for b in range(256)}
        for _ in range(rnd.randrange(0, 25)):
            ranks.setdefault(b"".join(rnd.choices([x for x in ranks if x.strip(b"abc") == b"" and len(x) < 6], k=2)), len(ranks))
        piece = "".join(rnd.choices("abc", k=rnd.randrange(1, 60))).encode()
        parts = [piece[i : i + 1] for i in range(len(piece))] if piece not in ranks else [piece]
        while True:
            found = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if found is None:
                break
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        assert merged(piece, ranks) == [ranks[x] for x in parts]


def test_texts_to_ids_and_back(spark, oracle):
    long = " " * 300_000 + "Ende" + "\n" * 200_000 + "x" * 100_000
    rows = [(i, t, [1]) for i, t in enumerate(TEXTS)] + [(None, "ohne Nummer", [1]), (3, "a", [1]), (900, long, None)]
    got = decoded(encoded(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")))
    kept = got.collect()
    assert len(kept) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in kept:
        text = texts[r.doc_id] or ""
        assert bytes(r.decoded) == text.encode()
        assert r.doc_id == 900 or r.ids == oracle.encode_ordinary(text)
    ids = {r.doc_id: r for r in kept}
    for r in digests(got).collect():
        assert r.n_tokens == len(ids[r.doc_id].ids) and r.ids_sha256 == hashlib.sha256(np.array(ids[r.doc_id].ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert encoded(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    assert BytePairs(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).encode("").tolist() == []
    assert [r.decoded for r in decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [None]


def plain_clusters(rows, k, rounds, dims, scale=256):
    kept = [(i, [math.floor(scale * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1]))
    centres = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, z, strict=True)), c) for c, z in enumerate(centres))
    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, x in kept:
            own[near(x)[1]].append(x)
        centres = [[sum(col) // len(xs) for col in zip(*xs, strict=True)] if xs else z for xs, z in zip(own, centres, strict=True)]
    return sorted((str(i), *reversed(near(x))) for i, x in kept), centres


@pytest.mark.parametrize("block", [16384, 37])
def test_clusters_against_all_distances(spark, block):
    rnd = random.Random(8)
    dims, k = 6, 9
    heads = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(7)]
    rows = [(i, [v + rnd.gauss(0, 0.02) for v in rnd.choice(heads)]) for i in range(700)]
    rows += [(1000 + i, heads[0]) for i in range(300)] + [(i, rows[i][1]) for i in range(20)]  # many equal vectors, rows twice
    rows += [(2000 + i, [float(x) for x in np.eye(dims)[i % dims] * (-1) ** i]) for i in range(60)]  # many ties
    rows += [(None, heads[1]), (5000, None), (5001, []), (5002, heads[2][:-1]), (5003, [math.nan, *heads[2][1:]]), (5004, [math.inf, *heads[2][1:]]), (5005, [None, *heads[2][1:]])]
    rnd.shuffle(rows)
    data = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, cluster int")
    got, centres = clustered(data, k=k, dims=dims, block=block)
    want, plain = plain_clusters(rows, k, 5, dims)
    assert centres == plain
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    whole = with_inertia(got, centres).collect()
    assert {r.inertia for r in whole} == {sum(d for *_, d in want)}
    for r in whole:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, plain[r.cluster])).encode()).hexdigest()


def test_few_vectors_none_and_too_large_ones(spark):
    few = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got, centres = clustered(few, dims=2)
    assert len(centres) == 3 and {r.distance for r in got.collect()} == {0}
    assert with_inertia(*clustered(few, dims=3)).collect() == []
    nameless = with_inertia(*clustered(few.withColumn("vec_id", F.lit(None).cast("long")), dims=2)).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in nameless] == [(None, None, None)] * 3
    with pytest.raises(Exception, match="64 bits"):
        clustered(spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>"), dims=2)


def test_boxes_settle_most_vectors_of_apart_clusters():
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-256, 256, (40, 64))
    tree, order = Tree.over(centres[np.repeat(np.arange(40), 100)] + rnd.integers(-3, 4, (4000, 64)), leaf=16)
    assert sorted(order.tolist()) == list(range(4000))
    whole = sum(int(tree.end[n] - tree.first[n]) for n, square, _ in tree.groups(centres) if square is None)
    assert whole > 3000


def test_brief_pieces_merge_as_long_ones(monkeypatch):
    rnd = random.Random(8)
    ranks = {bytes([b]): b for b in range(256)}
    for _ in range(400):
        ranks.setdefault(bytes(rnd.choices(b"abc", k=rnd.randrange(2, 7))), len(ranks))
    pieces = [bytes(rnd.choices(b"abcd", k=n)) for n in range(1, bytepair.BRIEF + 1) for _ in range(5)]
    brief = [bytepair.merged(p, ranks) for p in pieces]
    monkeypatch.setattr(bytepair, "BRIEF", 0)
    assert brief == [bytepair.merged(p, ranks) for p in pieces]


def test_pieces_remembered_are_bounded(monkeypatch):
    monkeypatch.setattr(bytepair, "REMEMBERED", 10)
    ranks = {bytes([b]): b for b in range(256)}
    seen = bytepair._Pieces(ranks)
    for i in range(100):
        assert seen[f"x{i}"] == list(f"x{i}".encode()) and len(seen) <= 10
    assert seen["y" * 100] == [121] * 100 and "y" * 100 not in seen
