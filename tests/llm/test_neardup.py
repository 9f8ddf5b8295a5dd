import itertools
import math
import random

import numpy as np
import pyarrow as pa

from lettermill.llm.components import components
from lettermill.llm.neardup import near_duplicates
from lettermill.llm.ngram_join import one_of_each, similar


def union(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_components(spark):
    random.seed(3)
    links = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(random.randrange(100, 160), random.randrange(100, 160)) for _ in range(40)] + [(200, 200), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    rnd = random.Random(5)
    base = [[rnd.gauss(0, 1) for _ in range(24)] for _ in range(40)]
    rows = []
    for i in range(400):
        b = base[i % 40]
        scale = rnd.choice([0, 0, 0.02, 0.15, 0.2, 0.25])
        rows.append((i, [x + rnd.gauss(0, scale) if scale else x * 2 for x in b] if i % 7 else [rnd.gauss(0, 1) for _ in range(24)], i % 3 if i % 11 else None, "x"))
    rows += [(900, None, 1, "x"), (901, [0.0] * 24, 1, "x"), (902, [float("nan")] + [1.0] * 23, 1, "x"), (903, [None] + [1.0] * 23, 1, "x"), (904, [], 1, "x"), (905, base[1], 1, "x"), (906, [1.0, 2.0], 1, "x"), (907, [2.0, 4.0], 1, "x"), (908, [float("inf")] * 24, 1, "x"), (None, base[2], 2, "x")]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string"), tile=64).collect()}
    good = {i: v for i, v, lab, _ in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    label = {i: lab for i, _, lab, _ in rows}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    links = [(a, b) for a, b in itertools.combinations(good, 2) if label[a] == label[b] and len(good[a]) == len(good[b]) and cos(good[a], good[b]) >= 0.98]
    want = union([r[0] for r in rows if r[0] is not None], links)
    count = dict.fromkeys(want, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert len(links) > 50 and len(got) == len(rows)
    for i in want:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], want[i], want[i] == i), i
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_one_label_has_most_vectors(spark):
    """A label with far more vectors than its first axis can tell apart: tiles are cut along further axes, and links are those of brute force."""
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(30, 12)) * [0.001, *[1.0] * 11]
    x = centres[rnd.integers(0, 30, 900)] + rnd.normal(size=(900, 12)) * rnd.choice([0.0, 0.05, 0.15], (900, 1))
    label = np.where(rnd.random(900) < 0.9, 7, 8)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    got = near_duplicates(spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int"), tile=32).collect()
    want = union(range(900), np.argwhere(np.triu(link, 1)).tolist())
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(link[i].sum()) - 1, want[i]) for i in range(900)}


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_join(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    common = rnd.sample(words, 40)
    rows = []
    for i in range(260):
        w = rnd.sample(words, rnd.randrange(20, 90))
        rows.append((i, " ".join(w + (common if i % 3 == 0 else [])), "e"))
    near = rnd.sample(words, 80)
    for i in range(120):  # one large group of near copies, some of them too far off
        w = near[:]
        for _ in range(rnd.choice([0, 1, 2, 3, 5])):
            w[rnd.randrange(80)] = rnd.choice(words)
        rows.append((1000 + i, "  ".join(w).upper() if i % 2 else "\n".join(w), "e"))
    lines = [" ".join(rnd.sample(words, 8)) for _ in range(12)]
    rows += [(2000 + i, "\n".join(rnd.sample(lines, 6)), "e") for i in range(60)]  # nothing but common lines
    rows += [(3000, None, "e"), (3001, "", "e"), (3002, " \n", "e"), (3003, "a b", "e"), (3004, "A  b", "e"), (3005, "a b c", "e"), (3006, "ä b c d e f", "e"), (5, rows[5][1], "e"), (None, "a b", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union(list(sets), links)
    got = similar(docs).collect()
    assert len(got) == len(rows) and len(links) > 100
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r.doc_id
    left = [r.doc_id for r in one_of_each(docs).collect()]
    assert sorted(x for x in left if x is not None) == sorted(i for i in want if want[i] == i) and left.count(None) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similar(empty).count() == 0 and one_of_each(empty).count() == 0


def test_every_link_is_counted(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    near = rnd.sample(words, 80)
    rows = [(i, " ".join(rnd.sample(words, 40)), "e") for i in range(60)]
    for i in range(90):  # a large group with long runs, some of it copies
        w = near[:]
        for _ in range(rnd.choice([0, 1, 2, 3])):
            w[rnd.randrange(80)] = rnd.choice(words)
        rows.append((100 + i, " ".join(w), "e"))
    for i in range(20):  # small groups, and such whose first half is in long runs
        w = (near[:40] if i % 2 else []) + rnd.sample(words, 60)
        rows += [(1000 + 10 * i + k, " ".join(w[: len(w) - k]), "e") for k in range(4)]
    rows += [(3000, None, "e"), (3001, "a b", "e"), (3002, "A b", "e")]
    sets = {i: shingles(t) for i, t, _ in rows}
    count = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            count[a] += 1
            count[b] += 1
    got = {r.doc_id: r.n_links for r in similar(spark.createDataFrame(rows, "doc_id long, text string, n_links string")).collect()}
    assert got == count and max(count.values()) > 20


def test_dense_tiles_need_little_memory():
    """Two thousand near copies of 768 dimensions, of which nearly all pairs link, and a forest that joins what all links join."""
    import tracemalloc

    from lettermill.llm import neardup

    rnd = np.random.default_rng(5)
    raw = rnd.normal(size=768) + rnd.normal(size=(2000, 768)) * np.where(np.arange(2000) % 2, 0.05, 0.12)[:, None]
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    side = {"cls": np.arange(2000).tobytes(), "n": np.ones(2000, np.int64).tobytes(), "raw": raw.tobytes(), "turned": unit.tobytes(), "tile": "x"}
    batch = pa.RecordBatch.from_pylist([{f"{k}_{s}": v for k, v in side.items() for s in "ab"}])
    tracemalloc.start()
    (out,) = neardup._compare(0.98, 768)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    linked = np.triu(unit @ unit.T >= 0.98, 1)
    rows = out.to_pandas()
    counts = rows[rows.kind == 0].groupby("a")["n"].sum()
    assert np.array_equal(counts.reindex(range(2000), fill_value=0).to_numpy(), (linked.sum(axis=0) + linked.sum(axis=1)))
    assert linked.sum() > 1_000_000 and (rows.kind == 1).sum() < 4000
    both = linked | linked.T
    seen, todo = {0}, [0]
    edges = rows[rows.kind == 1]
    near = {i: set() for i in range(2000)}
    for x, y in zip(edges.a, edges.b, strict=True):
        near[x].add(y)
        near[y].add(x)
    while todo:
        for y in near[todo.pop()] - seen:
            seen.add(y)
            todo.append(y)
    want, todo = {0}, [0]
    while todo:
        for y in set(np.flatnonzero(both[todo.pop()]).tolist()) - want:
            want.add(y)
            todo.append(y)
    assert seen == want


def test_forests_of_sparse_links():
    from lettermill.llm import neardup

    rnd = np.random.default_rng(6)
    for _ in range(50):
        linked = rnd.random((rnd.integers(1, 12), rnd.integers(1, 12))) < 0.15
        u, v = neardup._forest(linked)
        assert linked[u, v].all()

        def groups(pairs, shape=linked.shape):
            root = list(range(sum(shape)))
            for x, y in pairs:
                p, q = root[x], root[shape[0] + y]
                root = [p if r == q else r for r in root]
            return {tuple(i for i, r in enumerate(root) if r == k) for k in set(root)}

        every = list(zip(*np.nonzero(linked), strict=True))
        assert groups(zip(u, v, strict=True)) == groups(every) and len(u) == sum(linked.shape) - len(groups(every))
