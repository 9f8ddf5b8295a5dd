import math
import zlib

import numpy as np
import pytest

from lettermill.llm.mixing import apportion, mix, mixed_documents, shard_quotas, source_plan, takes, targets_for
from lettermill.llm.sharding import assign_shards


def brute_capacity(sizes, shards):
    """The smallest capacity by trying them all."""
    for capacity in range(max(sizes), sum(sizes) + 1):
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= shards:
            return capacity


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, size string")


@pytest.mark.parametrize("hot", [0, 400])
def test_shards(spark, hot):
    rows = [(i, "wort " * (i * 7 % 23) + str(i % 150), "s", "x", "y") for i in range(600)] + [(1000 + i, "gleich " * 5, "s", "x", "y") for i in range(hot)]
    rows += [(2000, None, "s", "x", "y"), (2001, "", "s", "x", "y"), (None, "ohne", "s", "x", "y"), (5, "wort " * 12 + "5", "s", "x", "y"), (2002, "lang " * 400, None, None, None)]
    got = assign_shards(docs_of(spark, rows), shards=7).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    text = {}
    for i, t, *_ in rows:
        text.setdefault(i, t)
    for r in got:
        t = text[r.doc_id]
        assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode())
    of_text = {}
    for r in got:
        of_text.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    load = [0] * 7
    for k in range(7):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
        load[k] = sum(r.size for r in got if r.shard == k)
    group = {}
    for r in got:
        group[text[r.doc_id]] = group.get(text[r.doc_id], 0) + r.size
    large = max(group.values())
    even = sum(load) / 7
    assert max(load) <= max(large, even + sorted(group.values())[-2 if hot else -1]) and min(load) > 0


def test_smallest_capacity(spark):
    import hashlib

    rows = [(i, "a" * (i * 37 % 91) + f"{i:03d}", "s", "", "") for i in range(120)]
    got = assign_shards(docs_of(spark, rows), shards=5).collect()
    sizes = [len(t) + 8 for _, t, *_ in sorted(rows, key=lambda r: hashlib.sha256(r[1].encode()).hexdigest())]
    assert max(sum(r.size for r in got if r.shard == k) for k in range(5)) == brute_capacity(sizes, 5)


def test_empty_tables(spark):
    empty = docs_of(spark, [])
    assert assign_shards(empty).count() == 0 and mix(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_targets_and_quotas():
    assert targets_for([100, 100, 100], [5, 2, 1]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    votes = [5301.0, 2440.0, 1123.0, 16.0]
    held = [0] * 4
    for _ in range(93):  # seat by seat
        i = max(range(4), key=lambda k: (votes[k] / (2 * held[k] + 1), -k))
        held[i] += 1
    assert apportion(votes, 93) == held
    quotas = shard_quotas(votes, 93, 6, [93] * 4)
    assert [sum(q[i] for q in quotas) for i in range(4)] == held and min(map(min, quotas)) >= 0
    assert sum(apportion(votes, 50, [5, 50, 50, 50])) == 50 and apportion([0.0], 3) == [0] and apportion([], 3) == []


def test_mix(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 97)), ["a", "b", "c", None][i % 4 if i % 3 else 0], "", "") for i in range(900)] + [(7, None, "b", "", ""), (8, "w8x0", "b", "", "")]
    docs = docs_of(spark, rows)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    source = {}
    for i, t, s, *_ in rows:
        source.setdefault((i, len((t or "").split())), s)
    for r in got:
        s = source[r.doc_id, r.size]
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
        target[s] = (r.target, r.source_size)
        assert 0 <= r.taken <= 2 * r.size
    want = targets_for([sizes[s] for s in ("a", "b", "c", None)], [5, 2, 1, 5])
    for s, w in zip(("a", "b", "c", None), want, strict=True):
        assert math.isclose(target[s][0], w) and target[s][1] == sizes[s] and abs(taken[s] - w) <= 0.02 * w + 130
    assert sorted(map(tuple, mix(docs).collect())) == sorted(map(tuple, got))
    whole = {}
    for r in mixed_documents(docs).collect():
        whole[r.doc_id] = whole.get(r.doc_id, 0) + len(r.text.split())
    by_id = {}
    for r in got:
        by_id[r.doc_id] = by_id.get(r.doc_id, 0) + r.taken
    assert whole == {k: v for k, v in by_id.items() if v}


def test_each_shard_meets_its_quotas(spark):
    """Every shard has the blocks that its quotas give it, in the counts and in the texts; a plain walk over the picks says which."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 97)), ["a", "b", "c", None][i % 4 if i % 3 else 0], "", "") for i in range(500)]
    docs = docs_of(spark, rows)
    got = mix(docs, block=16, shards=5).collect()
    words = {}
    for r in got:
        assert r.taken == sum(w.words for w in r.shard_words) and len({w.shard for w in r.shard_words}) == len(r.shard_words)
        for w in r.shard_words:
            words[rows[r.doc_id][2], w.shard] = words.get((rows[r.doc_id][2], w.shard), 0) + w.words
    sized = docs.selectExpr("source", "CAST(regexp_count(text, '[^ ]+') AS BIGINT) AS size")
    plan = {p["source"]: p for p in source_plan(sized, block=16, shards=5)}
    for (source, shard), n in words.items():
        assert abs(n - 16 * plan[source]["quotas"][shard]) <= 16 * 2  # but for the source's last, shorter block
    for shard in range(5):
        total = sum(n for (_, k), n in words.items() if k == shard)
        for source in ("a", "b", "c", None):
            assert abs(words[source, shard] / total - plan[source]["target"] / sum(p["target"] for p in plan.values())) < 0.03
    in_texts = {}
    for r in mixed_documents(docs, block=16, shards=5, shard="of_shard").collect():
        in_texts[r.source, r.of_shard] = in_texts.get((r.source, r.of_shard), 0) + len(r.text.split())
    assert in_texts == words


def test_takes_against_a_plain_walk():
    rnd = np.random.default_rng(6)
    size = rnd.integers(0, 40, 60)
    start = np.cumsum(size) - size
    total = int(size.sum())
    blocks = -(-total // 8)
    ends = np.array([blocks // 3, blocks // 3 + 1, blocks + 5, 2 * blocks - 7])
    a, c = next(k for k in range(20, 99) if math.gcd(k, blocks) == 1), 11
    want = {}
    for pick in range(int(ends[-1])):
        t, k = divmod(pick, blocks)
        b = k if t < ends[-1] // blocks else next(b for b in range(blocks) if (a * b + c) % blocks == k)
        shard = next(s for s, e in enumerate(ends) if pick < e)
        for w in range(b * 8, min(total, b * 8 + 8)):
            want[w, t] = shard
    n = len(size)
    got = takes(start, size, np.full(n, blocks), np.full(n, a), np.full(n, c), np.tile(ends, (n, 1)), 8)
    found = {}
    for row, t, shard, lo, hi in zip(*(got[k].tolist() for k in ("row", "time", "shard", "first", "end")), strict=True):
        for w in range(start[row] + lo, start[row] + hi):
            assert (w, t) not in found
            found[w, t] = shard
    assert found == want


def test_mix_with_clashing_names(spark):
    columns = "doc_id long, text string, source string, size long, __start string, __row int, start string, n_chars int"
    docs = spark.createDataFrame([(i, "a b c d e f" if i % 3 else None, "s", 5, "x", 6, "y", 11) for i in range(30)] + [(None, "a b", None, 1, "", 2, "", 3)], columns)
    out = mixed_documents(docs)
    assert out.schema == docs.schema and {r.source for r in out.collect()} <= {"s", None} and all(r.text and r.n_chars == len(r.text) for r in out.collect())
    assert mix(docs).count() == 31


def test_many_small_sources(spark):
    """Sources smaller than a block come near their targets too, in counts and in texts."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(7)), f"s{i:03}", "", "") for i in range(200)]
    rows += [(1000 + i, " ".join(f"v{i}x{k}" for k in range(65 * (i + 1))), f"t{i}", "", "") for i in range(4)] + [(2000, "ein", "u", "", ""), (2001, "", "leer", "", ""), (2002, None, "nichts", "", "")]
    docs = docs_of(spark, rows)
    got = mix(docs).collect()
    assert sum(r.taken for r in got if r.size == 7) == pytest.approx(sum(r.target for r in got if r.size == 7), rel=0.05)
    for r in got:
        assert abs(r.taken - r.target) <= max(1, -(-r.source_size // 16)) and r.taken <= 2 * r.size, r
    taken = {r.doc_id: r.taken for r in got}
    for block in (64, 512):
        words = {}
        for r in mixed_documents(docs, block=block).collect():
            words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert all(abs(words.get(r.doc_id, 0) - r.target) <= max(1, -(-r.source_size // 16)) for r in got)
        assert block != 64 or words == {k: n for k, n in taken.items() if n}
