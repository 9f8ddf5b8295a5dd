import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettermill.llm import wordhash
from lettermill.llm.preference import conversations, format_preferences
from lettermill.llm.rules import POLICIES, ablations, judged, ledger, mask_of, measure
from lettermill.llm.surrogate import attempts_for, find, rewrite, surrogate, units, with_surrogates
from lettermill.llm.toxicity import ToxicModel, _vocabularies, fit, fold, maximal_segments, score_toxicity, toxic_verdicts, without_toxic

SPACES = r"[^\x20\x09-\x0D]+"


def test_rules_against_plain_counts(spark):
    texts = [None, "", "  \n", "a b c", "x " * 40, "eins zwei drei vier fünf sechs sieben acht neun zehn elf", "#*$ %&|<> wort\n" * 12, "zeile eins\n\nzeile eins\n zeile eins\nandere", "ä b 日本 🤦 x\x0by\x0cz" * 9, ("ein ganz normaler satz mit " + " ".join(f"w{i}" for i in range(300))), "Ab ab AB aB " * 9]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b c", "x"), (3, "a b c", "x")]
    got = judged(ledger(spark.createDataFrame(rows, "doc_id long, text string, kept string"))).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t for i, t, _ in rows if i == r.doc_id) or ""
        w = re.findall(SPACES, t)
        win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(win)
        cover = {k + j for k, x in enumerate(win) if n[x] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(SPACES, x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:30]
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and (not r.kept or not r.base_failed)
    led = ledger(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
    bits = [r.failures & mask_of(POLICIES[2]) for r in led.collect()]
    for r in ablations(led).collect():
        bit = mask_of((r["rule"],))
        assert (r.failed, r.only, r.kept_without) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))
    assert ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_segments_against_brute_force():
    rnd = random.Random(4)

    def plain(scores):  # the recursive definition: the best segment, then the same on both sides
        best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return []
        a, b = -best[2], -best[2] - best[1]
        return [*plain(scores[:a]), (a, b), *((x + b, y + b) for x, y in plain(scores[b:]))]

    for _ in range(60):
        n = rnd.randrange(1, 30)
        hits = sorted(rnd.sample(range(n), rnd.randrange(0, n + 1)))
        weight = [rnd.choice([0.31, 0.7, 1.13, 2.07]) + rnd.random() / 100 for _ in hits]
        scores = [-0.37] * n
        for i, w in zip(hits, weight, strict=True):
            scores[i] = w
        got = maximal_segments(np.array(hits, int), np.array(weight), 0.37)
        assert [(a, b) for a, b, _ in got] == plain(scores)
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for a, b, s in got)


def test_toxicity_on_held_out_documents(spark):
    rnd = random.Random(9)
    words, bad = [f"wort{i}" for i in range(800)], ["schuft", "lump", "ganove", "halunke"]
    rows, labels = [], []
    for i in range(900):
        w = rnd.choices(words, k=rnd.randrange(5, 120))
        toxic = i % 8 == 0
        if toxic:
            at = rnd.randrange(len(w))
            w[at:at] = [rnd.choice(bad) + rnd.choice(["", "en", "!"]) for _ in range(3 + len(w) // 20)]
        rows.append((i, " ".join(w), 1))
        labels.append((i, int(toxic)))
    rows += [(9000, None, 1), (9001, "", 1), (None, "schuft lump", 1)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxic_verdicts(docs, lab).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i, _ in labels if got[i].held_out]
    right = sum(got[i].predicted == dict(labels)[i] for i in held) / len(held)
    assert 0.25 < len(held) / len(labels) < 0.42 and right > 0.97
    model = fit(docs, lab, usable=fold(F.col("doc_id")) != 1)
    one = score_toxicity(spark.createDataFrame([(1, "wort1 " * 50 + "schuft lump ganove " + "wort2 " * 50)], "doc_id long, text string"), model).first()
    assert [(s.first_token, s.end_token) for s in one.segments] == [(50, 53)]
    kept = {r.doc_id for r in without_toxic(docs, model).collect()}
    assert {9000, 9001} <= kept and kept == {i for i, r in got.items() if not r.predicted}
    nothing = toxic_verdicts(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing.where("predicted = 1").count() == 0 and toxic_verdicts(spark.createDataFrame([], "doc_id long, text string"), lab).count() == 0


def test_surrogates(spark):
    texts = [
        "Mail an und.34@mail7.example.com oder UND.34@MAIL7.EXAMPLE.COM, IP 97.51.17.173 und 97.51.17.173.", "Karte 4845168114407329, keine Karte 7536784127813050 und 4845168114407320.", "Tel. +1 (017) 555-7713 oder +1 (018) 555-7713",
        'token = "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa" ende', "DE89 3704 0044 0532 0130 00 und Frau Müller, Herr Karl MÜLLER, Господин Иванов", "Nichts Privates: 12 Äpfel, Version 1.2.3, 2024-06-30.", None, "",
    ]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(texts)] + [(None, "a@b.example", 11, "x")], "doc_id long, text string, n_chars long, surrogate string")
    got = {r.doc_id: r for r in with_surrogates(docs, b"key", count="n").collect()}
    assert got[5].text == texts[5] and got[6].text is None and got[7].text == "" and (got[5].n, got[None].n) == (0, 1)
    for i, t in enumerate(texts):
        values = [t[a:b] for a, b, _, _ in find(t)]
        assert all(v not in got[i].text for v in values)
        new = find(got[i].text)
        assert [k for _, _, k, _ in new] == [k for _, _, k, _ in find(t)] and got[i].n == len(values)
    first = re.findall(r"\S+@\S+[a-z]|\S+@\S+[A-Z]", got[0].text)
    assert first[0].lower() == first[1].lower().rstrip(",") and first[0].endswith(".com")
    assert "7536784127813050" in got[1].text and "4845168114407320" in got[1].text
    phones = [got[2].text[a:b] for a, b, _, _ in find(got[2].text)]
    assert phones[0] != phones[1] and all(re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", p) for p in phones)
    frau, herr = re.search(r"Frau (\w+)", got[4].text)[1], re.search(r"Herr (\w+) (\w+)", got[4].text)
    assert herr[2] == frau.upper() and re.search("Господин [А-Я][а-я]+", got[4].text)
    assert got[0].n_chars == len(got[0].text) and with_surrogates(docs.limit(0), b"key").count() == 0
    assert rewrite("a@b.example", b"key", {})[0] != rewrite("a@b.example", b"other", {})[0]


def test_later_mentions_of_names():
    text = "Mr John Smith wrote. Smith said John's dog met SMITH and Smithson; a smith came. smith@a.example, Frau Meier: Meier"
    new, n = rewrite(text, b"key", {})
    m = re.match(r"Mr (\w+) (\w+) wrote\. (\w+) said (\w+)'s dog met (\w+) and Smithson; a smith came\. \S+@\S+, Frau (\w+): (\w+)$", new)
    assert m and (m[3], m[4], m[5], m[7]) == (m[2], m[1], m[2].upper(), m[6]) and n == 7
    assert not re.search(r"\b(John|Smith|SMITH|Meier)\b", new)
    assert rewrite("Smith and Meier", b"key", {}) == ("Smith and Meier", 0)


def test_surrogates_stay_distinct(spark):
    """Far more one-letter mailboxes and family names than first tries can tell apart."""
    values = [("MAILBOX", f"{a}{b}@x.example") for a in "abcdefghij" for b in "0123456789"] + [("FAMILY", f"name{i}") for i in range(500)]
    df = spark.createDataFrame(values, "kind string, canon string")
    tried = {(r.kind, r.canon): r.attempt for r in attempts_for(df, b"key").collect()}
    new = [(k, surrogate(b"key", k, c, tried.get((k, c), 0))) for k, c in values]
    assert tried and len(set(new)) == len(values)


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 2, None, None), (None, 0, "user", "x")]
    conv = conversations(spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, turns string")).collect()
    assert [(r.conv_id, [tuple(t) for t in r.turns]) for r in conv] == [(1, [("user", "hi"), ("assistant", "a"), ("assistant", "a"), ("", "")])]
    pair = "conv_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    rows = [
        (1, [("user", "q"), ("assistant", "good")], [("user", "q"), ("assistant", "bad"), ("user", "why")]), (2, [("user", "q")], [("user", "q")]), (3, [("user", "a")], [("user", "b")]), (4, None, [("assistant", "x")]),
    ]
    got = {r.conv_id: r for r in format_preferences(spark.createDataFrame(rows, pair)).collect()}
    assert (got[1].prefix_turns, got[1].prompt, got[1].chosen, got[1].chosen_mask) == (1, "<|user|>\nq\n", "<|assistant|>\ngood\n", "0:14,1:5")
    assert got[1].rejected == "<|assistant|>\nbad\n<|user|>\nwhy\n" and got[1].rejected_mask == "0:14,1:4,0:9,0:4"
    assert (got[2].prefix_turns, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", "") and got[3].prompt == "" and (got[4].prompt, got[4].chosen, got[4].rejected) == ("", "", "<|assistant|>\nx\n")
    for r in got.values():
        for side in ("chosen", "rejected"):
            runs = [x.split(":") for x in r[f"{side}_mask"].split(",") if x]
            assert sum(int(n) for _, n in runs) == len(r[side])
    assert format_preferences(spark.createDataFrame([], pair)).count() == 0


def test_surrogates_against_a_plain_version(spark):
    """The same texts with surrogates settled one value after another: no two values share one, none is a real one, and every text agrees."""
    rnd = random.Random(13)
    box = lambda: rnd.choice("abcdefghijkl") + rnd.choice(["", "", "1"])
    parts = [lambda: f"{box()}@{rnd.choice('xyz')}.example", lambda: f"10.0.0.{rnd.randrange(1, 9)}", lambda: f"Tel. +1 (01{rnd.randrange(3)}) 555-77{rnd.randrange(10)}3", lambda: f"Herr {rnd.choice(['Karl', 'Otto'])} {rnd.choice(['Meier', 'Adler', 'Adlermann'])} und Meier", lambda: "nur Text"]
    texts = ["; ".join(rnd.choice(parts)() for _ in range(rnd.randrange(1, 6))) for _ in range(120)]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)] + [(5, "a@x.example", "x", 1), (None, None, "x", 1)], "doc_id long, text string, __tried0 string, `of` int")
    values = sorted({u[:2] for t in [*texts, "a@x.example"] for a, b, kind, extra in find(t) for u in units(t[a:b], kind, extra)})
    settled, taken, attempt = {}, set(), 0
    pending = values
    cell = lambda kind, canon, new: (kind, canon.partition("@")[2] if kind == "MAILBOX" else "", new)
    while pending:
        again, now = [], {}
        for kind, canon in pending:
            now.setdefault(cell(kind, canon, surrogate(b"key", kind, canon, attempt)), []).append((kind, canon))
        for c, many in now.items():
            real = c[0] != "MAILBOX" and (c[0], c[2]) in values
            first = min(many)
            if c not in taken and not real:
                settled[first] = attempt
            again += [v for v in many if v not in settled]
        taken |= {cell(k, c, surrogate(b"key", k, c, n)) for (k, c), n in settled.items()}
        pending, attempt = again, attempt + 1
    assert attempt > 1
    want = sorted((t and rewrite(t, b"key", settled)[0]) or "" for t in [*texts, "a@x.example", None])
    got = with_surrogates(docs, b"key")
    assert got.columns == docs.columns and sorted(r.text or "" for r in got.collect()) == want


def test_too_few_surrogates_are_an_error(spark, monkeypatch):
    monkeypatch.setattr("lettermill.llm.surrogate.MOST_TRIES", 2)
    values = spark.createDataFrame([("SSN", f"{a}") for a in range(10)], "kind string, canon string")
    with pytest.raises(ValueError, match="SSN"):
        attempts_for(values, b"key")


def test_words_are_told_apart():
    """Words that a polynomial modulo 2 ** 64 takes for equal, whatever its base."""
    x = "a"
    while len(x) < 1024:
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    assert not np.intersect1d(wordhash.shingle_set(f"{x} p q r t"), wordhash.shingle_set(f"{y} p q r t")).size
    assert measure(f"{x} 1 2 3 4 {y} 1 2 3 4")[4] == 0 and measure(f"{x} 1 2 3 4 {x} 1 2 3 4")[4] == 10
    rnd = random.Random(1)
    for _ in range(200):
        texts = ["".join(rnd.choice("ab c\n\té\u65e5") for _ in range(rnd.randrange(0, 40))) + "q" * rnd.choice([0, 0, 9, 300]) if rnd.random() < 0.9 else None for _ in range(5)]
        alone = [wordhash.shingle_set(t, 3) for t in texts]
        (row, sizes, flat), = wordhash.shingle_sets(pa.array(texts, pa.string()), 3)
        assert row == 0 and np.array_equal(flat, np.concatenate(alone)) and sizes.tolist() == [len(x) for x in alone]
        words = [re.findall(SPACES, t or "") for t in texts]
        assert sizes.tolist() == [len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}) or bool(w) for w in words]


def test_a_very_long_text():
    text = " ".join(f"w{i % 200_000}" for i in range(14_000_000))  # over 100 MB
    assert len(text) > 100_000_000
    assert len(wordhash.shingle_set(text)) == 200_000
    n, chars, symbols, dup, repeat, lines = measure(text)
    assert (n, symbols, dup, lines) == (14_000_000, 0, 0, 1) and repeat == n and chars == len(text) - n + 1


def test_long_texts_are_scored_in_parts(monkeypatch):
    rnd = random.Random(2)
    texts = pa.array([" ".join(rnd.choice(["gut", "Schuft", "lump!", "und", "Ä-b", "x" * 40]) for _ in range(n)) for n in (0, 3, 400, 1, 90)] + [None])
    codes = np.sort(np.concatenate([k[:, 0] for t in ("schuft", "lump", "gut") for _, _, _, k in _vocabularies(pa.array([t]))]))
    codes = codes[codes != 0]
    model = ToxicModel(codes, np.linspace(-1, 2, len(codes)), 1.0, 1.0, 0.0, 1.0)
    whole = list(model.read(texts))
    monkeypatch.setattr(wordhash, "BLOCK", 50)
    parts = list(model.read(texts))
    assert [r[:2] for r in parts] == [r[:2] for r in whole] and [r[0] for r in whole] == list(range(6))
    for a, b in zip(parts, whole, strict=True):
        assert np.allclose(a[2], b[2]) if b[2] else not a[2]


def test_fitted_weights_against_plain_log_odds(spark):
    """Weights of both signs, as the Dirichlet prior gives them word by word."""
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        toxic = int(i % 4 == 0)
        w = [rnd.choice(["eins", "zwei", "drei"]) for _ in range(4)] + (["bös"] if toxic and rnd.random() < 0.9 else []) + (["lieb"] if not toxic and rnd.random() < 0.9 else []) + [f"n{i}"]
        rows.append((i, " ".join(w), toxic))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = fit(docs, labels)
    counts = [collections.Counter(), collections.Counter()]
    for text, label in {(t, x) for _, t, x in rows}:
        counts[label].update({w[:k] for w in text.split() for k in (3, 4, 5, 6, 7, 8, 99) if k == 99 or k < len(w)} | set())
    # a token and a stem that read alike are features of their own, so only whole words without a like stem are compared
    n = [sum(len({(w, 0) for w in t.split()} | {(w[:k], k) for w in t.split() for k in (3, 4, 5, 6, 7, 8) if k < len(w)}) for t, x in {(t, x) for _, t, x in rows} if x == label) for label in (0, 1)]
    share = 0.05
    for word, sign in (("bös", 1), ("lieb", -1)):
        y = [counts[k][word] for k in (0, 1)]
        a = share * sum(y)
        odds = [math.log((y[k] + a) / (n[k] + share * sum(n) - y[k] - a)) for k in (0, 1)]
        code = next(k for _, _, _, k in _vocabularies(pa.array([word])))[0, 0]
        got = model.weights[np.searchsorted(model.codes, code)]
        assert sign * got > 0 and math.isclose(got, odds[1] - odds[0], rel_tol=1e-9), word
