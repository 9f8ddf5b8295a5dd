"""Elements of pages against trees that are known, secrets and overlaps against all pairs."""

import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from lettermill.functions.page import elements, page_items
from lettermill.operators.secrets import _numbers, overlap_counts, stored_secrets


def test_nested_and_odd_markup():
    assert elements("<ul><li>a<ul><li>b</li><li>c</li></ul>d</li><li>e</li></ul>", "li") == ["a b c d", "b", "c", "e"]
    assert elements("<ul><li>a<li>b<ol><li>c<li>d</ol>e<li>f</ul><p>g", "li") == ["a", "b c d e", "c", "d", "f"]
    assert elements('<LI CLASS="x slot-item y" title="a > b">frei &amp; <b>10:00</b><br>Uhr</LI><li class="slot-items">nein', "li", "slot-item") == ["frei & 10:00 Uhr"]
    assert elements("<li class=slot-item>a</li><li class='slot-item'>b</li><li class>c</li>", "li", "slot-item") == ["a", "b"]
    assert elements("<!-- <li>x</li> --><li>a<!-- > -->b</li><script>if (a < b) '<li>no</li>'</script><style><li></style><li>c", "li") == ["a b", "c"]
    assert elements("<tr><td>1<td>2<tr><td>3</table>", "td") == ["1", "2", "3"] and elements("<tr><td>1<td>2<tr><td>3", "tr") == ["1 2", "3"]
    assert elements("</li></ul><li>a</ul></b>b", "li") == ["a b"] and elements("", "li") == [] and elements("a < b <3 <li", "li") == []
    assert elements("<li/><li>&#8364; &auml;&nbsp;x</li>", "li") == ["", "€ ä x"] and elements("<dl><dt>a<dd>b<dt>c</dl>", "dd") == ["b"]
    assert elements("<title>a <b> c</title><li>" + "x " * 300_000 + "</li>", "li") == ["x " * 299_999 + "x"]


def test_random_trees(spark):
    rnd = random.Random(4)

    def made(depth):
        """Markup, its text, and the texts of its items in order."""
        out, text, items = [], [], []
        for _ in range(rnd.randrange(4)):
            kind = rnd.random()
            if kind < 0.4 or not depth:
                word = rnd.choice(["wort", "a&b", "Tür", "x>y", ""])
                out.append(word.replace("&", "&amp;") + " ")
                text.append(word)
            elif kind < 0.5:
                out.append(rnd.choice(["<br>", "<!-- <li class='s'> -->", "<img src='a>b'/>", "<script>'<li>'</script>"]))
            else:
                inner, said, found = made(depth - 1)
                name = rnd.choice(["ul", "div", "b"]) if kind < 0.75 else "li"
                css = rnd.choice(["", " class='s'", ' id=1 class="t s u"', " class='ss'"])
                if name == "li":
                    inner = f"<ul>{inner}</ul>"  # so that items within are no neighbours
                    items.append((said, "s" in css.replace("class", "").replace("ss", "")))
                    out.append(f"<ul><li{css}>{inner}</li></ul>")
                else:
                    out.append(f"<{name}{css}>{inner}</{name}>")
                text.append(said)
                items += found
        return "".join(out), " ".join(" ".join(text).split()), items

    trees = [made(4) for _ in range(300)]
    for page, _, items in trees:
        assert elements(page, "li") == [t for t, _ in items], page
        assert elements(page, "li", "s") == [t for t, hit in items if hit], page
    rows = spark.createDataFrame([(i, t[0]) for i, t in enumerate(trees)] + [(999, None)], "i int, html string").select("i", page_items(F.col("html")).alias("x")).collect()
    assert all(r.x == [t for t, _ in trees[r.i][2] if t] for r in rows if r.i != 999) and rows[-1].x is None


def test_secrets_against_all_pairs(spark):
    rnd = random.Random(2)
    words = ["Müller", "Torstraße 15", 'a"b c', "kunde1@mail.example", "kunde11@mail.example", "abcd", "abc", "Ärzt", "\\path\\x", "zeile\nzwei", "aaaa", "", None]
    known = [(rnd.choice(["u1", "u2", None]), w) for w in words for _ in range(2)] + [(f"x{i}", f"wert{i}xyz") for i in range(300)]
    rows = [(str(i), " ".join(rnd.choice([*[w or "" for w in words], "aaaaaa", "Mülle", "wert7xyz", "wert299xy"]) for _ in range(rnd.randrange(4))), [rnd.choice(["abcd", "x", "Ärzt"])], {"k": rnd.choice(["wert12xyz", "-"])}) for i in range(200)] + [(None, "abcde", [], {}), ("n", None, None, None)]
    table = spark.createDataFrame(rows, "id string, text string, list array<string>, map map<string,string>")
    secrets = spark.createDataFrame(known, "owner string, value string")
    got = stored_secrets({"one": table, "two": table.select("id", "text").limit(0), "three": table.select("id", "list")}, secrets)
    want = set()
    for name, cells in (("one", lambda r: {"id": r[0], "text": r[1], "list": r[2], "map": r[3]}), ("three", lambda r: {"id": r[0], "list": r[2]})):
        for r in rows:
            told = json.dumps({k: v for k, v in cells(r).items() if v is not None}, ensure_ascii=False, separators=(",", ":"))
            want |= {(name, r[0], o, v) for o, v in known if v and len(v) > 3 and json.dumps(v, ensure_ascii=False)[1:-1] in told}
    out = [tuple(r) for r in got.collect()]
    assert set(out) == want and len(out) == len(want) and len(want) > 100
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    assert stored_secrets({"one": table}, secrets.limit(0)).count() == 0


def test_secrets_that_begin_alike(spark):
    values = [f'Torstraße "{i}"' for i in range(3000)] + [f"Torstraße {'x' * i}" for i in range(1, 200)]
    codes = _numbers(pa.array(values)).field("code").to_pylist()
    assert len(set(codes)) == len(values), "no number is shared, so no join pairs a row with secrets that it does not hold"
    rows = spark.createDataFrame([(i, f"aus der {values[i]}, erledigt") for i in range(len(values))], "id int, text string")
    got = stored_secrets({"t": rows}, spark.createDataFrame([(f"u{i}", v) for i, v in enumerate(values)], "owner string, value string"))
    assert {(int(r.key), r.owner) for r in got.collect()} == {(i, f"u{i}") for i in range(3000)} | {(3000 + i, f"u{3000 + j}") for i in range(199) for j in range(i + 1)}


def test_overlaps_against_all_pairs(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abAB ", k=rnd.randrange(0, 14))) for _ in range(120)] + ["Reisepass Kopie", "kopie vom Reisepass", "Mietvert", "MIETVERTRAG (Original)", None, "", "a"] + ["gemeinsam am Anfang"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    other = spark.createDataFrame(list(enumerate(texts[40:])), "n int, t string")
    near = lambda a, b: bool(a) and bool(b) and (a.lower()[:8] in b.lower() or b.lower()[:8] in a.lower())
    got = overlap_counts(df, other, "id", "t")
    assert {r.id: r.n_near for r in got.collect()} == {i: sum(near(a, b) for b in texts[40:]) for i, a in enumerate(texts)}
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "CartesianProduct" not in plan
    assert {r.n_near for r in overlap_counts(df, other.limit(0), "id", "t").collect()} == {0} and overlap_counts(df.limit(0), other, "id", "t").count() == 0
