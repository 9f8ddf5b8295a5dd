import duckdb
import pytest

import corpus_pipeline
from lettermill.llm import queries
from lettermill.llm.common import read, written

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    c = duckdb.connect()
    for t in ("pages", "conversations", "documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, DATA), c.sql(queries.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    pick = [rel.columns.index(n) for n in names]
    assert sorted(map(tuple, df.select(names).collect()), key=repr) == sorted((tuple(r[i] for i in pick) for r in rel.fetchall()), key=repr)


def test_stages_work_on_what_is_left(spark):
    docs = read(spark, DATA, "documents")
    columns, ids = docs.columns, [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns
        ids.append({r.doc_id for r in docs.collect()})
    assert ids[0] >= ids[1] > ids[2] == ids[3] >= ids[4]
    words = docs.selectExpr("sum(regexp_count(text, '\\\\S+')) AS n").first().n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in pieces} == ids[4] and sum(r.length for r in pieces) > words
    assert sum(r.doc_tokens for r in pieces if r.start == 0) == sum(r.length for r in pieces)


def test_stages_with_odd_rows(spark):
    """Nulls, empty and repeated rows, an empty table and names that the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, size long, `of` int, tile string, __row int, cid long, __tried0 string"
    text = " ".join(f"wort{i} hier" for i in range(40))
    base = [(1, text, "de", "a"), (1, text, "de", "a"), (2, text + " noch", None, None), (3, None, "de", "a"), (4, "", "de", None), (None, "ohne id, mail an x.1@y.example", "de", "a"), (None, None, None, None), (5, text, None, "b")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "t", 4, 5, "") for r in base], schema)
    want = {"toxicity": 8, "near_duplicates": 5, "surrogates": 8}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        if name in want:
            assert len(rows) == want[name], name
        if name != "packing":
            assert out.columns == docs.columns, name
        else:
            assert sum(r.start == 0 for r in rows) == len(base)
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
