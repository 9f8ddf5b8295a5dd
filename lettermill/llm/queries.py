"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .bytepair import decoded, digests, encoded
from .centroids import clustered, with_inertia
from .common import read, written
from .middle import fill_in_middle, restored
from .mixing import mix
from .neardup import near_duplicates
from .ngram_join import similar
from .packing import pack
from .preference import format_preferences, self_paired
from .rules import judged, ledger
from .sharding import assign_shards
from .surrogate import QUERY_KEY, with_surrogates
from .toxicity import toxic_verdicts
from .warczip import archived


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read(spark, sf_dir, "documents"), shards=24)


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(self_paired(read(spark, sf_dir, "conversations")))


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op5_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages")).drop("payload")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(read(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY, count="n_values")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).withColumn("n_shards", F.size("shard_words").cast("long")).drop("shard_words")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(written(ledger(read(spark, sf_dir, "documents")), "ledger"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures", "sole_rule")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(decoded(encoded(read(spark, sf_dir, "documents"))))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*clustered(read(spark, sf_dir, "embeddings")))


def _rounds_sql(rounds: int = 5, k: int = 40) -> str:
    """Centroid clustering as SQL: each round compares all vectors with all centroids."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (
            SELECT r, c, d FROM (SELECT r, c, sum((p.x - z.x) * (p.x - z.x)) AS d FROM p JOIN c{r} z USING (i) GROUP BY r, c)
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""
        c{r + 1} AS MATERIALIZED (
            SELECT z.c, z.i, coalesce((s - ((s % n) + n) % n) // n, z.x) AS x
            FROM c{r} z LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN p USING (r) GROUP BY c, i) USING (c, i))""")
    return f"""
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        p AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, CAST(floor(256 * unnest(e)) AS BIGINT) AS x FROM v),
        c0 AS MATERIALIZED (SELECT c, i, x FROM (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k}) JOIN p USING (r)),
        {",".join(steps)},
        named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN named USING (c)
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_embedding_neardup": op2_embedding_neardup,
    "op3_preference_format": op3_preference_format,
    "op4_retrieval_packing": op4_retrieval_packing,
    "op5_warc_packages": op5_warc_packages,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_centroid_clustering": op13_centroid_clustering,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op10_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        per AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
        win AS (SELECT r, i, w[i : i + 4] AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1))) AS t(i)),
        twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
        cover AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(5) AS t(j) GROUP BY r),
        m AS (
            SELECT doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
            FROM d LEFT JOIN per USING (r) LEFT JOIN cover USING (r)),
        f AS (
            SELECT *, CAST(n_words < 10 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > 3 * n_words AS BIGINT)
                + 8 * CAST(n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines AS BIGINT) + 16 * CAST(n_words > 0 AND word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 20 * n_words AS BIGINT) AS failures
            FROM m)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
            CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures,
            CASE failures WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' END AS sole_rule
        FROM f
    """,
    "op3_preference_format": """
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        a AS (SELECT conv_id, max(i) FILTER (role = 'assistant') AS last_i, min(i) FILTER (role = 'assistant') AS first_i FROM t GROUP BY conv_id),
        f AS (SELECT conv_id, last_i, CASE WHEN first_i < last_i THEN t.text ELSE '' END AS other FROM a JOIN t USING (conv_id) WHERE t.i = a.first_i),
        r AS (SELECT t.*, CASE WHEN i = last_i THEN other ELSE text END AS alt, '<|' || role || '|>' || chr(10) AS head FROM t LEFT JOIN f USING (conv_id)),
        k AS (SELECT conv_id, coalesce(min(i) FILTER (text <> alt), count(*)) AS k FROM r GROUP BY conv_id),
        m AS (SELECT r.*, k, '0:' || length(head) || CASE WHEN role = 'assistant' THEN ',1:' ELSE ',0:' END AS run FROM r JOIN k USING (conv_id))
        SELECT conv_id, CAST(any_value(k) AS INTEGER) AS prefix_turns,
            coalesce(string_agg(head || text || chr(10), '' ORDER BY i) FILTER (i < k), '') AS prompt,
            coalesce(string_agg(head || text || chr(10), '' ORDER BY i) FILTER (i >= k), '') AS chosen,
            coalesce(string_agg(head || alt || chr(10), '' ORDER BY i) FILTER (i >= k), '') AS rejected,
            coalesce(string_agg(run || (length(text) + 1), ',' ORDER BY i) FILTER (i >= k), '') AS chosen_mask,
            coalesce(string_agg(run || (length(alt) + 1), ',' ORDER BY i) FILTER (i >= k), '') AS rejected_mask
        FROM m GROUP BY conv_id
    """,
    "op5_warc_packages": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
        SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
               CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN f USING (html)
    """,
    "op11_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        h AS (
            SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                     WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d),
        c AS (
            SELECT *, coalesce(array_to_string(u[1 : least(x, y)], ''), '') AS p, coalesce(array_to_string(u[least(x, y) + 1 : greatest(x, y)], ''), '') AS m,
                coalesce(array_to_string(u[greatest(x, y) + 1 : n], ''), '') AS s
            FROM h)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM c
    """,
    "op13_centroid_clustering": _rounds_sql(),
}
