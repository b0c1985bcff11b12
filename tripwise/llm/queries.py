"""Registered queries of this package and their comparison SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.llm import (
    digest_index, hard_negatives, language_model, line_runs, mixing, near_dup, quality, token_shards, toxicity, url_filter, vector_codes, warc, winnow,
)
from tripwise.llm.common import table
from tripwise.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPACE = r"[\x20\x09-\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of op8, in the order the contract gives them.
RULES = (
    url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/"),
)


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return wrap


_BASE32_SQL = " || ".join(
    f"substr('{warc.BASE32}', 1 + ((('0x' || substr(h, {1 + 5 * g}, 5))::INTEGER >> {5 * (3 - i)}) & 31), 1)" for g in range(8) for i in range(4)
)


@query("op1_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32_SQL} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
""")
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archive all pages, read the archive back and describe its records."""
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, folder, "pages"), path)
    return warc.read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_quality")
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_line_dedup", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
     k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
     f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.first < k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.first IS NULL OR f.first >= k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY k.r, k.doc_id
""")
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines seen in an earlier document go; whole table, four batches."""
    cleaned = line_runs.dedup_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected toxicity grade of every document."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of shingle Jaccard 0.8 or more."""
    return near_dup.near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op6_mix")
def op6_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.pareto_mix(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"),
    )


@query("op7_language_model")
def op7_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every text under the hierarchical Pitman-Yor model."""
    return language_model.score_texts(table(spark, folder, "documents"))


_RULES_SQL = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)


@query("op8_url_filter", rf"""
WITH rules(verdict, host, path) AS (VALUES {_RULES_SQL}),
     u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     m AS (SELECT s.page_id, s.host, s.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
           FROM s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
""")
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of every page's url."""
    judged = url_filter.filter_urls(table(spark, folder, "pages"), list(RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_exact_dedup", rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS h FROM documents),
     r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w AS rn
           FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, h AS text_sha256 FROM r
""")
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of every document, dropped ones too."""
    return digest_index.exact_dedup(table(spark, folder, "documents"))


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')" % (_UPPER, _LOWER)


@query("op10_decontamination", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
     b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
     win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest([array_to_string(w[i:i + least(len(w), 13) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 13) + 2)]) AS g
             FROM b WHERE len(w) > 0),
     sizes AS (SELECT DISTINCT n FROM win),
     dw AS (SELECT r, n, unnest([struct_pack(i := i, g := array_to_string(w[i:i + n - 1], ' ')) FOR i IN range(1, len(w) - n + 2)], recursive := true)
            FROM d, sizes WHERE len(w) >= n),
     h AS (SELECT r, i, n, item_id FROM dw JOIN win USING (n, g)),
     c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
     t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
""")
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark words found in every document."""
    judged = winnow.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return judged.drop("item_ids")


@query("op11_token_shards")
def op11_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written to shards and looked up by their index."""
    docs = table(spark, folder, "documents")
    path = scratch_path(spark, "tokens")
    token_shards.write_dataset(docs, path, token_shards.Encoding(public_tokenizers.path("byte_bpe_50k.json"), end_id=0))
    found = token_shards.lookup(spark, path, token_shards.document_keys(docs))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, dim: int = 64, scale: int = 1024) -> str:
    """Rounds as one table expression each."""
    w = dim // parts
    means = ", ".join(f"floor(sum(x[{i}]) / count(*))" for i in range(1, w + 1))
    steps = [f"""
k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS rn
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT rn, part, v[part * {w} + 1:part * {w} + {w}]::DOUBLE[] AS x FROM k, range({parts}) AS t(part)),
c0 AS MATERIALIZED (SELECT part, rn AS entry, x FROM x WHERE rn < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT rn, part, min((list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, c.x) + list_inner_product(c.x, c.x))::HUGEINT * {entries} + entry) AS m
       FROM x JOIN c{r} c USING (part) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN
       (SELECT part, m % {entries} AS entry, [{means}]::DOUBLE[] AS x FROM a{r} JOIN x USING (rn, part) GROUP BY ALL) n USING (part, entry))""")
    return f"""
WITH {",".join(steps)},
d AS (SELECT rn, string_agg(printf('%02x', (m % {entries})::INTEGER), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY rn)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x::BIGINT[], ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN d USING (rn)
"""


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Product codes of all vectors and their errors."""
    return vector_codes.compressed(table(spark, folder, "embeddings"))


@query("op12_hard_negatives", """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
     FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
     FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank,
             s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
""")
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are shifted first."""
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.integer_vectors(rows.withColumn("label", label))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)
