"""The queries of the operators and of the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import cotrain, fingerprints, importance, licences, mixing, neardup, packing, quality_rules, sharding, spelling, token_store, toxicity, url_filter
from quillspark.llm.common import documents, stored


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(documents(spark, sf_dir))


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = stored(cotrain.features(documents(spark, sf_dir)), "features")
    return cotrain.score(feats, cotrain.fit(feats, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.new_path(spark)
    token_store.write(documents(spark, sf_dir), path)
    return token_store.digests(spark, path)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir).select("doc_id", "source"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.verdict("v1")).alias("base_failed"),
        quality_rules.verdict("v2").alias("kept"),
        "fail_mask",
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.digest(packing.pieces(documents(spark, sf_dir))))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    files = documents(spark, sf_dir).select("doc_id", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")
    return licences.scan(files)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law")
    )
    placed = sharding.with_slots(sharding.assign(docs, sharding.tree(16)))
    return sharding.assign(placed, sharding.tree(17), name="grown_shard").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url", "n_hits")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_cotraining": op2_cotraining,
        "op3_token_store": op3_token_store,
        "op4_mixing": op4_mixing,
        "op5_quality_rules": op5_quality_rules,
        "op6_toxicity": op6_toxicity,
        "op7_packing": op7_packing,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_licences": op9_licences,
        "op10_sharding": op10_sharding,
        "op11_url_filter": op11_url_filter,
        "op12_spelling": op12_spelling,
        "op13_importance": op13_importance,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": QUALITY_RULES, "op11_url_filter": URL_FILTER}


QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
five AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
keyed AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS k FROM five),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM keyed) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_bangs
      FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END)
             + (CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN 5 * n_bangs > n_words THEN 64 ELSE 0 END) AS fail_mask FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, fail_mask & 3 <> 0 AS base_failed,
       fail_mask = 0 AS kept, fail_mask::BIGINT AS fail_mask FROM b
"""

URL_FILTER = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM u),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/]*([\s\S]*)$', 1) AS path FROM r),
rules(rule_host, rule_path, rule_verdict) AS (VALUES RULES),
best AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
         FROM h JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
terms(term, weight, pattern) AS (VALUES TERMS),
found AS (SELECT page_id, term, weight FROM h JOIN terms ON regexp_matches(lower(url_decode(url)), pattern)),
t AS (SELECT page_id, count(*) FILTER (weight >= 100) AS n_strict, count(*) FILTER (weight < 100) AS n_soft, coalesce(sum(weight) FILTER (weight < 100), 0) AS soft_weight
      FROM found GROUP BY page_id)
SELECT h.page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN coalesce(n_strict, 0) > 0 OR coalesce(n_soft, 0) >= 2 AND soft_weight >= 100 THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(n_strict, 0)::BIGINT AS n_strict, coalesce(n_soft, 0)::BIGINT AS n_soft, coalesce(soft_weight, 0)::BIGINT AS soft_weight
FROM h LEFT JOIN best USING (page_id) LEFT JOIN t USING (page_id)
""".replace("RULES", ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in url_filter.RULES)).replace(
    "TERMS", ", ".join(f"('{t}', {w}, '(^|[^\\p{{L}}]){t}([^\\p{{L}}]|$)')" for t, w in url_filter.VOCABULARY.items())
)
