"""Measures of retrieval and recognition quality, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_and_mrr(ranks: DataFrame, k: int = 5) -> DataFrame:
    """By family: queries, Recall@k and mean reciprocal rank. ``ranks`` has family, query_id and the rank of the first right hit or null."""
    hit = F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
    return ranks.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def citation_accuracy(tops: DataFrame) -> DataFrame:
    """By family: the share of queries whose top hit is the expected file, on the expected page or, where there is none, with a place of its own.

    ``tops`` has family, filename, page, place (locator or header), expected_file and expected_page.
    """
    right = F.when(F.col("expected_page").isNotNull(), F.col("page").eqNullSafe(F.col("expected_page"))).otherwise(F.col("page").isNull() & (F.coalesce("place", F.lit("")) != ""))
    hit = F.coalesce((F.col("filename") == F.col("expected_file")) & right, F.lit(False)).cast("double")
    return tops.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("citation_accuracy"))


def span_precision(hits: DataFrame) -> DataFrame:
    """By family: the share of queries of which some hit holds the expected words. ``hits`` has family, query_id, content and expected."""
    held = F.max(F.lower("content").contains(F.lower("expected")).cast("int"))
    return hits.groupBy("family", "query_id").agg(held.alias("_h")).groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg("_h"), 6).alias("span_precision"))


def ndcg(hits: DataFrame, k: int = 5) -> DataFrame:
    """nDCG@k of each query from (query_id, rank, relevant), against its own ideal order."""
    gain = lambda r: 1 / F.log2(r + 1)
    got = hits.groupBy("query_id").agg(F.sum(F.when((F.col("rank") <= k) & (F.col("relevant") > 0), gain(F.col("rank"))).otherwise(0.0)).alias("_dcg"), F.sum((F.col("relevant") > 0).cast("int")).alias("_n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("_n").cast("int")))), F.lit(0.0), lambda s, r: s + gain(r))
    return got.select("query_id", F.round(F.when(F.col("_n") == 0, 0.0).otherwise(F.col("_dcg") / ideal), 4).alias("ndcg"))


def calibration_error(scored: DataFrame, bins: int = 5) -> DataFrame:
    """Expected calibration error over equal bins, the last closed: one row. ``scored`` has confidence and correct (0 or 1)."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    per = scored.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("correct").cast("double")).alias("a"))
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 4).alias("ece"))


def wilson(counts: DataFrame, z: float = 1.96) -> DataFrame:
    """Wilson score interval of (family, hits, n)."""
    n, p = F.col("n").cast("double"), F.col("hits") / F.col("n")
    mid, span = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return counts.select("family", F.round(F.greatest(F.lit(0.0), mid - span), 4).alias("low"), F.round(F.least(F.lit(1.0), mid + span), 4).alias("high"))


def error_rates(pairs: DataFrame) -> DataFrame:
    """Character error rate of (pair_id, truth, read), and word error rate: each distinct word becomes a character first. Both capped at 1."""
    low = lambda c: F.lower(F.col(c))
    cer = F.least(F.lit(1.0), F.levenshtein(low("truth"), low("read")) / F.greatest(F.lit(1), F.length("truth")))
    split = lambda c: F.filter(F.transform(F.split(low(c), r"\s+"), lambda w: F.btrim(w, F.lit(".,;:!?()[]$\"'`"))), lambda w: w != "")
    rows = pairs.withColumns({"_t": split("truth"), "_r": split("read")}).withColumn("_v", F.array_distinct(F.concat("_t", "_r")))
    as_text = lambda c: F.array_join(F.transform(F.col(c), lambda w: F.char(F.array_position("_v", w) + 32)), "")
    wer = F.least(F.lit(1.0), F.levenshtein(as_text("_t"), as_text("_r")) / F.greatest(F.lit(1), F.size("_t")))
    return rows.select("pair_id", F.round(cer, 4).alias("cer"), F.round(wer, 4).alias("wer"))


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """p50, p95 and p99 of each group as observed values (discrete percentiles), the count, and queries a second at the mean of ``value`` milliseconds."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    return rows.groupBy(group).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.when(F.avg(value) > 0, 1000.0 / F.avg(value)).otherwise(0.0), 1).alias("qps"))


def leakage(hits: DataFrame) -> DataFrame:
    """The share of hits from another workspace than the one searched."""
    return hits.agg(F.round(F.avg((F.col("workspace") != F.col("expected")).cast("double")), 6).alias("leakage"))
