"""The registered queries of the library's own operators, each with SQL that gives the same result, where SQL can express it.

The tables at hand are no legal corpus: `documents` stands in for chunks (source as workspace, lang as doc_type), other tables for
ledgers, versions and measurements. Rules for headings, citations, slots and the like run over whole texts or all their lines, marked with
phrases that the rules are about: a mark is chosen by the row's number, and ``{}`` in it stands for the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.vectors import cosine, dot, pack, sigmoid, unpack
from quillspark.operators import chunker, corpus, embedding, evals, overlap, packs, postings, search, structure, versions
from quillspark.sources import files, pdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    page, header = (F.col("doc_id") % 7 + 1), F.concat(F.lit("Section "), F.col("doc_id") % 4 + 1, F.lit("."), F.col("doc_id") % 3)
    out = d.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("workspace"),
        F.col("lang").alias("doc_type"),
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("filename"),
        page.alias("page"),
        header.alias("header"),
        F.concat(F.lit("Page "), page).alias("locator"),
        F.array(header).alias("heading_path"),
        F.col("text").alias("content"),
        (F.col("doc_id") % 11 == 0).alias("is_superseded"),
        F.col("doc_id"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 365 as int))").alias("ingested_at"),
        T.source_hash(F.col("text")).alias("source_hash"),
    )
    if vectors:
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
        out = out.join(e, "chunk_id", "left")
    return out


def pick(marks: list, number: Column) -> Column:
    """One of some constants, in turn."""
    return F.element_at(F.array(*[F.lit(m) for m in marks]), (number % len(marks) + 1).cast("int"))


def quoted(value: object) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def pick_sql(marks: list, number: str) -> str:
    return f"([{', '.join(map(quoted, marks))}])[(({number}) % {len(marks)} + 1)::BIGINT]"


def marked(text: Column, marks: list[str], number: Column) -> Column:
    return F.replace(pick(marks, number), F.lit("{}"), text)


def marked_sql(text: str, marks: list[str], number: str) -> str:
    return f"replace({pick_sql(marks, number)}, '{{}}', {text})"


def lines(spark: SparkSession, sf_dir: str, marks: list[str]) -> DataFrame:
    """All lines of all documents, marked."""
    rows = structure.lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), marked(F.col("line"), marks, F.col("doc_id") + F.col("line_no")).alias("line"))


def lines_sql(marks: list[str]) -> str:
    rows = "SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)"
    return f"(SELECT doc_id, line_no, {marked_sql('line', marks, 'doc_id + line_no')} AS line FROM ({rows}))"


CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, source AS workspace, lang AS doc_type, concat('doc_', doc_id, '.txt') AS filename, doc_id % 7 + 1 AS page,
 concat('Section ', doc_id % 4 + 1, '.', doc_id % 3) AS header, concat('Page ', doc_id % 7 + 1) AS locator, text AS content, doc_id % 11 = 0 AS is_superseded,
 sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS source_hash FROM documents)"""
SCOPED = f"{CHUNKS}, base AS (SELECT * FROM chunks WHERE workspace = 'src0' AND NOT is_superseded)"
WORDS = "list_transform(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'), lambda x: x)"
TEXT = "thing eror onhentha the and worthless"
TERMS = ["thing", "eror", "onhentha", "worthless"]


# Filters ------------------------------------------------------------------------------------------------------------


@query("ws_filter", f"WITH {CHUNKS} SELECT chunk_id, workspace, doc_type FROM chunks WHERE workspace = 'src1' AND NOT is_superseded")
def ws_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scoped(chunks(spark, sf_dir), "src1").select("chunk_id", "workspace", "doc_type")


@query("filter_doctype", f"WITH {SCOPED} SELECT chunk_id, doc_type FROM base WHERE doc_type = 'fr'")
def filter_doctype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scoped(chunks(spark, sf_dir), "src0", doc_type=search.parse_query("doc_type:FR tenants").doc_type).select("chunk_id", "doc_type")


@query("filter_page", f"WITH {SCOPED} SELECT chunk_id, page FROM base WHERE page = 3 AND filename LIKE 'doc%'")
def filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scoped(chunks(spark, sf_dir), "src0", page=3).select("chunk_id", "page")


@query("filter_filename", f"WITH {SCOPED} SELECT chunk_id, filename FROM base WHERE filename = 'doc_20.txt'")
def filter_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scoped(chunks(spark, sf_dir), "src0", filename="doc_20.txt").select("chunk_id", "filename")


@query("filter_doc_id", f"WITH {SCOPED} SELECT chunk_id, workspace FROM base WHERE chunk_id = 20")
def filter_doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scoped(chunks(spark, sf_dir), "src0", doc_id=20).select("chunk_id", "workspace")


@query("filter_dates", f"WITH {SCOPED} SELECT chunk_id FROM base WHERE chunk_id % 365 BETWEEN 31 AND 90")
def filter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scoped(chunks(spark, sf_dir), "src0", date_from="2024-02-01", date_to="2024-03-31").select("chunk_id")


@query("low_ocr", f"WITH {SCOPED} SELECT chunk_id FROM base WHERE NOT contains(content, 'low OCR confidence quarantined')")
def low_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scoped(chunks(spark, sf_dir), "src0").select("chunk_id")


@query("like_filter", "SELECT doc_id, source FROM documents WHERE source ILIKE '%RC1%'")
def like_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("source").ilike("%RC1%")).select("doc_id", "source")


@query("source_len_filter", "SELECT doc_id, lang FROM documents WHERE length(text) > 50 AND lang = 'en'")
def source_len_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where((F.length("text") > 50) & (F.col("lang") == "en")).select("doc_id", "lang")


@query("acl_filter", f"WITH {CHUNKS} SELECT workspace, count(*) AS n FROM chunks WHERE workspace IN ('src1', 'src2') GROUP BY workspace")
def acl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = ["src1", "src2"]
    mine = [search.scoped(chunks(spark, sf_dir), w, allowed, include_superseded=True) for w in allowed]
    return mine[0].unionByName(mine[1]).groupBy("workspace").agg(F.count("*").alias("n"))


SPARSE = " + ".join(f"(contains(lower(concat_ws(' ', content, header, locator)), '{w}'))::INT" for w in search.parse_query(TEXT).words)
SPARSE_TOP = f"SELECT chunk_id, ({SPARSE})::DOUBLE AS hits FROM base WHERE ({SPARSE}) > 0 ORDER BY hits DESC, chunk_id LIMIT 25"
SPARSE_LEG = f"s AS (SELECT chunk_id, hits, row_number() OVER (ORDER BY hits DESC, chunk_id) AS sparse_rank FROM ({SPARSE_TOP}))"


NEG = "section 2.1"


@query("neg_term", f"WITH {SCOPED} SELECT chunk_id, row_number() OVER (ORDER BY hits DESC, chunk_id) AS sparse_rank FROM ({SPARSE_TOP}) JOIN base USING (chunk_id) WHERE NOT contains(lower(concat(content, ' ', header)), '{NEG}')")
def neg_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = search.scoped(chunks(spark, sf_dir), "src0")
    top = search.sparse_topk(base, search.parse_query(TEXT).words).withColumn("query_id", F.lit(0))
    negative = spark.range(1).select(F.lit(0).alias("query_id"), F.array(F.lit(NEG)).alias("_negative"))
    return search.without_negated(base, top, negative, "hits", "sparse_rank").select("chunk_id", "sparse_rank")


@query("header_regex", f"WITH {SCOPED}, {SPARSE_LEG} SELECT s.chunk_id, header FROM s JOIN base USING (chunk_id) WHERE regexp_matches(concat_ws(' ', header, locator), '(?i)SECTION [12]\\.')")
def header_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = search.scoped(chunks(spark, sf_dir), "src0")
    top = search.sparse_topk(base, search.parse_query(TEXT).words)
    pattern = search.parse_query(r'"x y" header:"SECTION [12]\."').header_regex
    return base.join(F.broadcast(top), "chunk_id").where(F.concat_ws(" ", "header", "locator").rlike(f"(?i){pattern}")).select("chunk_id", "header")


# Ranking ------------------------------------------------------------------------------------------------------------


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


Q0 = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)"
SIM = "round(list_dot_product(embedding::DOUBLE[], qv), 6)"
DENSE_TOP = f"SELECT chunk_id, sim FROM (SELECT b.chunk_id, {SIM} AS sim FROM base b JOIN embeddings ON vec_id = b.chunk_id, q) WHERE sim >= 0.05 ORDER BY sim DESC, chunk_id LIMIT 25"
DENSE_LEG = f"{Q0}, d AS (SELECT chunk_id, sim, row_number() OVER (ORDER BY sim DESC, chunk_id) AS dense_rank FROM ({DENSE_TOP}))"


@query("dense_topk", f"WITH {SCOPED}, {DENSE_LEG} SELECT * FROM d")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense_topk(search.scoped(chunks(spark, sf_dir, True), "src0"), _vector(spark, sf_dir), floor=0.05)


@query("dense_floor", f"WITH {Q0} SELECT vec_id, {SIM} AS sim FROM embeddings, q WHERE {SIM} >= 0.15")
def dense_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(F.col("embedding"), q), 6).alias("sim")).where("sim >= 0.15")


@query("cosine", f"WITH {Q0} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS cosine FROM embeddings, q")
def cosine_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("cosine"))


@query("sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS p FROM (SELECT row_number() OVER (ORDER BY event_id) AS rn, * FROM events) WHERE value IS NOT NULL")
def sigmoid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", F.round(sigmoid((F.col("value") - 50) / 10), 6).alias("p"))


@query("sparse_topk", f"WITH {SCOPED}, {SPARSE_LEG} SELECT * FROM s")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sparse_topk(search.scoped(chunks(spark, sf_dir), "src0"), search.parse_query(TEXT).words)


def _bm25_sql(k: int) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(TERMS)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / adl))" for i in range(len(TERMS)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))
    return f"""w AS (SELECT chunk_id, {WORDS} AS w FROM base), c AS (SELECT chunk_id, len(w) AS dl, {tf} FROM w), st AS (SELECT count(*) AS n, avg(dl) AS adl, {df} FROM c),
b AS (SELECT chunk_id, bm25, row_number() OVER (ORDER BY bm25 DESC, chunk_id) AS bm25_rank FROM (SELECT chunk_id, round({score}, 6) AS bm25 FROM c, st WHERE {some} ORDER BY bm25 DESC, chunk_id LIMIT {k}))"""


@query("bm25_topk", f"WITH {SCOPED}, {_bm25_sql(300)} SELECT * FROM b")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_topk(search.scoped(chunks(spark, sf_dir), "src0"), TERMS)


FUSED = f"{SCOPED}, {DENSE_LEG}, {SPARSE_LEG}, f AS (SELECT chunk_id, sim, dense_rank, hits, sparse_rank, coalesce(1 / (60.0::DOUBLE + dense_rank), 0) + coalesce(1 / (60.0::DOUBLE + sparse_rank), 0) AS rrf FROM d FULL JOIN s USING (chunk_id))"


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = search.scoped(chunks(spark, sf_dir, True), "src0")
    return base, search.rrf(search.dense_topk(base, _vector(spark, sf_dir), floor=0.05), search.sparse_topk(base, search.parse_query(TEXT).words))


@query("rrf_fuse", f"WITH {FUSED} SELECT chunk_id, sim, dense_rank, hits, sparse_rank, round(rrf, 5) AS rrf FROM f")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)[1].withColumn("rrf", F.round("rrf", 5))


BOOST = """h AS (SELECT f.*, base.* EXCLUDE (chunk_id), lower(concat_ws(' ', header, locator)) AS lab FROM f JOIN base USING (chunk_id)),
m AS (SELECT *, contains(lower(content), 'the and') OR contains(lab, 'the and') AS ph, lower(header) = '2.1' OR contains(lab, '2.1') AS inh FROM h),
n AS (SELECT *, least(CASE WHEN ph THEN 0.10 ELSE 0 END::DOUBLE + CASE WHEN inh THEN 0.08 WHEN contains(lower(content), '2.1') THEN 0.04 ELSE 0 END::DOUBLE, 0.12) AS boost FROM m)"""


@query("boosted_search", f"WITH {FUSED}, {BOOST} SELECT chunk_id, round(boost, 5) AS boost, round(rrf + boost, 5) AS rrf, ph AS phrase_boost, inh AS section_boost FROM n")
def boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, hits = _fused(spark, sf_dir)
    q = search.parse_query('Section 2.1 "the and"')
    out = search.boosted(base.join(F.broadcast(hits), "chunk_id"), q.phrases, q.section)
    return out.select("chunk_id", F.round("boost", 5).alias("boost"), F.round("rrf", 5).alias("rrf"), "phrase_boost", "section_boost")


QSET = "list_distinct(regexp_extract_all(lower('" + TEXT + "'), '[\\p{L}\\p{N}_]+'))"
LEX = f"""r AS (SELECT *, {QSET} AS qw, list_distinct({WORDS}) AS tw FROM h),
x AS (SELECT *, CASE WHEN len(tw) = 0 THEN 0 ELSE round(0.6::DOUBLE * len(list_intersect(qw, tw)) / len(list_distinct(list_concat(qw, tw))) + 0.4::DOUBLE * len(list_intersect(qw, tw)) / len(qw), 5) END AS rs FROM r),
y AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, hits DESC NULLS LAST, sim DESC NULLS LAST, chunk_id) AS pos FROM x),
z AS (SELECT *, CASE WHEN pos <= 30 THEN rs END AS rerank_score FROM y)"""


@query(
    "rerank_lexical",
    f"WITH {FUSED}, h AS (SELECT f.*, base.* EXCLUDE (chunk_id) FROM f JOIN base USING (chunk_id)), {LEX} SELECT chunk_id, rerank_score, row_number() OVER (ORDER BY (rerank_score IS NULL), rerank_score DESC, rrf DESC, pos) AS position FROM z",
)
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, hits = _fused(spark, sf_dir)
    return search.reranked(base.join(F.broadcast(hits), "chunk_id"), TEXT).select("chunk_id", "rerank_score", "position")


HYBRID = TEXT + ' "of the" -worthless'


def _sparse_leg(text: str, without: str) -> str:
    hits = " + ".join(f"(contains(lower(concat_ws(' ', content, header, locator)), '{w}'))::INT" for w in search.parse_query(text).words)
    top = f"SELECT chunk_id, ({hits})::DOUBLE AS hits FROM base WHERE ({hits}) > 0 ORDER BY hits DESC, chunk_id LIMIT 25"
    return f"s AS (SELECT chunk_id, hits, row_number() OVER (ORDER BY hits DESC, chunk_id) AS sparse_rank FROM ({top}) JOIN base USING (chunk_id) WHERE {without})"


NOT_WORTHLESS = "NOT contains(lower(concat(content, ' ', header)), 'worthless')"


def _distinct_sql(source: str, limit: int) -> str:
    """Greedy suppression: a walk over the candidates in order that carries what was kept."""
    near = "len(list_filter(kept, lambda k: len(k) > 0 AND len(c.w) > 0 AND len(list_intersect(k, c.w))::DOUBLE / least(len(k), len(c.w)) > 0.85)) > 0"
    return f"""cand AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> '')[1:60]) AS w FROM {source}),
g AS (SELECT 0::BIGINT AS p, []::VARCHAR[][] AS kept, []::VARCHAR[] AS hs, []::BIGINT[] AS ids UNION ALL
SELECT p + 1, CASE WHEN ok THEN list_append(kept, w) ELSE kept END, CASE WHEN ok THEN list_append(hs, source_hash) ELSE hs END, CASE WHEN ok THEN list_append(ids, chunk_id) ELSE ids END
FROM (SELECT g.*, c.w, c.source_hash, c.chunk_id, (len(ids) < {limit} AND NOT list_contains(hs, c.source_hash) AND NOT ({near})) AS ok FROM g JOIN cand c ON c.position = g.p + 1)),
picked AS (SELECT * FROM cand WHERE list_contains((SELECT ids FROM g ORDER BY p DESC LIMIT 1), chunk_id))"""


@query(
    "hybrid_search",
    f"""WITH RECURSIVE {SCOPED}, {Q0}, d AS (SELECT chunk_id, sim, row_number() OVER (ORDER BY sim DESC, chunk_id) AS dense_rank FROM ({DENSE_TOP}) JOIN base USING (chunk_id) WHERE {NOT_WORTHLESS}),
{_sparse_leg(HYBRID, NOT_WORTHLESS)}, f AS (SELECT chunk_id, sim, dense_rank, hits, sparse_rank, coalesce(1 / (60.0::DOUBLE + dense_rank), 0) + coalesce(1 / (60.0::DOUBLE + sparse_rank), 0) AS rrf FROM d FULL JOIN s USING (chunk_id)),
h AS (SELECT f.*, base.* EXCLUDE (chunk_id), contains(lower(content), 'of the') OR contains(lower(concat_ws(' ', header, locator)), 'of the') AS ph FROM f JOIN base USING (chunk_id)),
n AS (SELECT *, rrf + CASE WHEN ph THEN 0.10::DOUBLE ELSE 0 END AS total FROM h), o AS (SELECT *, row_number() OVER (ORDER BY total DESC, hits DESC NULLS LAST, sim DESC NULLS LAST, chunk_id) AS position FROM n),
{_distinct_sql('o', 5)} SELECT position, chunk_id, round(total, 5) AS score, concat(filename, ' p.', page, ' ', header) AS citation,
concat_ws(',', 'dense_rank_' || dense_rank, 'sparse_rank_' || sparse_rank, CASE WHEN ph THEN 'quoted_phrase_match' END) AS reasons FROM picked""",
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(chunks(spark, sf_dir, True), HYBRID, "src0", _vector(spark, sf_dir), floor=0.05).select("position", "chunk_id", "score", "citation", F.concat_ws(",", "match_reasons").alias("reasons"))


@query(
    "near_dup",
    f"""WITH RECURSIVE {FUSED}, h AS (SELECT f.*, base.* EXCLUDE (chunk_id) FROM f JOIN base USING (chunk_id)), {LEX},
o AS (SELECT *, row_number() OVER (ORDER BY (rerank_score IS NULL), rerank_score DESC, rrf DESC, pos) AS position FROM z), {_distinct_sql('o', 20)} SELECT position, chunk_id FROM picked""",
)
def near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, hits = _fused(spark, sf_dir)
    return search.distinct_hits(search.reranked(base.drop("embedding").join(F.broadcast(hits), "chunk_id"), TEXT), 20).select("position", "chunk_id")


@query(
    "near_dup_pairs",
    f"""WITH {CHUNKS}, s AS (SELECT chunk_id, list_sort(list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> '')[1:60])) AS w FROM chunks),
g AS (SELECT w, min(chunk_id) AS set_id, count(*) AS copies FROM s GROUP BY w),
p AS (SELECT a.set_id AS a, b.set_id AS b FROM g a JOIN g b ON a.set_id < b.set_id WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w))::DOUBLE / least(len(a.w), len(b.w)) > 0.85),
n AS (SELECT set_id, count(*) AS n_links FROM (SELECT a AS set_id FROM p UNION ALL SELECT b FROM p) GROUP BY set_id)
SELECT chunk_id, set_id, copies, coalesce(n_links, 0) AS n_links FROM s JOIN g USING (w) LEFT JOIN n USING (set_id)""",
)
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return overlap.members(rows, overlap.near_dup_pairs(rows)[1])


ASKED = ["thing eror onhentha", "the and worthless the", "con que los", "der und die -keit"]


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asks, in the workspace of the document of its number."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").join(table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("vec_id") == F.col("doc_id"))
    return e.select(F.col("vec_id").alias("query_id"), pick(ASKED, F.expr("vec_id div 20")).alias("text"), F.col("source").alias("workspace"), "embedding")


def _words(texts: list[str]) -> str:
    return "[" + ", ".join("[" + ", ".join(map(quoted, search.parse_query(t).words)) + "]" for t in texts) + "]"


@query(
    "batch_legs",
    f"""WITH {CHUNKS}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, source AS ws, {_words(ASKED)}[((vec_id // 20) % {len(ASKED)} + 1)::BIGINT] AS words FROM embeddings JOIN documents ON vec_id = doc_id WHERE vec_id % 20 = 0),
b AS (SELECT chunk_id, workspace, lower(concat_ws(' ', content, header, locator)) AS t, embedding::DOUBLE[] AS v FROM chunks LEFT JOIN embeddings ON vec_id = chunk_id WHERE NOT is_superseded),
p AS (SELECT query_id, chunk_id, round(list_dot_product(v, qv), 6) AS sim, len(list_filter(words, lambda x: contains(t, x)))::DOUBLE AS hits FROM q JOIN b ON workspace = ws),
d AS (SELECT * FROM (SELECT query_id, chunk_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS dense_rank FROM p WHERE sim >= 0.05) WHERE dense_rank <= 25),
s AS (SELECT * FROM (SELECT query_id, chunk_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS sparse_rank FROM p WHERE hits > 0) WHERE sparse_rank <= 25)
SELECT query_id, chunk_id, sim, dense_rank, hits, sparse_rank, round(coalesce(1 / (60.0::DOUBLE + dense_rank), 0) + coalesce(1 / (60.0::DOUBLE + sparse_rank), 0), 5) AS rrf FROM d FULL JOIN s USING (query_id, chunk_id)""",
)
def batch_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [(r["query_id"], search.parse_query(r["text"]), r["workspace"], r["embedding"]) for r in _queries(spark, sf_dir).collect()]
    dense, sparse = search.batch_legs(search.readable(chunks(spark, sf_dir, True)), asked, 0.05)
    return search.rrf(dense, sparse, by=("query_id", "chunk_id")).withColumn("rrf", F.round("rrf", 5))


@query("batch_search")
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_batch(chunks(spark, sf_dir, True), _queries(spark, sf_dir), floor=0.05).select("query_id", "rank", "chunk_id", "score", "citation")


# A stored index. Every document whose id is divisible by 20 asks for its first four words.

INDEXED = [("header", 2.0), ("heading_path", 1.5), ("content", 1.0)]
TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
ASKING = f"q AS (SELECT query_id, unnest(t) AS term, generate_subscripts(t, 1) AS i, len(t) AS need FROM (SELECT doc_id AS query_id, list_distinct({TOKENS.format('text')}[1:4]) AS t FROM documents WHERE doc_id % 20 = 0))"


def _indexed(spark: SparkSession, sf_dir: str, ask: Callable[[postings.Index, list], DataFrame]) -> DataFrame:
    """Builds an index of all chunks in the shared folder, and asks it."""
    index = postings.Index(spark, versions.scratch(spark, "index"), [f for f, _ in INDEXED], [w for _, w in INDEXED], "plain", parts=2, buckets=8)
    index.put(chunks(spark, sf_dir).select("doc_id", "chunk_id", *index.fields))
    asking = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1)), 1, 4).alias("words"))
    return reduce(DataFrame.unionByName, [ask(index, [tuple(r) for r in rows]) for rows in search.blocks_of(asking, postings.QUERIES)])


BM25_POSTINGS = f"""WITH {CHUNKS}, {ASKING}, w AS (SELECT chunk_id, unnest({TOKENS.format('header')}) AS term, 3.5::DOUBLE AS w, 2 AS n FROM chunks
UNION ALL SELECT chunk_id, unnest({TOKENS.format('content')}), 1.0, 1 FROM chunks), len AS (SELECT chunk_id, sum(n) AS len FROM w GROUP BY chunk_id),
st AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT sum(len) FROM len) / (SELECT count(*) FROM chunks) AS mean), tf AS (SELECT chunk_id, term, sum(w) AS tf FROM w GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), sc AS (SELECT query_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS bm25
FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (chunk_id), st GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS bm25_rank FROM sc) WHERE bm25_rank <= 10"""


@query("bm25_postings", BM25_POSTINGS)
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of the queries' terms are scored."""
    return _indexed(spark, sf_dir, lambda index, asked: index.bm25(asked, 10, pruned=False))


@query("bm25_pruned", BM25_POSTINGS)
def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the blocks that can reach the best ten."""
    return _indexed(spark, sf_dir, lambda index, asked: index.bm25(asked, 10))


@query(
    "cover_density",
    f"""WITH {CHUNKS}, {ASKING}, e AS (SELECT query_id, chunk_id, need, i, p, row_number() OVER o AS j FROM q JOIN (SELECT chunk_id, unnest(t) AS term, generate_subscripts(t, 1) AS p FROM (SELECT chunk_id, {TOKENS.format('content')} AS t FROM chunks)) USING (term) WINDOW o AS (PARTITION BY query_id, chunk_id ORDER BY p)),
l AS (SELECT query_id, chunk_id, p, j, least({', '.join(f'CASE WHEN need < {i} THEN 1::BIGINT << 60 ELSE coalesce(max(CASE WHEN i = {i} THEN (p::BIGINT << 30) + j END) OVER o, -1) END' for i in range(1, 5))}) AS low FROM e WINDOW o AS (PARTITION BY query_id, chunk_id ORDER BY p)),
c AS (SELECT query_id, chunk_id, low, min(p) AS p, min(j) AS j FROM l WHERE low >= 0 GROUP BY ALL),
d AS (SELECT query_id, chunk_id, round(sum(0.1::DOUBLE / (1 + (p - (low >> 30)) - (j - (low & ((1::BIGINT << 30) - 1))))), 6) AS density FROM c GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY density DESC, chunk_id) AS density_rank FROM d) WHERE density_rank <= 25""",
)
def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, lambda index, asked: index.cover_density(asked, 25))


CARTRIDGE = "SELECT chunk_id, bm25_rank, bm25, doc_type, workspace FROM b JOIN base USING (chunk_id)"


@query("cartridge_join", f"WITH {SCOPED}, {_bm25_sql(300)} {CARTRIDGE}")
def cartridge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = search.scoped(chunks(spark, sf_dir), "src0")
    return base.join(F.broadcast(search.bm25_topk(base, TERMS)), "chunk_id").select("chunk_id", "bm25_rank", "bm25", "doc_type", "workspace")


@query(
    "cartridge_search",
    f"""WITH {SCOPED}, {Q0}, {_bm25_sql(300)}, e AS (SELECT b.chunk_id, bm25_rank - 1 AS r, coalesce(round(list_cosine_similarity(embedding::DOUBLE[], qv), 6), 0) AS score
FROM b LEFT JOIN embeddings ON vec_id = b.chunk_id, q) SELECT chunk_id, score, round(score + 0.05::DOUBLE * 60 / (60 + r), 6) AS sort_score FROM e ORDER BY sort_score DESC, score DESC, r, chunk_id LIMIT 10""",
)
def cartridge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = search.scoped(chunks(spark, sf_dir, True), "src0")
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir)])
    rows = base.join(F.broadcast(search.bm25_topk(base, TERMS)), "chunk_id").withColumn("r", F.col("bm25_rank") - 1)
    rows = rows.withColumn("score", F.coalesce(F.round(cosine(F.col("embedding"), q), 6), F.lit(0.0))).withColumn("sort_score", F.round(F.col("score") + 0.05 * 60 / (60 + F.col("r")), 6))
    return rows.orderBy(F.desc("sort_score"), F.desc("score"), "r", "chunk_id").limit(10).select("chunk_id", "score", "sort_score")


# Scalars ------------------------------------------------------------------------------------------------------------


@query("source_hash", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS source_hash FROM documents")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.source_hash(F.col("text")).alias("source_hash"))


@query("model_checksum", "SELECT DISTINCT lang, concat('sha256:', sha256(lower(concat('Dummy:', lang, ':1024')))) AS checksum FROM documents")
def model_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang").distinct().select("lang", T.model_checksum(F.lit("Dummy"), F.col("lang"), F.lit(1024)).alias("checksum"))


@query("short_id", "SELECT page_id, (concat('0x', substr(md5(url), 1, 8)))::BIGINT & 2147483647 AS short_id FROM pages")
def short_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.short_id(F.col("url")).alias("short_id"))


@query("token_estimate", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(trim(text)) // 4) END::BIGINT AS tokens, text[:140] AS snippet FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), F.substring("text", 1, 140).alias("snippet"))


@query("sentence_split", "WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents) SELECT doc_id, len(p)::BIGINT AS n_sentences, p[1] AS first, p[len(p)] AS last FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("n_sentences"), F.get("p", F.lit(0)).alias("first"), F.get("p", F.size("p") - 1).alias("last"))


def _topic_sql() -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(t, '{p}')" for p in phrases) + f" THEN '{name}'" for name, phrases in T.TOPICS)
    return f"SELECT doc_id, CASE {whens} ELSE 'General' END AS topic FROM (SELECT doc_id, lower(concat_ws(' ', source, text)) AS t FROM documents)"


@query("topic_infer", _topic_sql())
def topic_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.topic(F.col("source"), F.col("text")).alias("topic"))


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(
    "match_terms",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
f AS (SELECT doc_id, w[i] AS t, min(i) AS i FROM u GROUP BY doc_id, w[i]),
g AS (SELECT *, (length(t) >= 2 OR regexp_matches(t, '^[0-9]+$')) AS ok, t IN ({STOP}) AS stop FROM f),
k AS (SELECT *, max((ok AND NOT stop)::INT) OVER (PARTITION BY doc_id) AS a, max(ok::INT) OVER (PARTITION BY doc_id) AS b FROM g),
c AS (SELECT doc_id, t, i, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY regexp_matches(t, '[0-9]') DESC, length(t) DESC, i) AS r FROM k WHERE CASE WHEN a = 1 THEN ok AND NOT stop WHEN b = 1 THEN ok ELSE true END)
SELECT doc_id, coalesce(CASE WHEN any_value(n) > 28 THEN string_agg(t, ' ' ORDER BY r) ELSE string_agg(t, ' ' ORDER BY i) END, '') AS terms FROM documents LEFT JOIN (SELECT * FROM c WHERE r <= 28) USING (doc_id) GROUP BY doc_id""",
)
def match_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", T.match_terms(F.col("text"))).alias("terms"))


HEADS = [
    "# Terms of {}", "### {}", "ARTICLE IV {}", "Section 1.2 {}", "§ 8.22.030 {}", "8.22.030 {}", "(a) {}", "GENERAL PROVISIONS", "Exhibit B {}", "Clause 7", "Subsection {}", "{}", "Chapter 2 of {}",
    "19.3 {}", "Art. V", "Title III {}", "Sec. 12", "TENANT'S DUTY", "CIVIL CODE Section 5", "{} Section 9", "Intro .... 4", "Page 3 of 9", "RENT; FEES",
]


def _level_sql(h: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(lower(trim({h})), '{p}') THEN " + (f"CASE WHEN len(regexp_extract_all(lower(trim({h})), '\\.\\d+')) >= 2 THEN 3 ELSE 2 END" if n == 2 else str(n)) for n, p in T.LEVELS)
    return f"(CASE WHEN starts_with(lower(trim({h})), '#') THEN least(length(regexp_extract({h}, '^(#*)', 1)), 4) {rules} WHEN {h} = upper({h}) AND {h} <> lower({h}) THEN 1 ELSE 2 END)::BIGINT"


@query("heading_level", f"SELECT doc_id, line_no, {_level_sql('line')} AS level, trim(regexp_replace(trim(lower(line)), '{T.SECTION_WORD}', '')) AS token FROM {lines_sql(HEADS)}")
def heading_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, HEADS).select("doc_id", "line_no", T.heading_level(F.col("line")).alias("level"), T.norm_citation(F.col("line")).alias("token"))


HEADER_SQL = f"""WITH l AS (SELECT doc_id, line_no, trim(line) AS line FROM {lines_sql(HEADS)}),
r AS (SELECT *, regexp_extract(line, '(?i){T.SECTION_REFERENCE}') AS ref, trim(regexp_extract(line, '(?i)^(.*?){T.SECTION_REFERENCE}', 1)) AS before FROM l WHERE length(line) BETWEEN 1 AND {T.LINE_MOST} AND NOT regexp_matches(line, '{T.NOISE_LINE}') AND NOT regexp_matches(line, '{T.TOC_LINE}')),
h AS (SELECT doc_id, line_no, CASE WHEN starts_with(line, '#') THEN trim(regexp_replace(line, '^#+', ''))
WHEN ref <> '' THEN CASE WHEN before = '' OR (before = upper(before) AND before <> lower(before) AND length(before) <= {T.PREFIX_MOST}) THEN CASE WHEN length(line) <= {T.TITLE_MOST} THEN line ELSE regexp_replace(ref, '[ :.\\-—]+$', '') END END
WHEN line = upper(line) AND line <> lower(line) AND length(line) BETWEEN {T.CAPITALS[0]} AND {T.CAPITALS[1]} AND NOT regexp_matches(line, '[.;!?]')
THEN array_to_string(list_transform(regexp_extract_all(line, '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(w[1]) || lower(w[2:])), '') END AS heading FROM r)
SELECT * FROM h WHERE heading IS NOT NULL"""


@query("header_lines", HEADER_SQL)
def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are headings, over all lines of the corpus."""
    return lines(spark, sf_dir, HEADS).select("doc_id", "line_no", T.heading(T.strip(F.col("line"))).alias("heading")).where("heading is not null")


STATUTES = ["Cal. Civ. Code § 1950.5 {}", "Section 8.22.030(C) {}", "Art. IV", "Code Article 7, part 2", "see 1950.5(a)(2) for {}", "a rate of 12.5 applies", "{}", "Clause 7-2 and § 9 {}"]


@query(
    "statute_norm",
    f"""WITH r AS (SELECT doc_id, line_no, regexp_extract(line, '{T.SECTION_FORMS[0]}', 1) AS a, regexp_extract(line, '{T.SECTION_FORMS[1]}', 1) AS b, regexp_extract(line, '{T.SECTION_FORMS[2]}', 1) AS c, trim(regexp_extract(line, '(?i)(?:(?:Code|U[.]S[.]C[.]|Stat[.]|C[.]F[.]R[.])\\s*)?(?:§+|Section|Sec[.]|Article|Art[.]|Clause|Exhibit)\\s*[0-9A-Za-z.:-]+(?:[(][0-9A-Za-z]+[)])*(?:\\s+[A-Za-z0-9\\s,":''-]{{0,60}})?')) AS whole FROM {lines_sql(STATUTES)}),
n AS (SELECT doc_id, line_no, whole, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE c END AS section_number FROM r)
SELECT doc_id, line_no, section_number, regexp_replace(lower(section_number), '[^a-z0-9]', '', 'g') AS token, section_number <> '' AS matched,
CASE WHEN section_number = '' THEN '' WHEN lower(whole) LIKE 'art%' THEN whole ELSE concat('§ ', section_number) END AS canonical FROM n""",
)
def statute_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lines(spark, sf_dir, STATUTES).select("doc_id", "line_no", T.statute_citation(F.col("line")).alias("c"))
    return n.select("doc_id", "line_no", "c.section_number", F.col("c.normalized_token").alias("token"), "c.matched", F.col("c.canonical_token").alias("canonical"))


CITES = {"page": [3, 3, None, None, 1, None, 9, None, 2], "loc": [None, None, "Intro > Scope", "Rows 1-30", None, None, "Page 9", None, None], "head": ["Rent", "Section 4", "Scope", "General", None, "# Title", "Table 2", "", "Exhibit C"], "printed": [None, "iii", None, None, "1", None, " 8 ", None, None]}
CITED = f"(SELECT doc_id, concat('doc_', doc_id, '.txt') AS f, {', '.join(f'{pick_sql(v, "doc_id")} AS {c}' for c, v in CITES.items())} FROM documents)"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = [pick([F.lit(x).cast("long" if c == "page" else "string") for x in v], F.col("doc_id")).alias(c) for c, v in CITES.items()]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("f"), *marks)


@query(
    "citation_format",
    f"""WITH l AS (SELECT *, CASE WHEN page IS NULL AND coalesce(loc, '') <> '' THEN loc WHEN coalesce(head, '') = '' THEN loc ELSE head END AS label FROM {CITED}),
t AS (SELECT *, trim(regexp_replace(trim(coalesce(label, '')), '^#+', '')) AS s, trim(coalesce(printed, '')) AS pr FROM l)
SELECT doc_id, concat_ws(' ', f, CASE WHEN page IS NOT NULL THEN concat('p.', page, CASE WHEN pr <> '' AND pr <> page::VARCHAR THEN concat(' [printed: ', pr, ']') ELSE '' END) END,
CASE WHEN s = '' THEN NULL WHEN starts_with(s, '§') OR regexp_matches(lower(s), '^(?:{"|".join(T.PLAIN_LABELS)})') THEN s ELSE concat('§ ', s) END) AS citation FROM t""",
)
def citation_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select("doc_id", T.citation(F.col("f"), F.col("page"), F.col("loc"), F.col("head"), F.col("printed")).alias("citation"))


PARTS = "list_filter(list_transform(string_split(coalesce({0}, ''), '>'), lambda x: trim(x)), lambda x: x <> '')"


@query(
    "locator_struct",
    f"""WITH a AS (SELECT *, CASE WHEN head <> '' AND head <> 'General' THEN head END AS hd, contains(lower(coalesce(loc, '')), 'row') AS rw FROM {CITED}),
b AS (SELECT *, CASE WHEN page IS NOT NULL THEN list_concat([concat('Page ', page)], CASE WHEN hd IS NOT NULL THEN [hd] ELSE {PARTS.format('loc')} END) WHEN rw THEN [loc]
ELSE {PARTS.format("CASE WHEN coalesce(loc, '') = '' THEN hd ELSE loc END")} END AS path FROM a)
SELECT doc_id, CASE WHEN page IS NOT NULL THEN 'page' WHEN rw THEN 'row_range' ELSE 'heading' END AS kind, array_to_string(path, '/') AS path,
CASE WHEN page IS NOT NULL THEN concat('Page ', page) WHEN rw THEN loc WHEN len(path) > 0 THEN array_to_string(path, ' > ') ELSE 'General' END AS formatted FROM b""",
)
def locator_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cited(spark, sf_dir).select("doc_id", T.locator(F.col("page"), F.col("loc"), F.col("head")).alias("l"))
    return d.select("doc_id", "l.kind", F.concat_ws("/", "l.path").alias("path"), "l.formatted")


FILES = ["Master_{}-Agreement.pdf", "a/b\\c__{}.docx", "{}.txt", "archive.{}.tar.gz", "  Plain  {}.HTML ", "x/../ev!l{}?.md"]


@query(
    "doc_title",
    f"""WITH n AS (SELECT doc_id, {marked_sql("source || '_' || doc_id", FILES, 'doc_id')} AS f FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(f), '{T.DOC_ENDING}', ''), '[/\\\\_\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title, regexp_replace(regexp_extract(f, '([^/\\\\]*)$', 1), '[^\\p{{L}}\\p{{N}}._\\- ]', '', 'g') AS safe_name FROM n""",
)
def doc_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = marked(F.concat_ws("_", "source", F.col("doc_id").cast("string")), FILES, F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", T.doc_title(f).alias("title"), T.safe_filename(f).alias("safe_name"))


@query("contextual_text", f"WITH {CHUNKS} SELECT chunk_id, sha256(concat_ws(chr(10), concat('Document: ', replace(replace(filename, '.txt', ''), '_', ' ')), concat('Section: ', header), content)) AS embed_hash FROM chunks")
def contextual_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    path = F.concat(F.array(F.lit("General"), F.col("locator")), F.col("heading_path"), F.col("heading_path"))
    return c.select("chunk_id", F.sha2(T.contextual(F.col("content"), F.col("filename"), path, F.col("header")), 256).alias("embed_hash"))


# Structure ----------------------------------------------------------------------------------------------------------

NOISY = ["Page 3 of 12", "12/40", "- 7 -", "42", "CONFIDENTIAL", "ABC_000123", "EXHIBIT B", "FAX from {}", "Case 1:22-cv-0001 {}", "Section 1950", "{}", "{} ........ 3", "Part II ____ ix", "{}"]


@query("noise_lines", f"SELECT doc_id, line_no, regexp_matches(trim(line), '{T.NOISE_LINE}') AS noise, regexp_matches(trim(line), '{T.TOC_LINE}') AS toc FROM {lines_sql(NOISY)}")
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, NOISY).select("doc_id", "line_no", T.is_noise(F.col("line")).alias("noise"), T.is_toc_line(F.col("line")).alias("toc"))


@query(
    "paragraphs",
    f"""WITH x AS (SELECT conv_id * 1000 + turn AS k, text || chr(10) || chr(10) || role || chr(10) || '42' || chr(10) || text AS text FROM conversations),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM x),
t AS (SELECT k, i, trim(line) AS line, (trim(line) = '' OR regexp_matches(trim(line), '{T.NOISE_LINE}')) AS gap FROM l),
g AS (SELECT *, sum(gap::INT) OVER (PARTITION BY k ORDER BY i) AS run FROM t)
SELECT k, (row_number() OVER (PARTITION BY k ORDER BY run) - 1)::BIGINT AS paragraph, content FROM (SELECT k, run, string_agg(line, chr(10) ORDER BY i) AS content FROM g WHERE NOT gap GROUP BY k, run)""",
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    d = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.concat("text", F.lit("\n\n"), "role", F.lit("\n42\n"), "text").alias("text"))
    return structure.paragraphs(d, "k").withColumn("paragraph", F.col("paragraph").cast("long"))


@query(
    "csv_rowgroups",
    """WITH n AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, concat('| ', concat_ws(' | ', p_partkey::VARCHAR, p_name, p_type), ' |') AS l FROM part)
SELECT p_brand, ((n - 1) // 30)::BIGINT AS page_seq, concat('Rows ', min(n), '-', max(n)) AS locator, string_agg(l, chr(10) ORDER BY n) AS content FROM n GROUP BY ALL""",
)
def csv_rowgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.row_groups(table(spark, sf_dir, "part"), "p_brand", "p_partkey", ["p_partkey", "p_name", "p_type"])


PAGE_TEXT = "concat('Talk ', conv_id, chr(10), 'Held by ', role, chr(10), text, chr(10), CASE WHEN turn % 2 = 0 THEN 'Draft' ELSE 'Final' END, chr(10), 'Page foot')"


@query(
    "boilerplate_lines",
    f"""WITH x AS (SELECT conv_id AS doc, list_filter(list_transform(string_split({PAGE_TEXT}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations),
e AS (SELECT doc, unnest(list_distinct(list_concat(l[1:2], CASE WHEN len(l) > 2 THEN l[greatest(3, len(l) - 1):] ELSE [] END))) AS line FROM x),
n AS (SELECT doc, count(*) AS total FROM x GROUP BY doc) SELECT e.doc, line, count(*) AS n_pages FROM e JOIN n USING (doc) GROUP BY e.doc, line, total HAVING count(*) >= greatest(2, total / 2) AND total >= 2""",
)
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations stand in for documents, their turns for pages."""
    return structure.running_lines(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.expr(PAGE_TEXT.replace("chr(10)", "char(10)")).alias("text")))


TREE = ["ARTICLE I {}", "Section 1.1 {}", "(a) First", "(b) Second", "Section 1.2", "Article II", "2.1 {}", "(a) Base", "Preamble", "(x) Orphan", "{}"]


@query(
    "toc_tree",
    f"""WITH t AS (SELECT source AS doc, doc_id AS chunk_index, {marked_sql('lang', TREE, 'doc_id')} AS title FROM documents),
h AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(lower(trim(title)), '{p}') THEN {n}" for n, p in T.TREE_LEVELS)} ELSE 1 END AS level FROM t)
SELECT doc, chunk_index, title, level::BIGINT AS level, (SELECT max(p.chunk_index) FROM h p WHERE p.doc = h.doc AND p.chunk_index < h.chunk_index AND p.level < h.level)::BIGINT AS parent_index FROM h""",
)
def toc_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return structure.contents_tree(d.select(F.col("source").alias("doc"), F.col("doc_id").alias("chunk_index"), marked(F.col("lang"), TREE, F.col("doc_id")).alias("title")))


EXHIBITS = {"header": ["Exhibit A {}", "Rent", "exhibit a again", "Appendix IV.{}", "Body of {}"], "locator": [None, "schedule 2.b", None, "Page 3", None, "addendum {}", "Rows 1-2"]}
EXHIBIT_SQL = r"(?i)\b(Exhibit|Schedule|Appendix|Addendum)\s+([A-Z0-9]+(?:[.\-][A-Z0-9]+)*)"


@query(
    "exhibit_manifest",
    f"""WITH c AS (SELECT source AS doc, doc_id AS i, {marked_sql('lang', EXHIBITS['header'], 'doc_id')} AS h, {marked_sql('lang', EXHIBITS['locator'], 'doc_id')} AS l FROM documents),
m AS (SELECT *, regexp_extract(concat_ws(' ', h, l), '{EXHIBIT_SQL}', 1) AS k, regexp_extract(concat_ws(' ', h, l), '{EXHIBIT_SQL}', 2) AS x FROM c)
SELECT doc, concat(upper(k[1]), lower(k[2:]), ' ', upper(x)) AS identifier, min(i)::BIGINT AS chunk_index, arg_min(h, i) AS title FROM m WHERE k <> '' GROUP BY 1, 2""",
)
def exhibit_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [marked(F.col("lang"), EXHIBITS[c], F.col("doc_id")).alias(c) for c in EXHIBITS]
    return structure.exhibits(table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("chunk_index"), *named))


ATTACHED = {"header": ["Attachment: t.csv", None, "Attachment rates {}", "Rent"], "locator": ["Rows 1-30", "Attachment: {}.eml", None, "Page 1"]}


@query(
    "attachment_manifest",
    f"""WITH c AS (SELECT source AS doc, doc_id AS i, doc_id % 2 AS m, {marked_sql('lang', ATTACHED['header'], 'doc_id')} AS h, {marked_sql('lang', ATTACHED['locator'], 'doc_id')} AS l FROM documents),
m AS (SELECT *, trim(regexp_extract(trim(concat(coalesce(h, ''), ' ', coalesce(l, ''))), '(?i)\\bAttachment(?::\\s*|\\s+)([^\\n\\r]+)', 1)) AS x FROM c)
SELECT doc, x AS identifier, min(i)::BIGINT AS chunk_index, CASE WHEN arg_min(m, i) = 0 THEN 'email_attachment' ELSE 'embedded_attachment' END AS source FROM m WHERE x <> '' GROUP BY 1, 2""",
)
def attachment_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [marked(F.col("lang"), ATTACHED[c], F.col("doc_id")).alias(c) for c in ATTACHED]
    mime = F.when(F.col("doc_id") % 2 == 0, "message/rfc822").otherwise("text/plain")
    return structure.attachments(table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("chunk_index"), mime.alias("mime"), *named))


SECTIONS = [
    "A landlord shall not demand security in excess of one month's rent. The landlord must account within twenty-one days after {}. Bad faith carries statutory damages of up to twice the amount of the deposit. {}",
    "No increase may be more than 5% plus inflation, or 10%, whichever is lower. An owner needs at least 33% recorded ownership. {} Occupancy of at least twelve months is required!",
    "The provider warrants 99.95% monthly uptime. {} The customer may run up to 50 server nodes. Base rent shall be $12,500.00 per month. A 3.5% annual escalation holds.",
    "Notice within 14 days. Later notice within 30 calendar days. The tenant must cure within ten days. Each fine is $25.50 for each day. Relocation assistance is required. {}",
    "{}",
    "Two months' rent as a security deposit for 1,200 rentable square feet. Liability won't exceed fees paid in the preceding twelve months. The court may award reasonable attorney's fees; notice shall be given. {}",
    "A small landlord may take up to two months' rent. No more than 1 increment over any 12-month period. Damages of not less than $500 apply. Vacancy decontrol is known here. {} An allowance of $45.00 per rentable square foot.",
]


def _slots_sql() -> str:
    num = " ".join(f"WHEN raw = '{w}' THEN {v}" for w, v in structure.NUMBER_WORDS.items())
    groups = lambda p: len(re.findall(r"\((?!\?)", p))
    said = lambda text, p: "concat(" + ", ".join(f"regexp_extract({text}, {quoted(p)}, {i + 1})" for i in range(groups(p))) + ")"
    rules = [f"SELECT id, i, s, '{n}' AS slot, '{u}' AS unit, {said('lower(s)', p)} AS raw, false AS flag FROM e" for n, (u, p) in structure.SLOTS.items()]
    rules += [f"SELECT id, i, s, '{n}' AS slot, '{u}' AS unit, {said('s', p)} AS raw, false AS flag FROM e" for n, (u, p) in structure.SLOTS_AS_WRITTEN.items()]
    holds = lambda phrases: " OR ".join(f"contains(lower(s), {quoted(x)})" for x in phrases)
    rules += [f"SELECT id, i, s, '{n}' AS slot, NULL AS unit, CASE WHEN {holds(x)} THEN '1' ELSE '' END AS raw, true AS flag FROM e" for n, x in structure.FLAGS.items()]
    spoken = " OR ".join(f"(floor(value) = {v} AND contains(lower(s), '{w}'))" for w, v in structure.NUMBER_WORDS.items())
    return f"""WITH d AS (SELECT doc_id AS id, {marked_sql('text', SECTIONS, 'doc_id')} AS t FROM documents),
p AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM d), e AS (SELECT id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM p),
r AS ({" UNION ALL ".join(rules)}), v AS (SELECT *, coalesce(CASE WHEN regexp_matches(raw, '^[0-9]') THEN try_cast(replace(raw, ',', '') AS DOUBLE) {num} END::DOUBLE, 0) AS value FROM r WHERE raw <> ''),
g AS (SELECT * FROM v WHERE CASE WHEN flag THEN {holds(structure.FLAG_GROUNDS)} ELSE contains(lower(s), floor(value)::BIGINT::VARCHAR) OR {spoken} END)
SELECT id AS section_id, slot, arg_max(value, i) AS value, arg_max(unit, i) AS unit, arg_max(s, i) AS quoted_sentence FROM g GROUP BY 1, 2"""


@query("slots", _slots_sql())
def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.slots(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_id"), marked(F.col("text"), SECTIONS, F.col("doc_id")).alias("text")))


ENTRIES = {"citation": ["§ 1", "§ 1", None, "§ 2 {}", "", "§ 3 {}"], "topic": ["Rent", "", None, "Fees", "{}"]}


@query(
    "pack_validate",
    f"""WITH d AS (SELECT source AS p, doc_id AS n, {marked_sql('doc_id::VARCHAR', ENTRIES['citation'], 'doc_id')} AS c, {marked_sql('lang', ENTRIES['topic'], 'doc_id')} AS t, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE text END AS x FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY p, c ORDER BY n) > 1 AS again FROM d)
SELECT p AS pack_id, n AS entry_no, violation FROM (SELECT p, n, unnest([CASE WHEN coalesce(c, '') = '' THEN 'missing citation' END, CASE WHEN coalesce(c, '') <> '' AND again THEN 'duplicate citation' END,
CASE WHEN coalesce(t, '') = '' THEN 'missing topic' END, CASE WHEN trim(coalesce(x, '')) = '' THEN 'empty content' END, CASE WHEN length(trim(x)) // 4 > 850 THEN 'over token budget' END]) AS violation FROM e) WHERE violation IS NOT NULL""",
)
def pack_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    c, t = marked(k.cast("string"), ENTRIES["citation"], k), marked(F.col("lang"), ENTRIES["topic"], k)
    return structure.pack_violations(d.select(F.col("source").alias("pack_id"), k.alias("entry_no"), c.alias("citation"), t.alias("topic"), F.when(k % 10 == 0, " ").otherwise(F.col("text")).alias("raw_content")))


@query("bbox_union", "SELECT l_orderkey, round(min(l_quantity), 2) AS \"left\", round(min(l_linenumber), 2)::DOUBLE AS top, round(max(l_quantity + l_linenumber) - min(l_quantity), 2) AS width, round(max(l_linenumber + l_quantity) - min(l_linenumber), 2)::DOUBLE AS height FROM (SELECT l_orderkey, l_quantity::DOUBLE AS l_quantity, l_linenumber FROM lineitem) GROUP BY l_orderkey")
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    return structure.bbox_union(table(spark, sf_dir, "lineitem").select("l_orderkey", q.alias("left"), n.alias("top"), n.alias("width"), q.alias("height")), "l_orderkey")


# Corpus -------------------------------------------------------------------------------------------------------------


@query("quota_usage", "SELECT source AS workspace, coalesce(sum(length(text)), 0)::BIGINT AS used_chars, coalesce(sum(length(text)), 0) > 100000 AS over_quota FROM documents GROUP BY source")
def quota_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.quota_usage(chunks(spark, sf_dir), 100_000)


@query("workspace_counts", "SELECT r_name AS workspace, count(n_nationkey) AS n_documents FROM (SELECT r_name, r_regionkey FROM region UNION ALL SELECT r_name || ' II', 100 + r_regionkey FROM region) LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def workspace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("workspace"))
    r = r.unionByName(r.select(F.concat("name", F.lit(" II")).alias("name"), (F.col("workspace") + 100).alias("workspace")))  # without documents
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("workspace"))
    return corpus.workspace_counts(r, n).select(F.col("name").alias("workspace"), "n_documents")


@query("doc_listing", "SELECT c_custkey AS document_id, coalesce(n_name, 'Unknown') AS workspace_name FROM customer LEFT JOIN nation ON c_nationkey + (c_custkey % 2) * 20 = n_nationkey")
def doc_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), (F.col("c_nationkey") + F.col("c_custkey") % 2 * 20).alias("workspace_id"))
    w = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.col("n_name").alias("workspace_name"))
    return corpus.listing(d, w).select("document_id", "workspace_name")


@query("ledger_status", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.status_counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"))


@query("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.resume(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("import_remap", "SELECT o_orderkey AS chunk_id, r AS document_id FROM orders JOIN (SELECT c_custkey, 1000000 + c_custkey AS r FROM customer) ON o_custkey = c_custkey")
def import_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), (F.col("c_custkey") + 1_000_000).alias("new_document_id"))
    return corpus.remapped(rows, ids)


@query("embed_cache_join", "WITH h AS (SELECT doc_id, lang, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_hash FROM documents) SELECT doc_id AS chunk_id, text_hash, text_hash IN (SELECT text_hash FROM h WHERE lang = 'en') AS cached FROM h")
def embed_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    cache = c.where("doc_type = 'en'").select(F.col("source_hash").alias("text_hash"), F.lit("bge").alias("model")).distinct()
    return corpus.cache_split(c, cache, "bge").select("chunk_id", "text_hash", "cached")


@query("idempotent_probe", "WITH k AS (SELECT DISTINCT source, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents WHERE doc_id % 2 = 0) SELECT doc_id AS chunk_id, CASE WHEN (source, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g')))) IN (SELECT (source, h) FROM k) THEN 'skipped_duplicate' ELSE 'process' END AS action FROM documents")
def idempotent_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select("chunk_id", "workspace", F.col("source_hash").alias("file_hash"), F.lit("1").alias("parser_version"), F.lit("bge").alias("embedding_model"))
    return corpus.idempotent(c, c.where("chunk_id % 2 = 0").withColumn("status", F.lit("committed"))).select("chunk_id", "action")


@query("exact_dedup", "SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS source_hash, min(doc_id) AS chunk_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_dedup(chunks(spark, sf_dir).drop("source_hash"))


@query("lineage_version", "SELECT o_orderkey AS document_id, row_number() OVER w AS version, lead(o_orderkey) OVER w IS NOT NULL AS is_superseded FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate, o_orderkey)")
def lineage_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("workspace"), F.col("o_custkey").cast("string").alias("filename"), F.col("o_orderdate").alias("ingested_at"), F.col("o_orderkey").alias("document_id"))
    return corpus.lineage(d).select("document_id", "version", "is_superseded")


@query(
    "lineage_diff",
    """WITH v AS (SELECT l_orderkey AS filename, l_linenumber AS version, list_sort(list_distinct(flatten(list([l_returnflag, l_linestatus, concat('s', l_suppkey % 5), concat('p', l_partkey % 3)])))) AS h FROM lineitem GROUP BY ALL),
p AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY filename ORDER BY version), []) AS b FROM v)
SELECT filename, version, array_to_string(list_filter(h, lambda x: NOT list_contains(b, x)), ';') AS added, array_to_string(list_filter(b, lambda x: NOT list_contains(h, x)), ';') AS removed,
array_to_string(list_filter(h, lambda x: list_contains(b, x)), ';') AS retained FROM p""",
)
def lineage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand in for documents, line numbers for versions, and codes of lines for headers."""
    heads = F.array("l_returnflag", "l_linestatus", F.concat(F.lit("s"), F.col("l_suppkey") % 5), F.concat(F.lit("p"), F.col("l_partkey") % 3))
    v = table(spark, sf_dir, "lineitem").select(F.lit("w").alias("workspace"), F.col("l_orderkey").alias("filename"), F.col("l_linenumber").alias("version"), F.explode(heads).alias("h"))
    d = corpus.header_diff(v.groupBy("workspace", "filename", "version").agg(F.array_sort(F.collect_set("h")).alias("headers")))
    return d.select("filename", "version", *[F.concat_ws(";", c).alias(c) for c in ("added", "removed", "retained")])


SIBLINGS = ["lease{}.pdf", "lease{}_exhibit_A.pdf", "lease{}v2.Attachment.docx", "lease{}Exhibit B.pdf", "MSA{}.pdf", "MSA{}2.v2_Exhibit.pdf", "other_exhibit_{}.pdf"]


@query(
    "exhibit_siblings",
    f"""WITH d AS (SELECT source AS w, doc_id AS i, regexp_replace({marked_sql('(doc_id // 30)::VARCHAR', SIBLINGS, 'doc_id')}, '\\.[^.]*$', '') AS s FROM documents) SELECT a.w AS workspace, a.i AS document_id, b.i AS sibling_id, b.s AS sibling
FROM d a JOIN d b ON a.w = b.w AND a.i <> b.i AND starts_with(b.s, a.s) AND regexp_matches(lower(b.s), 'exhibit|attachment')""",
)
def exhibit_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return corpus.exhibit_siblings(table(spark, sf_dir, "documents").select(F.col("source").alias("workspace"), k.alias("document_id"), marked(F.expr("cast(doc_id div 30 as string)"), SIBLINGS, k).alias("filename")))


# Evaluation ---------------------------------------------------------------------------------------------------------


@query("eval_recall_mrr", "SELECT lang AS family, count(*) AS n, round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM (SELECT lang, CASE WHEN doc_id % 9 > 0 THEN doc_id % 9 END AS r FROM documents) GROUP BY lang")
def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return evals.recall_and_mrr(d.select(F.col("lang").alias("family"), F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 9 > 0, F.col("doc_id") % 9).alias("rank")))


@query(
    "eval_ndcg",
    """WITH h AS (SELECT doc_id // 10 AS query_id, doc_id % 10 + 1 AS rank, quality AS rel FROM labels), g AS (SELECT query_id, sum(CASE WHEN rank <= 5 AND rel > 0 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum((rel > 0)::INT) AS n FROM h GROUP BY 1)
SELECT query_id, round(CASE WHEN n = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, least(5, n)::BIGINT + 1), lambda r: 1 / log2(r + 1))) END, 4) AS ndcg FROM g""",
)
def eval_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.ndcg(table(spark, sf_dir, "labels").select(F.expr("doc_id div 10").alias("query_id"), (F.col("doc_id") % 10 + 1).alias("rank"), F.col("quality").alias("relevant")))


@query("eval_ece", "WITH b AS (SELECT least(floor(c * 5), 4) AS b, count(*) AS n, avg(c) AS c, avg(y::DOUBLE) AS a FROM (SELECT (doc_id % 101) / 100.0::DOUBLE AS c, quality AS y FROM labels) GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 4) AS ece FROM b")
def eval_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.calibration_error(table(spark, sf_dir, "labels").select(((F.col("doc_id") % 101) / 100.0).alias("confidence"), F.col("quality").alias("correct")))


@query(
    "eval_wilson",
    """WITH c AS (SELECT lang AS family, count(*)::DOUBLE AS n, sum((doc_id % 10 > 0)::INT) / count(*)::DOUBLE AS p FROM documents GROUP BY 1),
m AS (SELECT family, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS mid, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS s FROM c) SELECT family, round(greatest(0, mid - s), 4) AS low, round(least(1, mid + s), 4) AS high FROM m""",
)
def eval_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("family")).agg(F.sum((F.col("doc_id") % 10 > 0).cast("long")).alias("hits"), F.count("*").alias("n"))
    return evals.wilson(d)


CER = "round(least(1, levenshtein(lower(text), lower(replace(text, 'th', 'tb')))::DOUBLE / greatest(1, length(text))), 4) AS cer"
STRIPPED = "list_filter(list_transform(string_split_regex(lower({0}), '\\s+'), lambda w: trim(w, '.,;:!?()[]$\"''`')), lambda w: w <> '')"


@query(
    "eval_cer",
    f"""WITH w AS (SELECT *, {STRIPPED.format('text')} AS t, {STRIPPED.format("replace(text, 'th', 'tb')")} AS r FROM benchmark), v AS (SELECT *, list_distinct(list_concat(t, r)) AS v FROM w),
c AS (SELECT *, array_to_string(list_transform(t, lambda x: chr(list_position(v, x)::INT + 32)), '') AS tc, array_to_string(list_transform(r, lambda x: chr(list_position(v, x)::INT + 32)), '') AS rc FROM v)
SELECT item_id AS pair_id, {CER}, round(least(1, levenshtein(tc, rc)::DOUBLE / greatest(1, len(t))), 4) AS wer FROM c""",
)
def eval_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pair_id"), F.col("text").alias("truth"), F.replace("text", F.lit("th"), F.lit("tb")).alias("read"))
    return evals.error_rates(b).select("pair_id", "cer", "wer")


@query("latency_pct", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(CASE WHEN avg(value) > 0 THEN 1000.0::DOUBLE / avg(value) ELSE 0 END, 1) AS qps FROM events GROUP BY 1")
def latency_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.latency(table(spark, sf_dir, "events"), "event_type", "value")


@query("leakage", "SELECT round(avg((source <> 'src0')::INT::DOUBLE), 6) AS leakage FROM documents")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.leakage(table(spark, sf_dir, "documents").select(F.col("source").alias("workspace"), F.lit("src0").alias("expected")))


# Parsing, chunking and embedding -------------------------------------------------------------------------------------


@query("mime_sniff", "SELECT page_id, CASE WHEN starts_with(lower(ltrim(html)), '<!doctype html') OR starts_with(lower(ltrim(html)), '<html') OR contains(lower(html[:2048]), '<body') THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM pages")
def mime_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.mime(F.encode("html", "utf-8"), F.lit("x")).alias("mime"))


@query("html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.html_column(F.col("html")).alias("text"))


@query("ingest_gates", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'empty file' WHEN page_id % 5 = 1 THEN 'executable content' WHEN page_id % 5 = 2 THEN 'not a PDF' WHEN page_id % 5 = 3 THEN 'extension not accepted' END AS reject FROM pages")
def ingest_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    content = F.when(k == 0, F.unhex(F.lit(""))).when(k == 1, F.unhex(F.lit("4D5A9000"))).otherwise(F.encode("html", "utf-8"))
    ending = F.when(k == 2, "pdf").when(k == 3, "exe").otherwise("html")
    rows = table(spark, sf_dir, "pages").select("page_id", content.alias("content"), F.concat(F.lit("/w/f."), ending).alias("path")).withColumn("length", F.octet_length("content"))
    return rows.select("page_id", files.reject_reason(rows).alias("reject"))


def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("filename"), F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text"))).alias("pages"))


@query("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunker.chunk_documents(_as_files(spark, sf_dir)).select("doc_id", "chunk_index", "page", "header", "char_start", "char_end", "citation", "source_hash")


@query("embed_dummy")
def embed_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all chunks of all documents."""
    return chunker.chunk_documents(_as_files(spark, sf_dir)).select("doc_id", "chunk_index", embedding.embed(F.col("content"), dim=64).alias("embedding"))


LAWS = [
    "This act preempts local rules, and supersedes older acts. It is subject to Section 9; and exempted by Order 5. {}",
    '"Base Rent" means the rent. {} "Base Rent" shall mean the same. "Term" denotes the period.',
    "It supersedes nothing here. {}",
    "{}",
]


def _found_sql(pattern: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(t, '{pattern}', 1), lambda x: trim(x)), lambda x: x <> '')"


def _once(expr: str) -> str:
    return f"array_to_string(list_filter({expr}, lambda x, i: list_position({expr}, x) = i), ';')"


@query(
    "references",
    f"""WITH d AS (SELECT doc_id, {marked_sql('text', LAWS, 'doc_id')} AS t FROM documents) SELECT doc_id, CASE WHEN contains(lower(t), 'preempts') OR contains(lower(t), 'notwithstanding any other') THEN {_once(_found_sql(T.PREEMPTS[1]))} ELSE '' END AS preempts,
CASE WHEN contains(lower(t), 'subject to') OR contains(lower(t), 'exempted by') THEN {_once(_found_sql(T.SUBJECT_TO[1]))} ELSE '' END AS preempted_by,
{_once(_found_sql(T.DEFINES.replace("'", "''")))} AS defines FROM d""",
)
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.references(marked(F.col("text"), LAWS, F.col("doc_id"))).alias("r"))
    return d.select("doc_id", *[F.concat_ws(";", f"r.{c}").alias(c) for c in ("preempts", "preempted_by", "defines")])


@query("total_chars", "SELECT lang, sum(length(text))::BIGINT AS total_chars, count(*) AS n FROM documents GROUP BY lang")
def total_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.length("text")).cast("long").alias("total_chars"), F.count("*").alias("n"))


@query("covered_topics", f"WITH t AS ({_topic_sql()}) SELECT source AS workspace, string_agg(DISTINCT topic, ';' ORDER BY topic) AS topics FROM t JOIN documents USING (doc_id) GROUP BY source")
def covered_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("workspace"), T.topic(F.col("source"), F.col("text")).alias("topic"))
    return d.groupBy("workspace").agg(F.concat_ws(";", F.array_sort(F.collect_set("topic"))).alias("topics"))


@query(
    "doc_headers",
    f"WITH {CHUNKS} SELECT workspace, string_agg(header, ';' ORDER BY first) AS headers FROM (SELECT workspace, header, min(chunk_id) AS first FROM chunks GROUP BY ALL) GROUP BY workspace",
)
def doc_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = chunks(spark, sf_dir).groupBy("workspace", "header").agg(F.min("chunk_id").alias("first"))
    return first.groupBy("workspace").agg(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("first", "header"))), lambda x: x["header"])).alias("headers"))


@query("citation_accuracy", "SELECT lang AS family, count(*) AS n, round(avg(CASE WHEN doc_id % 4 > 0 AND CASE WHEN doc_id % 3 = 0 THEN doc_id % 6 = 0 ELSE doc_id % 5 > 0 END THEN 1.0::DOUBLE ELSE 0 END), 6) AS citation_accuracy FROM documents GROUP BY lang")
def citation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    found = F.when(k % 4 > 0, "f").otherwise("g")
    paged = k % 3 != 0
    tops = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("family"), found.alias("filename"), F.lit("f").alias("expected_file"), F.when(paged, 3).alias("expected_page"), F.when(paged, F.when(k % 5 > 0, 3).otherwise(4)).alias("page"), F.when(k % 6 == 0, "Intro").alias("place")
    )
    return evals.citation_accuracy(tops)


@query("span_precision", "SELECT lang AS family, count(*) AS n, round(avg(h), 6) AS span_precision FROM (SELECT lang, doc_id // 5 AS q, max(contains(lower(text), 'that')::INT) AS h FROM documents GROUP BY ALL) GROUP BY lang")
def span_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.span_precision(table(spark, sf_dir, "documents").select(F.col("lang").alias("family"), F.expr("doc_id div 5").alias("query_id"), F.col("text").alias("content"), F.lit("That").alias("expected")))


@query("chunk_confidence", "SELECT user_id AS doc, event_id % 4 AS chunk_index, round(avg(value / 100), 6) AS confidence FROM events GROUP BY ALL")
def chunk_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunk_confidence(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), (F.col("event_id") % 4).alias("chunk_index"), (F.col("value") / 100).alias("confidence")))


@query(
    "line_boxes",
    """WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, concat(l_returnflag, l_suppkey % 2) AS text, l_quantity::DOUBLE AS x, l_linenumber * 1e8::DOUBLE + l_extendedprice AS k FROM lineitem), b AS (SELECT doc, text, arg_max(x, k) AS "left" FROM l GROUP BY doc, text)
SELECT l.doc, l.n, l.text, b."left" FROM l LEFT JOIN b ON b.doc = l.doc AND b.text = l.text""",
)
def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("l_linenumber").alias("n"), F.concat("l_returnflag", F.col("l_suppkey") % 2).alias("text"), F.col("l_quantity").cast("double").alias("left"), (F.col("l_linenumber") * 1e8 + F.col("l_extendedprice")).alias("block"))  # noqa: E741
    blocks = l.select("doc", "page", "text", "block", "left", *[F.lit(1.0).alias(c) for c in ("top", "width", "height")])
    return structure.line_boxes(l.drop("left", "block"), blocks).select("doc", "n", "text", F.col("box.left").alias("left"))


@query("listing_order", "SELECT o_orderkey AS event_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 100")
def listing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred rows of an audit."""
    rows = corpus.ordered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("at")), "audit").limit(100)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("at"), "event_id")).cast("long")).drop("at")


@query("report", f"""WITH {CHUNKS}, f AS (SELECT workspace, header, min(chunk_id) AS i FROM chunks GROUP BY ALL), h AS (SELECT workspace, string_agg(header, ';' ORDER BY i) AS headers FROM f GROUP BY 1)
SELECT workspace AS document_id, count(*) AS n_chunks, count(DISTINCT page) AS n_pages, sum(length(content))::BIGINT AS n_chars, any_value(headers) AS headers FROM chunks JOIN h USING (workspace) GROUP BY workspace""")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).withColumnsRenamed({"workspace": "document_id", "doc_id": "_d"}).withColumn("chunk_index", F.col("chunk_id"))
    return corpus.report(c.select("document_id").distinct(), c).select("document_id", "n_chunks", "n_pages", "n_chars", F.concat_ws(";", "headers").alias("headers"))


@query("reprocessed", "SELECT doc_id AS chunk_id FROM documents WHERE (source, lang) NOT IN (SELECT (source, lang) FROM documents WHERE doc_id % 50 = 0)")
def reprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("workspace"), F.col("lang").alias("file_hash"))
    return corpus.reprocessed(d, d.where("chunk_id % 50 = 0")).select("chunk_id")


@query("hit_marks", "SELECT doc_id, doc_id % 3 = 0 OR doc_id % 5 = 0 AS phrase_boost, doc_id % 3 = 0 OR doc_id % 5 = 0 AS lexical_boost, doc_id % 7 = 0 AS used_ocr FROM documents")
def hit_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return search.synced(table(spark, sf_dir, "documents").select("doc_id", (k % 3 == 0).alias("phrase_boost"), (k % 5 == 0).alias("lexical_boost"), F.when(k % 7 == 0, 0.5).alias("confidence"))).drop("confidence")


PATHS = ['["A", "{}"]', "A > {} > {}", "General", "", "Page 3 > {}"]


@query(
    "rerank_text",
    f"""WITH d AS (SELECT doc_id, source, text, {marked_sql('source', PATHS, 'doc_id')} AS raw, CASE WHEN doc_id % 2 = 0 THEN 'Rows 1-2' END AS loc FROM documents),
p AS (SELECT *, list_filter(CASE WHEN starts_with(raw, '[') THEN from_json(raw, '["VARCHAR"]') ELSE list_transform(string_split(raw, '>'), lambda x: trim(x)) END, lambda x: x <> '' AND lower(x) <> 'general' AND NOT regexp_matches(lower(x), '{T.PAGE_CRUMB}')) AS path FROM d),
c AS (SELECT *, CASE WHEN len(path) > 0 THEN array_to_string(list_filter(path, lambda x, i: i = 1 OR lower(x) <> lower(path[i - 1])), ' > ') WHEN loc IS NOT NULL THEN loc ELSE source END AS crumbs FROM p)
SELECT doc_id, sha256(concat_ws(chr(10), 'Document: doc ' || doc_id, 'Section: ' || crumbs, text)) AS text_hash FROM c""",
)
def rerank_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = T.path_of(marked(F.col("source"), PATHS, F.col("doc_id")))
    name = F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(T.rerank_text(F.col("text"), name, path, F.when(F.col("doc_id") % 2 == 0, "Rows 1-2"), F.col("source")), 256).alias("text_hash"))


@query("pack_floats", "SELECT vec_id, length(embedding) * 4 AS n_bytes, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def pack_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors packed into bytes and read back."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", pack(F.col("embedding")).alias("raw"))
    total = F.aggregate(unpack(F.col("raw")), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return e.select("vec_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.round(total, 6).alias("total"))


def _word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words: orders as documents on one page, every three lines a line of print."""
    w = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), ((F.col("l_linenumber") - 1) % 3).alias("line"), F.concat("l_returnflag", "l_suppkey").alias("text"), F.col("l_linenumber").alias("n"))
    box = {"left": F.col("n") * 50.0, "top": F.col("line") * 30.0 + 10, "width": F.lit(40.0), "height": F.lit(10.0)}
    return w.withColumns({**box, "block": F.lit(1), "par": F.lit(1)})


@query(
    "pdf_pages",
    """WITH w AS (SELECT l_orderkey AS doc, (l_linenumber - 1) % 3 AS line, l_linenumber AS n, concat(l_returnflag, l_suppkey) AS t FROM lineitem), l AS (SELECT doc, line, string_agg(t, ' ' ORDER BY n, t) AS t FROM w GROUP BY ALL)
SELECT doc, 1 AS page, string_agg(t, chr(10) || chr(10) ORDER BY line) AS text FROM l GROUP BY doc""",
)
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.pages(_word_table(spark, sf_dir))


@query("pack_entries")
def pack_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all documents, with a section line before every fourth line of text."""
    d = structure.lines(table(spark, sf_dir, "documents")).withColumn("line", F.when(F.col("line_no") % 4 == 0, F.concat(F.lit("Section "), F.col("line_no") + 1, F.lit(". Rent\n"), F.col("line"))).otherwise(F.col("line")))
    pages = d.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    e = packs.entries(pages.select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text"))
    return e.select("doc", "page", "section", "citation", "section_number", "topic", "estimated_tokens", F.size("slots").alias("n_slots"))


@query("ocr_confidence", "SELECT user_id, round(avg(value / 100), 6) AS mean_confidence FROM events WHERE value IS NOT NULL GROUP BY user_id")
def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence by document over the pages that have one; events stand in for pages."""
    return table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.round(F.avg(F.col("value") / 100), 6).alias("mean_confidence"))
