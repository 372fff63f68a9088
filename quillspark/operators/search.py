"""Hybrid retrieval as DataFrame plans, for one query or a table of queries.

A chunk table has chunk_id, workspace, doc_type, filename, page, header, locator, heading_path, content, source_hash, is_superseded and,
for the dense leg, embedding; doc_id and ingested_at where they are filtered by. Both legs score, cut to their top k on (id, score) alone,
and only the few survivors are joined back to their text. A table of queries scans the chunks once for all its queries: each task keeps the best
of its own chunks for each query, and a window over what is left makes the ranks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.vectors import dot
from quillspark.operators.embedding import check_dimension

# Defaults of the ranking.
RRF_K, DENSE_LIMIT, SPARSE_LIMIT, RERANK, LIMIT = 60, 25, 25, 30, 5
HEADER_BOOST, CONTENT_BOOST, PHRASE_BOOST, MOST_BOOST = 0.08, 0.04, 0.10, 0.12
NEAR_WORDS, NEAR_SHARE = 60, 0.85
LOW_OCR = "low OCR confidence quarantined"
MODES = {"vector": "vector_only", "dense": "vector_only", "vector_only": "vector_only", "fts": "fts_only", "sparse": "fts_only", "fts_only": "fts_only", "hybrid": "hybrid", "rrf_boosts": "rrf_boosts", "rrf+rerank": "rrf+rerank", "rerank": "rrf+rerank"}
BOOSTED = ("hybrid", "rrf_boosts", "rrf+rerank")
#: Queries that one scan of the chunks serves; more are taken in blocks.
QUERIES = 2_000
#: Queries and chunks that a task compares at once.
AT_ONCE, ROWS = 1_000, 2_048
#: Filters by name: each makes a condition of its value.
FILTERS: dict[str, Callable[[object], Column]] = {
    "doc_type": lambda v: F.col("doc_type") == v,
    "page": lambda v: F.col("page") == v,
    "filename": lambda v: F.col("filename") == v,
    "doc_id": lambda v: F.col("doc_id") == v,
    "date_from": lambda v: F.col("ingested_at") >= F.lit(v).cast("timestamp"),
    "date_to": lambda v: F.col("ingested_at") <= F.lit(v).cast("timestamp"),
}
_SECTION = re.compile(r"(?:§+|Section|Sec\.|Article|Art\.|Clause)\s*([0-9IVXLCDM]+[A-Za-z0-9.\-]*)", re.I)


@dataclass(frozen=True)
class ParsedQuery:
    """A query text without its inline operators, and the operators."""

    text: str
    doc_type: str | None = None
    page: int | None = None
    header_regex: str | None = None
    negative: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    section: str | None = None
    words: tuple[str, ...] = field(default=())


def parse_query(query: str) -> ParsedQuery:
    """Reads ``doc_type:x``, ``page:n``, ``header:re`` and ``-term``; the last of a kind wins. An invalid pattern raises ValueError."""
    rest, found = query, {}
    for name, pattern in (("doc_type", r"\bdoc_type:(\w+)"), ("page", r"\bpage:(\d+)"), ("header", r'''\bheader:(?:"([^"]+)"|'([^']+)'|(\S+))''')):
        for m in re.finditer(pattern, rest, re.I):
            found[name] = next(g for g in m.groups() if g is not None)
        rest = re.sub(pattern, " ", rest, flags=re.I)
    negative = tuple(t.lower() for t in re.findall(r"(?:^|\s)-([a-zA-Z0-9_.\-]+)", rest))
    rest = " ".join(re.sub(r"(?:^|\s)-[a-zA-Z0-9_.\-]+", " ", rest).split())
    pattern = found.get("header")
    if pattern is not None:
        if len(pattern) > 120:
            raise ValueError("a header pattern has 120 characters at most")
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"invalid header pattern: {e}") from e
    text = rest or query
    section = _SECTION.search(text)
    token = re.sub(T.SECTION_WORD, "", section.group(0).lower()).strip() if section else None
    phrases = tuple(p.strip().lower() for p in re.findall(r'"([^"]{3,})"', text))
    words = tuple(w for w in re.findall(r"\w+", text.lower()) if len(w) > 2)
    return ParsedQuery(text, found.get("doc_type", "").lower() or None, int(found["page"]) if "page" in found else None, pattern, negative, phrases, token, words)


def readable(chunks: DataFrame, include_superseded: bool = False, include_low_ocr: bool = False) -> DataFrame:
    """Chunks without superseded and unreadable ones."""
    if not include_superseded:
        chunks = chunks.where(~F.coalesce(F.col("is_superseded"), F.lit(False)))
    return chunks if include_low_ocr else chunks.where(~F.col("content").contains(LOW_OCR))


def scoped(chunks: DataFrame, workspace: str, allowed: Sequence[str] = ("*",), include_superseded: bool = False, include_low_ocr: bool = False, **filters: object) -> DataFrame:
    """The only way to a chunk table: one workspace, which the caller may read, without superseded and unreadable chunks.

    ``filters`` are those of `FILTERS`; one that is None doesn't filter, and an unknown name raises ValueError.
    """
    if not workspace:
        raise ValueError("a search needs a workspace")
    if "*" not in allowed and workspace not in allowed:
        raise PermissionError(f"no access to workspace {workspace}")
    if unknown := sorted(set(filters) - set(FILTERS)):
        raise ValueError(f"unknown filters: {', '.join(unknown)}")
    out = chunks.where(F.col("workspace") == workspace)
    for name, value in filters.items():
        if value is not None:
            out = out.where(FILTERS[name](value))
    return readable(out, include_superseded, include_low_ocr)


def label() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("header", F.lit("")), F.coalesce("locator", F.lit(""))))


def without_negated(base: DataFrame, leg: DataFrame, negative: DataFrame, score: str, rank: str) -> DataFrame:
    """Drops a leg's hits whose content or header holds a term that their query negates (query_id, _negative), and ranks what is left.

    It comes after the top k and before the fusion: a leg may get shorter, and its first kept hit has rank 1. ``leg`` has at most k rows a query.
    """
    full = F.lower(F.concat(F.col("content"), F.lit(" "), F.coalesce("header", F.lit(""))))
    rows = base.select("chunk_id", full.alias("_full")).join(F.broadcast(leg), "chunk_id").join(F.broadcast(negative), "query_id")
    kept = rows.where(~F.exists("_negative", lambda t: F.col("_full").contains(t)))
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return kept.withColumn(rank, F.row_number().over(order).cast("long")).select(leg.columns)


def _ranked(scored: DataFrame, score: str, rank: str, k: int) -> DataFrame:
    top = scored.orderBy(F.desc(score), "chunk_id").limit(k)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), "chunk_id")).cast("long"))  # at most k rows


def dense_topk(chunks: DataFrame, vector: Sequence[float], k: int = DENSE_LIMIT, floor: float = 0.15) -> DataFrame:
    """(chunk_id, sim, dense_rank) of the k nearest by dot product, at ``floor`` or more."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    usable = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") == len(vector)))
    sim = usable.select("chunk_id", F.round(dot(F.col("embedding"), q), 6).alias("sim")).where(F.col("sim") >= floor)
    return _ranked(sim, "sim", "dense_rank", k)


def sparse_topk(chunks: DataFrame, words: Sequence[str], k: int = SPARSE_LIMIT) -> DataFrame:
    """(chunk_id, hits, sparse_rank): how many query words the chunk holds anywhere, repeated words counted again."""
    full = F.lower(F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("header", F.lit("")), F.coalesce("locator", F.lit(""))))
    hits = reduce(lambda a, b: a + b, [full.contains(w).cast("double") for w in words], F.lit(0.0))
    return _ranked(chunks.select("chunk_id", hits.alias("hits")).where("hits > 0"), "hits", "sparse_rank", k)


def bm25_topk(chunks: DataFrame, terms: Sequence[str], k: int = 300, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(chunk_id, bm25, bm25_rank). Term counts come from each text in one scan; their statistics are a row that reaches the driver."""
    count = lambda t: F.size(F.filter(F.col("_w"), lambda w: w == t))
    tf = [count(t).alias(f"_tf{i}") for i, t in enumerate(terms)]
    counted = chunks.select("chunk_id", T.words(F.col("content")).alias("_w")).select("chunk_id", F.size("_w").alias("_len"), *tf)
    some = reduce(lambda x, y: x | y, [F.col(f"_tf{i}") > 0 for i in range(len(terms))], F.lit(False))
    sums = [F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(terms))]
    n, mean, *seen = counted.agg(F.count("*"), F.avg("_len"), *sums).first()
    score = F.lit(0.0)
    for i, df in enumerate(seen):
        t = F.col(f"_tf{i}")
        idf = max(float(np.log((n - (df or 0) + 0.5) / ((df or 0) + 0.5))), 1e-6)
        score = score + idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("_len") / F.lit(mean or 1.0)))
    return _ranked(counted.where(some).select("chunk_id", F.round(score, 6).alias("bm25")), "bm25", "bm25_rank", k)


def rrf(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, by: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """Reciprocal rank fusion of both legs: a full outer join of at most a few dozen rows for each query."""
    part = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))
    return dense.join(sparse, list(by), "full_outer").withColumn("rrf", part("dense_rank") + part("sparse_rank"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best ids of each row of scores, NaN being none; equal scores go by id."""
    out = []
    for q, row in enumerate(scores):
        at = np.flatnonzero(~np.isnan(row))
        if len(at) > k:
            at = at[np.lexsort((ids[at], -row[at]))[:k]]
        out.append((np.full(len(at), q), ids[at], row[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def batch_legs(chunks: DataFrame, queries: Sequence[tuple[int, ParsedQuery, str, Sequence[float] | None]], floor: float, dense_limit: int = DENSE_LIMIT, sparse_limit: int = SPARSE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, sim, dense_rank) and (query_id, chunk_id, hits, sparse_rank) of queries (id, parsed, workspace, vector), in one scan.

    A query sees its own workspace, and only the doc_type and page that it names.
    """
    names = np.array([q[0] for q in queries], np.int64)
    words = sorted({w for _, q, _, _ in queries for w in q.words})
    place = {w: i for i, w in enumerate(words)}
    counts = np.zeros((len(queries), len(words)))
    for i, (_, q, _, _) in enumerate(queries):
        for w in q.words:
            counts[i, place[w]] += 1
    size = max((len(v) for *_, v in queries if v is not None), default=0)
    vectors = np.array([v if v is not None else [np.nan] * size for *_, v in queries], float).reshape(len(queries), size)
    rules = [("workspace", [q[2] for q in queries]), ("doc_type", [q[1].doc_type for q in queries]), ("page", [q[1].page for q in queries])]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [slice(low, low + AT_ONCE) for low in range(0, len(queries), AT_ONCE)]
        held = [[(np.zeros(0, int), np.zeros(0, int), np.zeros(0))] * 2 for _ in blocks]
        for whole in batches:
            for batch in (whole.slice(low, ROWS) for low in range(0, whole.num_rows, ROWS)):
                ids, text = batch.column("chunk_id").to_numpy(), batch.column("text")
                holds = np.array([pc.match_substring(text, w).to_numpy(zero_copy_only=False) for w in words], float).reshape(len(words), len(ids))
                if size:
                    of = batch.column("embedding")
                    right = pc.fill_null(pc.equal(pc.list_value_length(of), size), False).to_numpy(zero_copy_only=False)
                    usable = of.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size).T
                have = {column: np.array(batch.column(column).to_pylist(), object) for column, values in rules if any(v is not None for v in values)}
                fits = {column: {v: have[column] == v for v in set(values) - {None}} for column, values in rules if column in have}
                for block, best in zip(blocks, held, strict=True):
                    n = len(names[block])
                    own = np.ones((n, len(ids)), bool)
                    for column, values in rules:
                        for i, v in enumerate(values[block]):
                            if v is not None:
                                own[i] &= fits[column][v]
                    hits = counts[block] @ holds
                    scores = [np.full(own.shape, np.nan), np.where(own & (hits > 0), hits, np.nan)]
                    if size:
                        sims = np.full(own.shape, np.nan)
                        if right.any():
                            sims[:, right] = np.round(vectors[block] @ usable, 6)
                        scores[0] = np.where(own & (sims >= floor), sims, np.nan)
                    for leg, k in ((0, dense_limit), (1, sparse_limit)):
                        new = _best(scores[leg], ids, k)
                        q, c, x = (np.concatenate([a, b]) for a, b in zip(best[leg], new, strict=True))
                        order = np.lexsort((c, -x, q))
                        q, c, x = q[order], c[order], x[order]
                        start = np.flatnonzero(np.diff(q, prepend=-1))
                        keep = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q))) < k
                        best[leg] = (q[keep], c[keep], x[keep])
        for block, best in zip(blocks, held, strict=True):
            for leg, (q, c, x) in enumerate(best):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), leg), pa.int32()), pa.array(names[block][q]), pa.array(c, pa.int64()), pa.array(x, pa.float64())], names=["leg", "query_id", "chunk_id", "score"])

    full = F.lower(F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("header", F.lit("")), F.coalesce("locator", F.lit("")))).alias("text")
    seen = chunks.where(F.col("workspace").isin(sorted({q[2] for q in queries})))
    found = seen.select("chunk_id", "workspace", "doc_type", "page", full, *(["embedding"] if size else [])).mapInArrow(step, "leg int, query_id long, chunk_id long, score double")
    rank = F.row_number().over(Window.partitionBy("leg", "query_id").orderBy(F.desc("score"), "chunk_id")).cast("long")
    ranked = found.withColumn("rank", rank)
    leg = lambda i, score, name, k: ranked.where((F.col("leg") == i) & (F.col("rank") <= k)).select("query_id", "chunk_id", F.col("score").alias(score), F.col("rank").alias(name))
    return leg(0, "sim", "dense_rank", dense_limit), leg(1, "hits", "sparse_rank", sparse_limit)


def boosted(hits: DataFrame, phrases: Sequence[str] | Column = (), section: str | Column | None = None, header: float = HEADER_BOOST, content: float = CONTENT_BOOST, phrase: float = PHRASE_BOOST) -> DataFrame:
    """Adds phrase and section boosts to ``rrf``, capped together, and what matched. Phrases and section may be columns."""
    body, head = F.lower("content"), label()
    phrases = phrases if isinstance(phrases, Column) else F.array(*[F.lit(p) for p in phrases]).cast("array<string>")
    section = section if isinstance(section, Column) else F.lit(section).cast("string")
    n = F.size(F.filter(phrases, lambda p: body.contains(p) | head.contains(p)))
    first = F.least(n * phrase, F.lit(MOST_BOOST))
    tokens = F.coalesce(F.col("heading_path"), F.array().cast("array<string>"))
    exact = F.exists(tokens, lambda h: (T.norm_citation(h) == section) | (F.lower(h) == section))
    in_head = F.coalesce(exact | T.norm_citation(head).contains(section) | head.contains(section), F.lit(False))
    in_body = F.coalesce(~in_head & body.contains(section), F.lit(False))
    more = F.when(in_head, header).when(in_body, content).otherwise(0.0)
    total = F.least(first + more, F.lit(MOST_BOOST))
    return hits.withColumns({"boost": total, "phrase_boost": n > 0, "section_boost": in_head, "content_boost": in_body, "rrf": F.col("rrf") + total})


def lexical_score(query: str | Column, text: Column) -> Column:
    """0.6 of the Jaccard similarity and 0.4 of the query's coverage, over sets of words."""
    mine, theirs = F.array_distinct(T.words(query if isinstance(query, Column) else F.lit(query))), F.array_distinct(T.words(text))
    common = F.size(F.array_intersect(mine, theirs))
    value = F.round(0.6 * common / F.size(F.array_union(mine, theirs)) + 0.4 * common / F.size(mine), 5)
    return F.when((F.size(theirs) == 0) | (F.size(mine) == 0), 0.0).otherwise(value)


#: Rerankers by name: scores of texts for a query.
RERANKERS: dict[str, Callable[[str, Sequence[str]], Sequence[float]]] = {}


def register_reranker(name: str, score: Callable[[str, Sequence[str]], Sequence[float]]) -> None:
    RERANKERS[name] = score


def _custom_score(score: Callable[[str, Sequence[str]], Sequence[float]], query: Column, text: Column) -> Column:
    """Scores of a function, null where it fails."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype="float64")
        for q in queries.dropna().unique():
            at = np.flatnonzero((queries == q).to_numpy())
            try:
                out.iloc[at] = [float(x) for x in score(q, texts.iloc[at].tolist())]
            except Exception:  # noqa: BLE001, S112 - a failing reranker leaves the lexical score
                continue
        return out

    return run(query, text)


def reranked(hits: DataFrame, query: str | Column, first: int = RERANK, score: Callable[[str, Sequence[str]], Sequence[float]] | None = None) -> DataFrame:
    """Rescores each query's first candidates by ``score``, or where there is none or it fails by `lexical_score`; the rest keeps its order behind them.

    ``hits`` may have query_id; without it all are one query's.
    """
    of = ["query_id"] if "query_id" in hits.columns else []
    order = [F.desc("rrf"), F.desc_nulls_last("hits"), F.desc_nulls_last("sim"), "chunk_id"]
    rows = hits.withColumn("_at", F.row_number().over(Window.partitionBy(*of).orderBy(*order)))  # at most the candidates of both legs
    asked = query if isinstance(query, Column) else F.lit(query)
    value = lexical_score(asked, F.col("content"))
    if score:
        text = T.rerank_text(F.col("content"), F.col("filename"), F.col("heading_path"), F.col("locator"), F.col("header"))
        value = F.coalesce(_custom_score(score, F.when(F.col("_at") <= first, asked), text), value)
    rows = rows.withColumn("rerank_score", F.when(F.col("_at") <= first, value))
    place = Window.partitionBy(*of).orderBy(F.col("rerank_score").isNull(), F.desc("rerank_score"), F.desc("rrf"), "_at")
    return rows.withColumn("position", F.row_number().over(place).cast("long")).drop("_at")


def distinct_hits(hits: DataFrame, limit: int) -> DataFrame:
    """Each query's first hits in ``position`` order that equal none before, nor share more than 0.85 of their first words with one.

    Greedy over the candidates of one search, at most a few dozen rows.
    """
    of = ["query_id"] if "query_id" in hits.columns else []

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        kept: list[set[str]] = []
        use = []
        for row in rows.sort_values("position").itertuples():
            w = set(row.content.lower().split()[:NEAR_WORDS])
            near = any(w and k and len(w & k) / min(len(w), len(k)) > NEAR_SHARE for k in kept)
            if len(kept) < limit and row.source_hash not in seen and not near:
                seen.add(row.source_hash)
                kept.append(w)
                use.append(row.Index)
        return rows.loc[use]

    return hits.groupBy(*of).applyInPandas(pick, hits.schema)


def synced(hits: DataFrame) -> DataFrame:
    """Hits with the older names of their marks: lexical_boost equals phrase_boost, and a confidence means that OCR was used."""
    old = F.col("lexical_boost") if "lexical_boost" in hits.columns else F.lit(False)
    both = F.coalesce(F.col("phrase_boost"), F.lit(False)) | F.coalesce(old, F.lit(False))
    used = F.col("used_ocr") if "used_ocr" in hits.columns else F.lit(False)
    confidence = F.col("confidence").isNotNull() if "confidence" in hits.columns else F.lit(False)
    return hits.withColumns({"phrase_boost": both, "lexical_boost": both, "used_ocr": F.coalesce(used, F.lit(False)) | confidence})


def effective_limit(limit: int, rerank_top_k: int | None = None) -> int:
    return min(limit, max(1, rerank_top_k)) if rerank_top_k is not None else limit


def _parsed(spark: SparkSession, queries: Sequence[tuple[int, ParsedQuery]]) -> DataFrame:
    rows = [(i, q.text, list(q.negative), list(q.phrases), q.section, f"(?i){q.header_regex}" if q.header_regex else None) for i, q in queries]
    return F.broadcast(spark.createDataFrame(rows, "query_id long, _text string, _negative array<string>, _phrases array<string>, _section string, _header string"))


def _finished(base: DataFrame, hits: DataFrame, queries: DataFrame, mode: str, limit: int, first: int, score: Callable[[str, Sequence[str]], Sequence[float]] | None, full: bool = False) -> DataFrame:
    """From fused hits (query_id, chunk_id, ranks, rrf) to results: boosts, header pattern, order, rerank, deduplication, citation."""
    if mode in ("vector_only", "fts_only"):
        hits = hits.withColumn("rrf", F.col("sim" if mode == "vector_only" else "hits"))
    rows = base.drop("embedding").join(hits, "chunk_id").join(queries, "query_id")
    rows = boosted(rows, F.col("_phrases"), F.col("_section")) if mode in BOOSTED else boosted(rows)
    named = F.concat_ws(" ", F.coalesce("header", F.lit("")), F.coalesce("locator", F.lit("")))
    rows = reranked(rows.where(F.col("_header").isNull() | F.regexp_like(named, F.col("_header"))), F.col("_text"), first, score)
    out = distinct_hits(rows.drop("_negative", "_phrases", "_section", "_header"), limit)
    reason = lambda c, name: F.when(F.col(c), name)
    reasons = F.array_compact(F.array(F.concat(F.lit("dense_rank_"), F.col("dense_rank")), F.concat(F.lit("sparse_rank_"), F.col("sparse_rank")), reason("section_boost", "section_locator_match"), reason("content_boost", "statutory_token_boost"), reason("phrase_boost", "quoted_phrase_match"), F.when(F.col("rerank_score").isNotNull(), "cross_encoder_rerank")))
    if full:
        return contract(out.withColumn("match_reasons", reasons))
    cite = T.citation(F.col("filename"), F.col("page"), F.col("locator"), F.col("header"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position")).cast("long")
    return out.select("query_id", place.alias("rank"), "position", "chunk_id", F.coalesce(F.round("rerank_score", 6), F.round("rrf", 5)).alias("score"), cite.alias("citation"), "sim", "hits", "dense_rank", "sparse_rank", "boost", reasons.alias("match_reasons"), F.substring("content", 1, 140).alias("snippet"))


#: Columns that chunks may have beside those that a search needs, for `contract`.
OPTIONAL = {"doc_id": "long", "chunk_index": "int", "pdf_page": "int", "printed_page": "string", "citation": "string", "char_start": "int", "char_end": "int", "bbox": "array<double>", "confidence": "double", "file_hash": "string"}


def contract(hits: DataFrame) -> DataFrame:
    """Finished hits with every field of the hit contract, and query_id and rank; what the chunks don't have is null."""
    for name, kind in OPTIONAL.items():
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    page = F.coalesce("pdf_page", c("page").cast("int"))
    place = T.locator(page, c("locator"), c("header"))
    span = F.when(c("char_start").isNotNull() & c("char_end").isNotNull(), F.array("char_start", "char_end"))
    header = F.when(c("header") != "General", c("header"))
    whole = let(place, lambda p: F.struct(p["kind"].alias("kind"), c("page").cast("int").alias("page"), page.alias("pdf_page"), c("printed_page"), p["path"].alias("path"), span.alias("char_span"), c("bbox"), F.nullif(header, F.lit("")).alias("header"), p["formatted"].alias("formatted")))
    score = F.coalesce(F.round("rerank_score", 6), F.round("rrf", 5))
    cite = T.citation(c("filename"), c("page"), c("locator"), c("header"), c("printed_page"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("position")).cast("long")
    reranked_at = F.when(c("rerank_score").isNotNull(), c("position"))
    vector = F.struct(c("sim").alias("dense_score"), c("hits").alias("sparse_score"), c("dense_rank").alias("vector_rank"), c("sparse_rank").alias("fts_rank"), F.round("rrf", 5).alias("rrf_score"), "section_boost", "phrase_boost", score.alias("final_score"), F.round("rerank_score", 5).alias("rerank_score"), reranked_at.alias("rerank_rank"))
    both = c("phrase_boost") | c("content_boost")
    rows = hits.withColumn("_l", whole)
    return rows.select(
        "query_id", rank.alias("rank"), F.lit("1.0").alias("schema_version"), F.coalesce(F.nullif("citation", F.lit("")), cite).alias("citation"), c("page").cast("int").alias("page_number"), page.alias("pdf_page"), "printed_page",
        "header", "locator", c("_l").alias("structured_locator"), score.alias("score"), c("content").alias("text"), c("doc_id").alias("document_id"), "chunk_id", "filename", "workspace", "chunk_index",
        c("sim").alias("dense_score"), c("hits").alias("sparse_score"), c("dense_rank").alias("vector_rank"), c("sparse_rank").alias("fts_rank"), "section_boost", both.alias("lexical_boost"), both.alias("phrase_boost"),
        F.when(F.size("heading_path") > 0, c("heading_path")).otherwise(c("_l.path")).alias("heading_path"), "match_reasons", "char_start", "char_end", "bbox", "confidence", c("confidence").alias("ocr_mean_confidence"),
        c("confidence").isNotNull().alias("used_ocr"), "source_hash", "file_hash", "doc_type", vector.alias("score_vector"),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once in each row and uses it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _guarded(base: DataFrame, size: int) -> None:
    """Refuses a query vector if any vector of the scope has another length."""
    sizes = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    for found in base.agg(F.min(sizes), F.max(sizes)).first():
        if found is not None:
            check_dimension(size, found)


def _hits(base: DataFrame, queries: DataFrame, negated: bool, dense: DataFrame | None, sparse: DataFrame | None) -> DataFrame:
    """Both legs without what their queries negate, fused."""
    spark = base.sparkSession
    if negated:
        dense = dense and without_negated(base, dense, queries.select("query_id", "_negative"), "sim", "dense_rank")
        sparse = sparse and without_negated(base, sparse, queries.select("query_id", "_negative"), "hits", "sparse_rank")
    none = lambda *c: spark.createDataFrame([], "query_id long, chunk_id long, " + ", ".join(c))
    return rrf(dense if dense is not None else none("sim double", "dense_rank long"), sparse if sparse is not None else none("hits double", "sparse_rank long"), by=("query_id", "chunk_id"))


def _reranking(mode: str, rerank: bool, reranker: str | None) -> tuple[int, Callable[[str, Sequence[str]], Sequence[float]] | None]:
    asked = rerank or mode == "rrf+rerank" or (reranker is not None and mode not in ("vector_only", "fts_only"))
    return RERANK if asked else 0, RERANKERS[reranker] if reranker else None


def _least(floor: float | None, mode: str) -> float:
    return floor if floor is not None else (0.15 if mode == "vector_only" else 0.45)


def _vector(made: Sequence[float] | Callable[[str], Sequence[float]] | None, text: str) -> Sequence[float] | None:
    """A vector as it is, or what a function makes of the text; None where that fails, which leaves the lexical leg."""
    if not callable(made):
        return made
    try:
        return [float(x) for x in made(text)]
    except Exception:  # noqa: BLE001 - whatever a backend raises
        return None


def explain(chunks: DataFrame, query: str, workspace: str, vector: Sequence[float] | Callable[[str], Sequence[float]] | None = None, mode: str = "hybrid", limit: int = LIMIT, floor: float | None = None, rerank: bool = False, reranker: str | None = None, rerank_top_k: int | None = None, full: bool = False, **scope: object) -> DataFrame:
    """Ranked hits with citation, both ranks, score breakdown, reasons and snippet, by the stages: scope, two top-k legs, negation, ranks, fusion, boosts,
    header pattern, order, rerank, deduplication, citation. ``full`` gives all fields of `contract`. ``vector`` may be a function of the text; where it fails the dense leg is
    empty."""
    mode, q = MODES.get(mode, "rrf"), parse_query(query)
    spark, vector = chunks.sparkSession, _vector(vector, q.text) if mode != "fts_only" else None
    scope = {**scope, **{k: v for k, v in (("doc_type", q.doc_type), ("page", q.page)) if v is not None}}
    base = scoped(chunks, workspace, **scope)
    if vector is not None and mode != "fts_only":
        _guarded(base, len(vector))
    mine = lambda leg: leg.withColumn("query_id", F.lit(0).cast("long"))
    dense = mine(dense_topk(base, vector, floor=_least(floor, mode))) if vector is not None and mode != "fts_only" else None
    sparse = mine(sparse_topk(base, q.words)) if mode != "vector_only" else None
    first, score = _reranking(mode, rerank, reranker)
    parsed = _parsed(spark, [(0, q)])
    hits = F.broadcast(_hits(base, parsed, bool(q.negative), dense, sparse))  # at most the rows of both legs
    return _finished(base, hits, parsed, mode, effective_limit(limit, rerank_top_k), first, score, full).drop("query_id")


def search(chunks: DataFrame, query: str, workspace: str, vector: Sequence[float] | Callable[[str], Sequence[float]] | None = None, **options: object) -> DataFrame:
    """`explain` without the ranks of the legs."""
    return explain(chunks, query, workspace, vector, **options).drop("rank", "dense_rank", "sparse_rank")


def blocks_of(queries: DataFrame, size: int | None = None) -> Iterator[list]:
    """The rows of a table of queries (query_id), about `QUERIES` at a time."""
    blocks = max(1, -(-queries.count() // (size or QUERIES)))
    for i in range(blocks):
        rows = (queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries).collect()
        if rows or blocks == 1:
            yield rows


def search_batch(chunks: DataFrame, queries: DataFrame, mode: str = "hybrid", limit: int = LIMIT, floor: float | None = None, rerank: bool = False, reranker: str | None = None, rerank_top_k: int | None = None, allowed: Sequence[str] = ("*",), include_superseded: bool = False, include_low_ocr: bool = False) -> DataFrame:
    """`explain` for a table of queries (query_id, text, workspace and, for the dense leg, embedding): one scan of the chunks for `QUERIES` queries.

    Inline operators of each query's text hold for it alone; a workspace that isn't allowed raises PermissionError.
    """
    mode, spark = MODES.get(mode, "rrf"), chunks.sparkSession
    has_vector = "embedding" in queries.columns and mode != "fts_only"
    base = readable(chunks, include_superseded, include_low_ocr)
    first, score = _reranking(mode, rerank, reranker)
    out = []
    for rows in blocks_of(queries.select("query_id", "text", "workspace", *(["embedding"] if has_vector else []))):
        if refused := sorted({r["workspace"] for r in rows} - set(allowed)) if "*" not in allowed else []:
            raise PermissionError(f"no access to workspaces {', '.join(refused)}")
        asked = [(r["query_id"], parse_query(r["text"]), r["workspace"], r["embedding"] if has_vector else None) for r in rows]
        sizes = {len(v) for *_, v in asked if v is not None}
        for size in sizes:
            _guarded(base, size)
        dense, sparse = batch_legs(base, asked, _least(floor, mode))
        parsed = _parsed(spark, [(k, q) for k, q, _, _ in asked])
        hits = _hits(base, parsed, any(q.negative for _, q, _, _ in asked), dense if sizes else None, sparse if mode != "vector_only" else None)
        out.append(_finished(base, hits, parsed, mode, effective_limit(limit, rerank_top_k), first, score))
    return reduce(DataFrame.unionByName, out)


def trace(found: DataFrame, query: str, mode: str, milliseconds: float) -> DataFrame:
    """One row on a finished `explain`: hash of the query, mode, ranks and boosts by chunk, duration; no text."""
    by = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("chunk_id").cast("string").alias("k"), F.col(c).alias("v"))))))
    ranks = [by(c).alias(n) for c, n in (("dense_rank", "dense_ranks"), ("sparse_rank", "sparse_ranks"), ("boost", "boosts"))]
    named = [T.source_hash(F.lit(query)).alias("query_hash"), F.lit(mode).alias("mode"), F.count("*").alias("n_hits"), F.lit(float(milliseconds)).alias("duration_ms")]
    return found.agg(*named, *ranks).withColumn("at", F.current_timestamp())


def append_trace(row: DataFrame, path: str) -> bool:
    """Appends a trace; a failure doesn't fail the search, it returns False."""
    try:
        row.write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001 - the search has its result already
        return False
    return True
