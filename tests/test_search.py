import pytest
from pyspark.sql import functions as F

from quillspark.operators import search

DOCS = [
    (1, "a", "work_product", "m.txt", 1, "Section 1.1 Scope", "The tenant pays rent monthly under this draft agreement."),
    (2, "a", "work_product", "m.txt", 1, "Section 1.2 Deposit", "A security deposit of one month is held by the landlord."),
    (3, "a", "authority", "s.txt", 2, "§ 1950.5 Deposits", "A landlord may not demand a deposit in excess of one month rent."),
    (4, "b", "authority", "s.txt", 2, "§ 1950.5 Deposits", "A secret deposit clause of another tenant."),
    (5, "a", "authority", "s2.txt", 3, "§ 1950.5 Deposits", "A landlord may not demand a deposit in excess of one month rent ever."),
    (6, "a", "general", "o.txt", 1, "Scan", "deposit low OCR confidence quarantined"),
]


@pytest.fixture
def chunks(spark):
    d = spark.createDataFrame(DOCS, "chunk_id long, workspace string, doc_type string, filename string, page long, header string, content string")
    more = {"locator": F.concat(F.lit("Page "), "page"), "heading_path": F.array("header"), "is_superseded": F.lit(False), "source_hash": F.sha2("content", 256), "embedding": F.lit(None).cast("array<float>")}
    return d.withColumns(more)


def test_operators_leave_the_text():
    q = search.parse_query('deposit -draft doc_type:Authority page:2 header:"1950" "in excess" Section 1950.5')
    assert (q.doc_type, q.page, q.header_regex, q.negative, q.phrases, q.section) == ("authority", 2, "1950", ("draft",), ("in excess",), "1950.5")
    assert "doc_type" not in q.text and "-draft" not in q.text
    assert search.parse_query("-x").text == "-x"
    q = search.parse_query("header:'Article IV' rent")
    assert (q.header_regex, q.text) == ("Article IV", "rent")


@pytest.mark.parametrize("pattern", ["header:[", "header:" + "a" * 121])
def test_bad_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        search.parse_query(pattern)


def ids(df):
    return [r["chunk_id"] for r in df.orderBy("position").collect()]


def test_no_foreign_or_unreadable_hits_and_near_copies_once(chunks):
    assert ids(search.search(chunks, "security deposit landlord month", "a")) == [2, 3, 1]
    assert ids(search.search(chunks, "deposit", "a", include_low_ocr=True, limit=9)) == [2, 3, 6]


def test_negation_filters_after_the_top_k(chunks):
    assert ids(search.search(chunks, "tenant rent deposit -draft", "a", mode="fts")) == [3, 2]


def test_negated_hits_take_no_rank(spark, chunks):
    """Three hits that would come first are negated: the best of the others has rank 1 in both legs."""
    chunks = chunks.withColumns({"content": F.when(F.col("chunk_id") < 4, F.concat("content", F.lit(" deposit landlord Gone"))).otherwise(F.col("content")), "embedding": F.expr(VECTOR)})
    vector = [float(x) for x in chunks.where("chunk_id = 3").first()["embedding"]]
    found = search.explain(chunks, "deposit landlord month demand -gone", "a", vector, floor=-1.0).collect()
    assert [(r["chunk_id"], r["dense_rank"], r["sparse_rank"], r["score"]) for r in found] == [(5, 1, 1, round(2 / 61, 5))]
    queries = spark.createDataFrame([(7, "deposit landlord month demand -gone", "a", vector)], "query_id long, text string, workspace string, embedding array<float>")
    assert rows_of(search.search_batch(chunks, queries, floor=-1.0)) == rows_of(search.explain(chunks, "deposit landlord month demand -gone", "a", vector, floor=-1.0))


def test_boosts_are_capped(chunks):
    hits = search.search(chunks, '"in excess" "one month" Section 1950.5', "a").collect()
    assert max(r["boost"] for r in hits) == pytest.approx(0.12)
    assert "section_locator_match" in hits[0]["match_reasons"] and hits[0]["citation"] == "s.txt p.2 § 1950.5 Deposits"


def test_nothing_found_is_empty(chunks):
    assert ids(search.search(chunks, "zzzzqqq", "a")) == []


def test_access(chunks):
    with pytest.raises(PermissionError):
        search.scoped(chunks, "b", ["a"])
    with pytest.raises(ValueError):
        search.scoped(chunks, "")
    with pytest.raises(ValueError, match="unknown filters: colour"):
        search.scoped(chunks, "a", colour="red")


def test_filters(chunks):
    dated = chunks.withColumns({"doc_id": F.col("chunk_id") % 2, "ingested_at": F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(chunk_id as int))")})
    assert [r["chunk_id"] for r in search.scoped(dated, "a", doc_id=1, date_from="2024-01-03", date_to="2024-01-06").collect()] == [3, 5]
    assert ids(search.search(dated, "deposit", "a", doc_id=0)) == [2]


def rows_of(df):
    return [tuple(r[c] for c in ("rank", "chunk_id", "score", "citation", "dense_rank", "sparse_rank")) for r in df.orderBy("rank").collect()]


VECTOR = "array(" + ", ".join(f"cast(sin(chunk_id * {i + 1}) as float)" for i in range(4)) + ")"


def test_a_table_of_queries_gives_what_single_queries_give(spark, chunks, monkeypatch):
    chunks = chunks.withColumn("embedding", F.when(F.col("chunk_id") != 2, F.expr(VECTOR)))
    asked = [(1, "security deposit landlord month", "a", [0.3, 0.5, 0.1, 0.2]), (2, '"in excess" rent -draft', "a", None), (3, "clause doc_type:authority", "b", [1.0, 0.0, 0.0, 0.0]), (4, "deposit page:2 header:1950", "a", [0.1, 0.9, 0.1, 0.0]), (5, "zzzz", "c", None)]
    queries = spark.createDataFrame(asked, "query_id long, text string, workspace string, embedding array<float>")
    for mode in ("hybrid", "fts", "vector", "rrf+rerank"):
        many = search.search_batch(chunks, queries, mode, floor=-1.0)
        for k, text, workspace, vector in asked:
            if vector is not None or mode != "vector":
                v = [float(x) for x in queries.where(F.col("query_id") == k).first()["embedding"] or []] or None
                assert rows_of(many.where(F.col("query_id") == k)) == rows_of(search.explain(chunks, text, workspace, v, mode=mode, floor=-1.0)), (mode, k)
    monkeypatch.setattr(search, "QUERIES", 2)  # in blocks
    assert {r["query_id"] for r in search.search_batch(chunks, queries, floor=-1.0).collect()} == {1, 2, 3, 4}
    with pytest.raises(PermissionError):
        search.search_batch(chunks, queries, allowed=["a"])


def test_vectors_of_another_length_are_refused(chunks):
    with pytest.raises(ValueError, match="dimensions"):
        search.search(chunks.withColumn("embedding", F.expr(VECTOR)), "deposit", "a", [1.0, 2.0])
    for odd in (1, 5):  # any row of the scope, not the first alone
        with pytest.raises(ValueError, match="dimensions"):
            search.search(chunks.withColumn("embedding", F.when(F.col("chunk_id") == odd, F.expr("array(1f, 0f)")).otherwise(F.expr(VECTOR))), "deposit", "a", [1.0, 2.0, 0.0, 0.0])


def test_a_vector_by_a_function_that_may_fail(chunks):
    chunks, asked = chunks.withColumn("embedding", F.expr(VECTOR)), []
    vector = [0.3, 0.5, 0.1, 0.2]

    def embed(text):
        asked.append(text)
        return vector

    assert rows_of(search.explain(chunks, "deposit month -draft", "a", embed, floor=-1.0)) == rows_of(search.explain(chunks, "deposit month -draft", "a", vector, floor=-1.0)) and asked == ["deposit month"]
    failed = search.explain(chunks, "deposit month", "a", lambda text: 1 / 0, floor=-1.0)
    assert rows_of(failed) == rows_of(search.explain(chunks, "deposit month", "a")) and failed.count()
    assert search.explain(chunks, "deposit", "a", lambda text: 1 / 0, mode="vector").count() == 0


def test_rerankers(chunks):
    search.register_reranker("longest", lambda q, texts: [len(t) for t in texts])
    search.register_reranker("broken", lambda q, texts: 1 / 0)
    longest = search.explain(chunks, "deposit month", "a", reranker="longest").orderBy("rank").collect()
    assert longest[0]["score"] > 50 and [r["score"] for r in longest] == sorted((r["score"] for r in longest), reverse=True)
    assert rows_of(search.explain(chunks, "deposit month", "a", reranker="broken")) == rows_of(search.explain(chunks, "deposit month", "a", rerank=True))
    assert search.explain(chunks, "deposit month", "a", rerank=True, rerank_top_k=1).count() == 1


def test_trace(chunks, tmp_path):
    found = search.explain(chunks, "deposit month", "a")
    row = search.trace(found, "deposit  month", "hybrid", 12.5)
    assert search.append_trace(row, str(tmp_path / "traces")) and not search.append_trace(row, "/proc/no/such")
    got = chunks.sparkSession.read.parquet(str(tmp_path / "traces")).first()
    assert got["n_hits"] == found.count() and got["sparse_ranks"]["2"] == 1 and got["duration_ms"] == 12.5 and len(got["query_hash"]) == 64


# The fields of a hit.
FIELDS = "schema_version citation page_number pdf_page printed_page header locator structured_locator score text document_id chunk_id filename workspace chunk_index dense_score sparse_score vector_rank fts_rank section_boost lexical_boost phrase_boost heading_path match_reasons char_start char_end bbox confidence ocr_mean_confidence used_ocr source_hash file_hash doc_type score_vector".split()


def test_full_hits(chunks):
    chunks = chunks.withColumns({"embedding": F.expr(VECTOR), "doc_id": F.col("chunk_id") * 10, "confidence": F.when(F.col("chunk_id") == 2, 0.5), "char_start": F.lit(3), "char_end": F.lit(9), "heading_path": F.array().cast("array<string>"), "citation": F.when(F.col("chunk_id") == 3, "Own")})
    vector = [float(x) for x in chunks.where("chunk_id = 2").first()["embedding"]]
    query = '"in excess" deposit landlord month Section 1950.5'
    found = search.explain(chunks, query, "a", vector, floor=-1.0, full=True)
    assert set(found.columns) == {*FIELDS, "rank"} and len(FIELDS) == 34
    hits = {r["chunk_id"]: r for r in found.collect()}
    short = {r["chunk_id"]: r for r in search.explain(chunks, query, "a", vector, floor=-1.0).collect()}
    assert {k: (r["score"], r["match_reasons"], r["rank"]) for k, r in hits.items()} == {k: (r["score"], r["match_reasons"], r["rank"]) for k, r in short.items()}
    a, b = hits[2], hits[3]
    assert (a["citation"], b["citation"]) == ("m.txt p.1 Section 1.2 Deposit", "Own") and a["document_id"] == 20 and a["text"].startswith("A security")
    assert (a["used_ocr"], a["ocr_mean_confidence"], b["used_ocr"], b["ocr_mean_confidence"]) == (True, 0.5, False, None)
    assert a["structured_locator"]["kind"] == "page" and a["structured_locator"]["char_span"] == [3, 9] and a["heading_path"] == ["Page 1", "Section 1.2 Deposit"]
    assert b["phrase_boost"] and b["lexical_boost"] and b["section_boost"] and not a["phrase_boost"]
    v = a["score_vector"]
    assert (v["vector_rank"], v["fts_rank"], v["final_score"], v["rrf_score"], v["rerank_rank"]) == (a["vector_rank"], a["fts_rank"], a["score"], a["score"], None)
    again = search.explain(chunks, query, "a", vector, floor=-1.0, rerank=True, full=True).orderBy("rank").first()
    assert again["score_vector"]["rerank_rank"] == 1 and again["score_vector"]["rerank_score"] == round(again["score"], 5)


def test_a_task_compares_few_queries_and_chunks_at_once(spark, monkeypatch):
    made = []
    best = lambda scores, ids, k, f=search._best: made.append(scores.shape) or f(scores, ids, k)
    n = 230
    rows = spark.createDataFrame([(i, "w", "en", 1, "h", "p", f"word{i % 7} rent", [float(i % 11), float(i % 5)]) for i in range(n)], "chunk_id long, workspace string, doc_type string, page int, header string, locator string, content string, embedding array<float>").coalesce(1)
    asked = [(i, search.parse_query(f"word{i % 7} rent" + (" page:2" if i % 9 == 0 else "")), "w", [float(i % 3), 1.0]) for i in range(50)]
    want = [sorted(map(tuple, leg.collect())) for leg in search.batch_legs(rows, asked, 0.05, 4, 4)]
    monkeypatch.setattr(search, "AT_ONCE", 8)
    monkeypatch.setattr(search, "ROWS", 16)
    assert [sorted(map(tuple, leg.collect())) for leg in search.batch_legs(rows, asked, 0.05, 4, 4)] == want and len(want[0]) > 150
    monkeypatch.setattr(search, "_best", best)
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: (list(f(self.toArrow().to_batches())), self.selectExpr("0 leg", "chunk_id query_id", "chunk_id", "0D score"))[1])
    search.batch_legs(rows, asked, 0.05, 4, 4)
    assert made and all(q <= 8 and c <= 16 for q, c in made)
