import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.chunker import apart, blocks, chunk_documents, fill, sections

BYLAWS = "ARTICLE I\n\nSection 1.1 Name\nThe name is X.\n\nSection 1.2 Seat\nThe seat is Y.\n\nARTICLE II\nSection 2.1 Board\nSix members."
SCHEMA = "doc_id long, filename string, pages array<struct<page:int,text:string>>"


def chunks(spark, pages, *limits):
    docs = spark.createDataFrame([(i, f"d{i}.txt", p) for i, p in enumerate(pages)], SCHEMA)
    return chunk_documents(docs, *limits).orderBy("doc_id", "chunk_index").collect()


def test_headings_nest(spark):
    out = chunks(spark, [[(1, BYLAWS)]])
    assert [c["header"] for c in out] == ["ARTICLE I", "Section 1.1 Name", "Section 1.2 Seat", "ARTICLE II", "Section 2.1 Board"]
    assert out[2]["heading_path"] == ["Page 1", "ARTICLE I", "Section 1.2 Seat"]
    assert out[4]["heading_path"] == ["Page 1", "ARTICLE II", "Section 2.1 Board"]
    assert [c["citation"] for c in out] == [f"d0.txt p.1 {c['header']}" for c in out] and [c["chunk_index"] for c in out] == [0, 1, 2, 3, 4]


LINES = [
    ("# Terms", "Terms"),
    ("Page 3 of 9", None),
    ("Section 1950", None),
    ("EXHIBIT B", None),
    ("GENERAL TERMS", "General Terms"),
    ("see Section 4.1 below", None),
    ("Intro ..... 4", None),
    ("TENANT'S DUTY", "Tenant'S Duty"),
    ("TITLE Section 3 Rent", "TITLE Section 3 Rent"),
    ("Section 4.2: " + "on " * 32, "Section 4.2"),
    ("8.22.030 Notices", "8.22.030 Notices"),
    ("RENT; FEES", None),
    ("plain words", None),
    ("#" + "x" * 120, None),
    ("", None),
]


def test_heading(spark):
    rows = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(LINES)], "i int, line string").select("i", T.heading(T.strip(F.col("line"))).alias("h")).collect()
    assert {r["i"]: r["h"] for r in rows} == {i: want for i, (_, want) in enumerate(LINES)}


def test_levels(spark):
    rows = spark.createDataFrame([(x,) for x in ("Article IV", "Section 1.2", "8.22.030 Rent", "(a) x", "GENERAL")], "t string")
    assert [r[0] for r in rows.select(T.heading_level(F.col("t"))).collect()] == [1, 2, 3, 3, 1]


def test_pages_and_consecutive_headings(spark):
    out = chunks(spark, [[(1, "# A\n## B\ntext one"), (2, "text two\nPage 2 of 3\nmore"), (None, "loose"), (3, None)]])
    assert [(c["page"], c["header"], c["content"]) for c in out] == [(1, "A", "# A"), (1, "B", "## B\n\ntext one"), (2, "B", "text two\n\nmore\n\nloose")]
    plain = chunks(spark, [[(1, "FIRST PART\nSECOND PART\nbody\nARTICLE III")]])  # headings without a number share a chunk
    assert [(c["header"], c["content"]) for c in plain] == [("Second Part", "FIRST PART\n\nSECOND PART\n\nbody"), ("ARTICLE III", "ARTICLE III")]


def test_long_sections_continue_with_overlap(spark):
    text = "# Long\n\n" + "\n\n".join(f"Paragraph {i} " + "word " * 12 for i in range(30))
    out = chunks(spark, [[(None, text)]], 400, 80)
    assert len(out) > 3 and {c["header"] for c in out} == {"Long"} and all(len(c["content"]) <= 400 for c in out)
    assert out[1]["content"].split("\n\n")[0] in out[0]["content"] and out[1]["locator"] == "Long"


def test_sentences_of_a_long_paragraph_have_exact_offsets(spark):
    text = "  First one.   Second\n\tpart! " + "Third " * 20 + "end? Last."
    out = chunks(spark, [[(1, text)]], 40, 0)
    assert [text[c["char_start"] : c["char_end"]].split() for c in out] == [c["content"].split() for c in out]
    assert [c["content"] for c in out][:2] == ["First one.\n\nSecond\npart!", ("Third " * 20 + "end?")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=40), st.integers(20, 80), st.integers(0, 30))
def test_fill_covers_every_piece_in_order(lengths, most, overlap):
    out = list(fill(lengths, most, overlap))
    assert [i for low, high, _ in out for i in range(low, high)] == sorted(i for low, high, _ in out for i in range(low, high)) or overlap
    assert {i for low, high, _ in out for i in range(low, high)} == set(range(len(lengths)))
    for low, high, own in out:
        assert low <= own < high
        assert high - low == 1 or sum(n + 2 for n in lengths[low:high]) <= most or sum(n + 2 for n in lengths[low : high - 1]) <= overlap + 2


def test_invariants_and_odd_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("filename"), F.array(F.struct(F.lit(1).alias("page"), "text")).alias("pages"), "text")
    out = chunk_documents(docs, 300, 60).join(docs.select("doc_id", "text"), "doc_id")
    assert out.where("char_start < 0 or char_end > length(text) or char_start >= char_end or content = ''").count() == 0
    longest = "array_max(transform(split(content, '\n\n'), x -> length(x)))"
    assert out.where(f"length(content) > 300 and {longest} + 64 <= 300").count() == 0  # only a sentence that is too long makes a chunk too long
    covered = out.groupBy("doc_id").agg(F.min("char_start"), F.max("char_end"), (F.max("chunk_index") + 1 - F.count("*")).alias("gap"))
    assert covered.where("gap != 0").count() == 0 and covered.count() == docs.where("trim(text) != ''").count()


@pytest.mark.parametrize("rows", [[], [(1, "e.txt", [])], [(1, "n.txt", [(None, None)]), (None, None, None), (2, "b.txt", [(1, " \n ")])]])
def test_no_chunks(spark, rows):
    assert chunk_documents(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_sentences_of_a_long_block_do_not_carry_it_along(spark):
    text = " ".join(f"Sentence {i} of one block." for i in range(300))
    docs = spark.createDataFrame([(1, "d.txt", [(1, text), (2, "A short one. It stays whole.")])], SCHEMA)
    rows = apart(sections(blocks(docs)), 1800)
    held = F.sum(sum((F.length(F.coalesce(c, F.lit(""))) for c in ("text", "_s")), F.lit(0)))
    assert rows.where("page = 1").agg(F.count("*"), held).first() == (300, len(text))
    assert [(r["text"], r["_s"]) for r in rows.where("page = 2").collect()] == [("A short one. It stays whole.",) * 2]
