import numpy as np
from pyspark.sql import functions as F

from quillspark.sources import pdf

WORDS = "doc int, page int, block int, par int, line int, left double, top double, width double, height double, text string"


def words(spark, lines, page=1):
    """Lines as (left, top, text): one word each, a block of its own."""
    rows = [(1, page, i, 1, 1, float(left), float(top), 8.0 * len(text), 10.0, text) for i, (left, top, text) in enumerate(lines)]
    return spark.createDataFrame(rows, WORDS)


def text(spark, lines):
    found = pdf.pages(words(spark, lines)).collect()
    return found[0]["text"] if found else None


def test_words_make_lines(spark):
    rows = [(1, 1, 1, 1, 1, 30.0, 10.0, 8.0, 5.0, "b"), (1, 1, 1, 1, 1, 10.0, 9.0, 8.0, 5.0, "a"), (1, 1, 1, 1, 2, 10.0, 20.0, 8.0, 5.0, "c"), (1, 1, 1, 1, 2, 50.0, 20.0, 8.0, 5.0, " ")]
    got = pdf.lines(spark.createDataFrame(rows, WORDS)).orderBy("line").collect()
    assert [(r["text"], r["width"]) for r in got] == [("a b", 28.0), ("c", 8.0)]


def test_two_columns_are_read_one_after_the_other(spark):
    left = [(50, 100 + 14 * i, f"left{i}") for i in range(4)]
    right = [(320, 107 + 14 * i, f"right{i}") for i in range(4)]
    assert text(spark, right + left) == "left0\nleft1\nleft2\nleft3\n\nright0\nright1\nright2\nright3"


def test_lines_on_one_baseline_are_a_table(spark):
    grid = [(x, 100 + 14 * r + (x > 60) * 1.5, f"c{r}{x}") for r in range(3) for x in (50, 320)]
    rows = pdf.rows(pdf.lines(words(spark, [*grid, (50, 200, "below it"), (50, 214, "a | b"), (50, 228, "c | d")])))
    assert pdf.page_text(rows).first()["text"] == "c050 | c0320\nc150 | c1320\nc250 | c2320\n\nbelow it\na | b\nc | d"
    tables = pdf.tables(rows).orderBy("table_id").collect()
    assert [t["markdown"] for t in tables] == ["| c050 | c0320 |\n| --- | --- |\n| c150 | c1320 |\n| c250 | c2320 |", "| a | b |\n| --- | --- |\n| c | d |"]
    assert (tables[0]["n_rows"], tables[0]["n_columns"], tables[0]["left"], tables[0]["top"]) == (3, 2, 50.0, 100.0)


def test_no_words_no_pages(spark):
    assert pdf.pages(spark.createDataFrame([], WORDS)).collect() == []


def test_checks_on_bytes(spark):
    rows = [(1, b"%PDF-1.7 plain " + b"x" * 9000), (2, b"%PDF " + b"x" * 9000 + b"/Encrypt 5 0 R"), (3, b"%PDF /XObject"), (4, b"%PDF " + b"x" * 5000 + b"/Encrypt" + b"x" * 5000), (5, b"")]
    got = spark.createDataFrame(rows, "i int, c binary").select("i", pdf.is_encrypted(F.col("c")), pdf.has_images(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(1, False, False), (2, True, False), (3, False, True), (4, False, False), (5, False, False)]
    page = spark.createDataFrame([(10, False), (60, True), (60, False), (200, True)], "n int, i boolean")
    assert [r[0] for r in page.select(pdf.needs_ocr(F.col("n"), F.col("i"))).collect()] == [True, True, False, False]


def test_ocr_lines_order_and_quality(spark):
    line = lambda left, top, text: (1, 1, int(left > 900), 1, int(top), float(left), float(top), 400.0, 40.0, text, 0.9)
    rows = [line(100, 50, "Banner"), *[line(100, 200 + 60 * i, f"l{i}") for i in range(3)], *[line(1400, 200 + 60 * i, f"r{i}") for i in range(3)], line(100, 900, "Foot")]
    w = spark.createDataFrame([*rows, (1, 1, 0, 1, 50, 1400.0, 50.0, 200.0, 40.0, "Far", 0.1)], WORDS + ", conf double")
    lines = pdf.ocr_lines(w)
    assert sorted(r["text"] for r in lines.where("top = 50").collect()) == ["Banner", "Far"]
    got = pdf.ocr_order(lines.where("text != 'Far'")).orderBy("place").collect()
    assert [r["text"] for r in got] == ["Banner", "l0", "l1", "l2", "r0", "r1", "r2", "Foot"]
    assert not pdf.set_aside(w).first()["quarantined"] and pdf.set_aside(w.withColumn("conf", F.lit(0.4))).first()["quarantined"]


def test_black_bars_turn_white(spark):
    gray = np.full((120, 300), 255, np.uint8)
    gray[40:60, 50:250] = 0
    gray[80:85, 50:250] = 0  # too thin
    gray[90:110, 10:60] = 0  # too narrow
    row = spark.createDataFrame([(gray.tobytes(), 300)], "p binary, w int").select(pdf.without_bars(F.col("p"), F.col("w")).alias("o")).first()["o"]
    out = np.frombuffer(row["pixels"], np.uint8).reshape(gray.shape)
    assert row["bars"] == [[50, 40, 249, 59]] and (out[35:65, 45:255] == 255).all() and (out[80:85, 50:250] == 0).all()
