import pytest
from pyspark.sql import functions as F

from quillspark.errors import CartridgeError, DimensionMismatch
from quillspark.operators import cartridge, corpus, embedding, packs, structure

ROWS = [(1, "Deposit law", "CA", "codes", "Section 1 Deposits\nA landlord holds a security deposit of one month."), (2, "Rent law", "NY", "codes", "Rent rises once a year."), (3, "A case", "CA", "cases", "The court found for the tenant. " * 90), (4, "Empty", "CA", "cases", "")]
SOURCE = "record_id long, title string, jurisdiction string, source_table string, text string"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cartridge") / "c")
    documents, chunks = cartridge.forge(spark.createDataFrame(ROWS, SOURCE), dimension=16)
    cartridge.write(documents, chunks, path, "deterministic", 16)
    return path


def vector(text):
    return embedding.deterministic([text], 16)[0].tolist()


def test_forge_write_open(spark, made):
    c = cartridge.open_cartridge(spark, made, "deterministic")
    assert (c.n_documents, c.dimension) == (4, 16) and c.n_chunks == c.chunks.count() > 3
    assert {r["title"]: r["total_chunks"] for r in c.documents.collect()}["Empty"] == 0
    with pytest.raises(CartridgeError):
        cartridge.open_cartridge(spark, made, "other")
    with pytest.raises(CartridgeError):
        cartridge.open_cartridge(spark, made + "-gone")
    done = spark.createDataFrame([(1,), (3,)], "record_id long")
    assert cartridge.forge(spark.createDataFrame(ROWS, SOURCE), done, dimension=4)[0].count() == 2


def test_find(spark, made):
    c = cartridge.open_cartridge(spark, made)
    hits = cartridge.find(c, "what is a security deposit", vector("security deposit")).collect()
    assert hits[0]["title"] == "Deposit law" and hits[0]["sort_score"] > hits[0]["score"]
    assert {r["jurisdiction"] for r in cartridge.find(c, "rent tenant", vector("x"), jurisdiction="ny").collect()} == {"NY"}
    fallback = cartridge.find(c, "zzzz", vector("zzzz"), source_table="cases").collect()
    assert fallback and all(r["source_table"] == "cases" for r in fallback) and [r["score"] for r in fallback] == sorted((r["score"] for r in fallback), reverse=True)
    with pytest.raises(DimensionMismatch):
        cartridge.find(c, "rent", [1.0])


def test_the_index_and_a_scan_find_the_same(spark, made):
    c = cartridge.open_cartridge(spark, made)
    assert c.index is not None
    plan = c.index.blocks(["deposit"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    scan = cartridge.Cartridge(**{**c.__dict__, "index": None})
    for words, more in ((["deposit", "month"], {}), (["court"], {}), (["rent"], {"jurisdiction": "ny"}), (["tenant"], {"source_table": "cases"})):
        found = [cartridge.find(x, "q", vector("deposit"), terms=words, **more).collect() for x in (c, scan)]
        assert [r["chunk_id"] for r in found[0]] == [r["chunk_id"] for r in found[1]] and found[0]
    assert cartridge.find(c, "q", vector("x"), terms=["deposits"]).collect()[0]["title"] == "Deposit law"  # by its stem


def test_bundle_merge_and_sources(spark, made, tmp_path):
    c = cartridge.open_cartridge(spark, made)
    cartridge.bundle(c, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b/chunks")).count() == c.n_chunks
    new = c.documents.where("record_id = 1").withColumn("title", F.lit("New"))
    assert {r["record_id"]: r["title"] for r in cartridge.merged(c.documents, new, "record_id").collect()}[1] == "New"
    raw = spark.createDataFrame([(1, "x" * 51, "law", "y" * 31), (2, "x", "law", "y"), (3, None, "rule", None)], "id int, opinion_text string, data_type string, content string")
    assert [r["id"] for r in cartridge.cases(raw).collect()] == [1] and [r["id"] for r in cartridge.codes(raw, "law").collect()] == [1]


PAGE = "Intro line\nSection 1950.5 Deposits\nA landlord shall not demand security in excess of one month's rent.\nArticle 2. Rent\nNotice within 14 days. Vacancy decontrol must hold."


def test_packs(spark):
    pages = spark.createDataFrame([("lease", 1, PAGE), ("lease", 2, "More text. It preempts older rules."), ("bare", 1, ""), ("long", 1, "word " * 30_000)], "doc string, page int, text string")
    e = {(r["doc"], r["page"], r["section"]): r for r in packs.entries(pages).collect()}
    assert [e["lease", 1, i]["citation"] for i in range(3)] == ["lease p.1", "19505", "2"] and e["lease", 1, 0]["title"] == "General Provisions"
    assert {s["slot"]: s["value"] for s in e["lease", 1, 1]["slots"]} == {"deposit_cap_months": 1.0}
    assert {s["slot"]: s["value"] for s in e["lease", 1, 2]["slots"]} == {"accounting_days": 14.0, "vacancy_decontrol": 1.0}
    assert e["lease", 2, 0]["preempts"] == ["older rules"] and e["bare", 0, 0]["hierarchy_level"] == "document" and e["long", 1, 0]["estimated_tokens"] > 30_000
    chunks = spark.createDataFrame([("d", 1, 2, "b"), ("d", 0, 2, "a"), ("d", 2, None, "c")], "doc string, chunk_index int, page int, content string")
    assert {r["page"]: r["text"] for r in packs.pages_of(chunks).collect()} == {2: "a\n\nb", 0: "c"}
    assert {r["doc"]: r["topics"] for r in packs.covered_topics(packs.entries(pages)).collect()}["bare"] == ["General"]


def test_yaml(spark):
    pages = spark.createDataFrame([("it's", 1, PAGE)], "doc string, page int, text string")
    text = packs.to_yaml(packs.entries(pages), "it's", version="1.0.0", edition=None, tags=[])
    assert text.startswith("pack_id: 'it''s'\nversion: '1.0.0'\nedition: null\ntags: []\ncovered_topics:\n")
    assert "raw_content: |-\n" in text and "      Section 1950.5 Deposits\n" in text and text.count("\n  - page: 1\n") == 3


def test_slots_are_grounded(spark):
    said = ["Two months' rent as a security deposit.", "The tenant must cure within ten days. Later, written notice to cure of 20 days.", "A fine of $25.50 for each day.", "No vacancy decontrol here.", "eleven months"]
    got = {(r["section_id"], r["slot"]): (r["value"], r["unit"]) for r in structure.slots(spark.createDataFrame(list(enumerate(said)), "section_id int, text string")).collect()}
    assert got == {(0, "deposit_cap_months"): (2.0, "months"), (1, "cure_days"): (20.0, "days"), (2, "daily_statutory_penalty"): (25.5, "USD")}


def test_row_groups_of_a_large_group(spark):
    rows = spark.range(2000).select(F.lit("g").alias("g"), F.col("id").alias("n"), F.concat(F.lit("v"), "id").alias("v"))
    got = structure.row_groups(rows.repartition(3), "g", "n", ["n", "v"]).orderBy("page_seq").collect()
    assert [r["locator"] for r in got[:2]] == ["Rows 1-30", "Rows 31-60"] and len(got) == 67 and got[-1]["content"].endswith("| 1999 | v1999 |")


def test_orders(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "failed_at int, path string")
    assert [r["path"] for r in corpus.ordered(rows, "poison").collect()] == ["b", "a"]


@pytest.mark.parametrize(("keys", "parts"), [([1], 4), (list(range(1000)), 7), ([5] * 900 + list(range(100)), 4), ([10**12] * 50 + list(range(-60, 0)), 3), ([i**3 for i in range(500)], 16)])
def test_key_ranges(keys, parts):
    low, high = min(keys), max(keys)

    def counts(a, b, width):
        found = {}
        for k in keys:
            if a <= k <= b:
                found[(k - a) // width] = found.get((k - a) // width, 0) + 1
        assert len(found) <= 32
        return list(found.items())

    ranges = cartridge.key_ranges(counts, low, high, parts, steps=32)
    assert ranges[0][0] == low and ranges[-1][1] == high and all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:]))  # noqa: B905
    share = -(-len(keys) // parts)
    sizes = [sum(a <= k <= b for k in keys) for a, b in ranges]
    assert len(ranges) <= 2 * parts and sum(sizes) == len(keys)
    assert all(n <= share or len({k for k in keys if a <= k <= b}) == 1 for n, (a, b) in zip(sizes, ranges, strict=True))


def test_read_sql(spark):
    url = "jdbc:derby:memory:source;create=true"
    con = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        con.createStatement().execute("CREATE TABLE CASES (ID BIGINT, TEXT VARCHAR(40))")
        put = con.prepareStatement("INSERT INTO CASES VALUES (?, ?)")
        rows = [(i if i < 300 else 10**9 + i * 7, f"text {i}") for i in range(400)]
        for i, t in rows:
            put.setLong(1, i)
            put.setString(2, t)
            put.execute()
        con.createStatement().execute("INSERT INTO CASES VALUES (NULL, 'no key')")
        df = cartridge.read_sql(spark, url, "CASES", "ID", 8)
        assert sorted((r["ID"] or 0, r["TEXT"]) for r in df.collect()) == sorted([*rows, (0, "no key")])
        sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) >= 8 and max(sizes) <= 51
        some = df.where("ID > 1000 and TEXT <> 'text 399'")
        assert "PushedFilters: [*IsNotNull(ID), *IsNotNull(TEXT), *GreaterThan(ID,1000)" in some._jdf.queryExecution().executedPlan().toString() and some.count() == 99
        assert cartridge.read_sql(spark, url, "CASES", "ID", 4, where="TEXT LIKE 'text 1%'").count() == 111
        assert cartridge.read_sql(spark, url, "CASES", "ID", 4, where="ID < 0").count() == 0
    finally:
        con.close()


def test_whole_packs_and_their_slots(spark):
    made = spark.createDataFrame([("p", "Pack", "1", "CA", "x", ["Rent"]), ("q", None, "1", "CA", "x", []), ("r", "Pack", "1", "CA", "x", None)], "pack_id string, publisher string, version string, description string, coverage string, covered_topics array<string>")
    entries = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "pack_id string, entry_no int")
    got = sorted(tuple(r) for r in structure.pack_root_violations(made, entries).collect())
    assert got == [("q", "missing publisher"), ("q", "no covered topics"), ("r", "no covered topics"), ("r", "no entries")]
    assert {r["violation"] for r in structure.pack_root_violations(made.drop("version"), entries).where("pack_id = 'p'").collect()} == {"missing version"}
    slots = [("p", 1, "a", 1.0, "one month's rent"), ("p", 1, "b", 21.0, "within 21 days"), ("p", 1, "c", 3.5, "a 3.5% rise"), ("p", 1, "d", 14.0, "within ten days"), ("p", 2, "e", 7.0, ""), ("p", 2, "f", None, "seven")]
    found = structure.slot_violations(spark.createDataFrame(slots, "pack_id string, entry_no int, slot string, value double, quoted_sentence string")).collect()
    assert sorted((r["slot"], r["violation"]) for r in found) == [("d", "value not in its sentence"), ("e", "no quoted sentence"), ("f", "value not in its sentence")]
