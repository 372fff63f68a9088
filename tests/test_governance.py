import pytest

from quillspark.operators import governance as G


@pytest.fixture
def workspaces(spark):
    return spark.createDataFrame([("a", False), ("b", True)], "workspace string, is_legal_hold boolean")


@pytest.fixture
def tables(spark):
    return {"documents": spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "workspace string, document_id long")}


def ids(df):
    return sorted(r["document_id"] for r in df.collect())


def test_purge_and_delete(workspaces, tables):
    assert ids(G.purge(tables, workspaces, "a", "CONFIRM_PURGE_a")["documents"]) == [3, 4]
    assert ids(G.delete_document(tables, workspaces, "a", 2, "CONFIRM_DELETE_2")["documents"]) == [1, 3, 4]
    with pytest.raises(G.WrongToken):
        G.purge(tables, workspaces, "a", "yes")
    with pytest.raises(G.LegalHold):
        G.purge(tables, workspaces, "b", "CONFIRM_PURGE_b")


def test_holds(workspaces, tables):
    with pytest.raises(G.WrongToken):
        G.hold(workspaces, "b", False)
    free = G.hold(workspaces, "b", False, "CONFIRM_RELEASE_HOLD_b")
    assert ids(G.purge(tables, free, "b", "CONFIRM_PURGE_b")["documents"]) == [1, 2, 4]


def test_audit_only_grows(spark, tables, tmp_path):
    for _ in range(2):
        G.audit(tables["documents"], str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 8


def test_digest_and_export(spark, tables, tmp_path):
    d = tables["documents"]
    one, again = G.bundle_digest(d).collect()[0], G.bundle_digest(d.repartition(3)).collect()[0]
    assert one == again and one["n_rows"] == 4 and one != G.bundle_digest(d.limit(3)).collect()[0]
    G.export(tables, "a", str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out" / "documents"))
    assert ids(back) == [1, 2]
    assert ids(G.imported(back.union(back), d.where("document_id = 1"), ["workspace", "document_id"])) == [2]


def test_csv_pages():
    from quillspark.sources.files import _csv

    pages = _csv(("k;v\n" + "".join(f"{i};x\n" for i in range(35))).encode(), "a.csv")
    assert [p[1] for p in pages] == ["Rows 1-30", "Rows 31-35"] and pages[1][2].startswith("| k | v |\n| --- | --- |\n| 30 | x |")


def test_siblings_of_a_name_that_ends_within_a_word(spark):
    from quillspark.operators import corpus

    files = [("w", 1, "lease.pdf"), ("w", 2, "lease2_exhibit_A.pdf"), ("w", 3, "lease.v2_exhibit.pdf"), ("v", 4, "lease.pdf"), ("w", 5, "Lease.pdf"), ("w", 6, "exhibit")]
    got = corpus.exhibit_siblings(spark.createDataFrame(files, "workspace string, document_id long, filename string")).collect()
    assert sorted((r["document_id"], r["sibling_id"]) for r in got) == [(1, 2), (1, 3)]
