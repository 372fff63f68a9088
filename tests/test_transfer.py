"""Export of a workspace and import into another store."""

import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.errors import QuillError
from quillspark.operators import records, transfer, versions

DOCS = "doc_id long, workspace string, filename string, file_hash string"
CHUNKS = "doc_id long, chunk_id long, workspace string, content string, embedding array<float>, ingested_at timestamp"


@pytest.fixture
def folder(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path / "from"), parts=2)
    docs = spark.createDataFrame([(1, "a", "x.txt", "h1"), (2, "a", "y.txt", "h2"), (3, "a", "copy of y.txt", "h2"), (4, "b", "z.txt", "h3")], DOCS)
    chunks = spark.createDataFrame([(1, 10, "a", "über\n\"x\"", [0.1, -2.5e-7]), (1, 11, "a", None, None), (2, 20, "a", "y", [1.0, 0.0]), (3, 30, "a", "y", [1.0, 0.0]), (4, 40, "b", "z", None)], CHUNKS.rsplit(",", 1)[0])
    store.replace({"documents": docs, "chunks": chunks.withColumn("ingested_at", F.expr("timestamp'2024-05-06 07:08:09.123456'"))})
    manifest = transfer.export_workspace(store, "a", str(tmp_path / "out"))
    assert {t: x["n_rows"] for t, x in manifest["tables"].items()} == {"documents": 3, "chunks": 4}
    with pytest.raises(QuillError):
        transfer.export_workspace(store, "nobody", str(tmp_path / "none"))
    return tmp_path / "out"


def shown(store):
    docs = store.read("documents").select("doc_id", "workspace", "file_hash")
    rows = store.read("chunks").join(docs.withColumnRenamed("workspace", "w"), "doc_id")
    return sorted((r["w"], r["workspace"], r["file_hash"], r["content"] or "", r["embedding"] or [], str(r["ingested_at"])) for r in rows.collect())


def test_twice_adds_once(spark, folder, tmp_path):
    store = versions.Store(spark, str(tmp_path / "to"), parts=3)
    assert transfer.import_workspace(store, str(folder), "ann", "c") == {"imported": 2, "left_out": 1}
    at, f = "2024-05-06 07:08:09.123456", lambda *x: [pytest.approx(v) for v in x]
    want = [("c", "c", "h1", "", [], at), ("c", "c", "h1", "über\n\"x\"", f(0.1, -2.5e-7), at), ("c", "c", "h2", "y", [1.0, 0.0], at)]
    assert shown(store) == want
    number = store.version().number
    assert transfer.import_workspace(store, str(folder), "ann", "c") == {"imported": 0, "left_out": 3} and store.version().number == number
    assert transfer.import_workspace(store, str(folder), "ann") == {"imported": 2, "left_out": 1}
    ids = [r["chunk_id"] for r in store.read("chunks").collect()]
    assert len(ids) == len(set(ids)) == 6 and {r["workspace"] for r in store.read("documents").collect()} == {"a", "c"}
    assert [r["detail"] for r in records.audit(store).collect()] == ["2 documents", "2 documents"] and store.broken_links() == []


def test_what_was_changed_is_refused(spark, folder, tmp_path):
    store = versions.Store(spark, str(tmp_path / "to"), parts=2)
    file = next(p for p in Path(folder, "documents").glob("*.gz"))
    raw = gzip.decompress(file.read_bytes()).decode()
    file.write_bytes(gzip.compress(raw.replace("x.txt", "q.txt").encode() if "x.txt" in raw else (raw + raw).encode()))
    for crc in Path(folder, "documents").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(transfer.TransferRefused, match="documents isn't"):
        transfer.import_workspace(store, str(folder), "ann")
    manifest = json.loads((folder / "manifest.json").read_text())
    for name in ("../x", "/etc", "audit", "gone"):
        (folder / "manifest.json").write_text(json.dumps({**manifest, "tables": {name: manifest["tables"]["chunks"]}}))
        for crc in folder.glob(".*.crc"):
            crc.unlink()
        with pytest.raises(transfer.TransferRefused):
            transfer.import_workspace(store, str(folder), "ann")
    (folder / "manifest.json").unlink()
    with pytest.raises(transfer.TransferRefused, match="no manifest"):
        transfer.import_workspace(store, str(folder), "ann")
    assert store.version().number == 0
