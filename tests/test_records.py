"""Deletion, holds and purge in one commit with their audit rows, and tampering with these."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillspark.errors import QuillError
from quillspark.operators import records, versions
from quillspark.operators.governance import LegalHold, WrongToken


@pytest.fixture
def store(spark, tmp_path):
    s = versions.Store(spark, str(tmp_path / "s"), parts=4)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, workspace string")
    chunks = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "doc_id long, chunk_id long")
    s.replace({"documents": docs, "chunks": chunks})
    return s


def ids(store, table="chunks"):
    return sorted(r[0] for r in store.read(table).select("chunk_id" if table == "chunks" else "doc_id").collect())


def actions(store, workspace=None):
    return [(r["action"], r["workspace"], r["detail"]) for r in records.audit(store, workspace).collect()][::-1]


def test_actions_and_their_rows(store):
    assert actions(store) == []
    records.hold(store, "a", True, "ann")
    for f in (lambda: records.delete_document(store, "a", 1, "CONFIRM_DELETE_1", "ann"), lambda: records.purge(store, "a", "CONFIRM_PURGE_a", "ann")):
        with pytest.raises(LegalHold):
            f()
    with pytest.raises(WrongToken):
        records.hold(store, "a", False, "ann")
    records.hold(store, "a", False, "bob", "CONFIRM_RELEASE_HOLD_a")
    records.delete_document(store, "a", 1, "CONFIRM_DELETE_1", "ann")
    assert ids(store) == [20, 30] and ids(store, "documents") == [2, 3]
    with pytest.raises(QuillError):
        records.delete_document(store, "a", 1, "CONFIRM_DELETE_1", "ann")
    with pytest.raises(WrongToken):
        records.purge(store, "a", "yes", "ann")
    records.purge(store, "a", "CONFIRM_PURGE_a", "ann")
    assert ids(store) == [30] and ids(store, "documents") == [3]
    assert actions(store) == [("hold", "a", ""), ("release", "a", ""), ("delete", "a", "1"), ("purge", "a", "1 documents")] and actions(store, "b") == []
    store.compact()
    store.vacuum(keep=1)
    assert len(actions(store)) == 4 and store.broken_links() == []


def test_a_hold_that_is_set_meanwhile_stops_a_purge(store, monkeypatch):
    first = store.version()
    monkeypatch.setattr(store, "version", lambda n=None, real=store.version: first if n is None and not done else real(n))
    done = []
    check = records.is_held

    def then_held(*args):
        found = check(*args)
        done.append(1)
        records.hold(store, "a", True, "ann")
        return found

    monkeypatch.setattr(records, "is_held", then_held)
    with pytest.raises(versions.Conflict):
        records.purge(store, "a", "CONFIRM_PURGE_a", "bob")
    assert ids(store) == [10, 11, 20, 30] and actions(store) == [("hold", "a", "")]


def test_tampering_is_found(store):
    records.hold(store, "a", True, "ann")
    records.hold(store, "b", True, "ann")
    assert store.broken_links() == []
    version = store.version()
    links = version.chain
    folder = Path(store.path, "data", links[0]["folder"])
    file = next(folder.rglob("*.parquet"))
    table = pq.read_table(file, partitioning=None)
    pq.write_table(table.set_column(table.column_names.index("actor"), "actor", pa.array(["eve"] * len(table))), file, use_deprecated_int96_timestamps=True)
    for crc in folder.rglob(".*.crc"):
        crc.unlink()
    assert store.broken_links() == [links[0]["folder"]]
    forged = versions.Version(**{**version.__dict__, "chain": [links[1]]})  # the first addition left out
    assert store.broken_links(forged) == [f"{links[1]['folder']}: link"]
    file.write_bytes(b"no parquet")
    assert store.broken_links() == [links[0]["folder"]]
    file.unlink()
    assert store.broken_links()[0] == links[0]["folder"]
