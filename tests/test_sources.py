import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files
from quillspark.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DOCX = (
    f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Policy</w:t></w:r></w:p>'
    '<w:p><w:r><w:t>Text</w:t></w:r><w:del w:author="Ann"><w:r><w:delText>old</w:delText></w:r></w:del><w:ins w:author="Bob"><w:r><w:t>.</w:t></w:r></w:ins></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
)
EML = b"From: =?utf-8?q?J=C3=B6rg?= <a@b.c>\nSubject: Deal\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=X\n\n--X\nContent-Type: text/plain; charset=utf-8\n\nHello there.\n--X\nContent-Type: text/csv\nContent-Disposition: attachment; filename=t.csv\n\nk,v\n1,2\n--X--\n"


def test_html():
    page = "<!doctype html><head><title>t</title></head><div><h2>Rent &amp; <i>fees</i></h2><p>One<br>two</p><ol><li> first<li>second</ol><table><tr><td>a</td><td> b  c</td></tr></table><style>p{}</style> end</div>"
    assert files.html_text(page) == "## Rent & fees\n\nOne\ntwo\n\n- first\n- second\n\n| a | b c |\nend"
    assert files.html_text(None) == files.html_text("<script>x</script>") == ""


def _folder(tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", DOCX)
    (tmp_path / "ws").mkdir()
    for name, raw in {"a.txt": b"Plain text.", "p.docx": buffer.getvalue(), "m.eml": EML, "j.json": b'{"a":[1]}', "t.csv": b"k,v\n1,2\n3,4\n", "lock.pdf": b"%PDF /Encrypt", "bad.docx": b"PK\x03\x04broken", "e.txt": b"", "x.exe": b"MZ", ".h.txt": b"hidden"}.items():
        (tmp_path / "ws" / name).write_bytes(raw)
    return str(tmp_path)


def test_parse(spark, tmp_path):
    found = files.scan(spark, _folder(tmp_path))
    rows = files.parse(found.where("length > 0")).collect()
    got = {r["path"].rsplit("/", 1)[1]: r for r in rows if not (r["locator"] or "").startswith("Attachment")}
    assert sorted(got) == ["a.txt", "bad.docx", "j.json", "lock.pdf", "m.eml", "p.docx", "t.csv"]
    assert [r["locator"] for r in rows if r["path"].endswith("m.eml")] == ["Message", "Attachment: t.csv > Rows 1-1"]
    assert got["j.json"]["text"] == '{\n  "a": [\n    1\n  ]\n}' and got["t.csv"]["locator"] == "Rows 1-2" and got["lock.pdf"]["error"] == "EncryptedFile"
    assert json.loads(got["p.docx"]["extra"])["redline_changes"] == [{"type": "deletion", "text": "old", "author": "Ann"}, {"type": "insertion", "text": ".", "author": "Bob"}]
    assert got["a.txt"]["text"] == "Plain text." and got["a.txt"]["page"] == 1
    assert got["p.docx"]["text"] == "# Policy\n\nText.\n\n| a | b |" and got["p.docx"]["page"] is None
    assert "Jörg" in got["m.eml"]["text"] and got["m.eml"]["text"].endswith("Hello there.")
    assert got["bad.docx"]["error"] == "BadZipFile"


def test_one_file_to_chunks(spark, tmp_path):
    (tmp_path / "n.md").write_text("# Terms\n\nText of it.")
    chunks = files.parse_and_chunk(spark, str(tmp_path / "n.md")).collect()
    assert [(r["filename"], r["header"], r["content"]) for r in chunks] == [("n.md", "Terms", "# Terms\n\nText of it.")]


def test_types(spark):
    rows = [(b"a,b\n1,2\n", "x"), (b"a\tb\n1\t2\n", "x"), (b"a,b\n1\n", "x.txt"), (b"one, two\n", "x.txt"), (b'{"a":1}', "x"), (b"PK\x03\x04", "x.docx"), (b"", "x.md")]
    got = spark.createDataFrame(rows, "c binary, p string").select(files.mime(F.col("c"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["text/csv", "text/csv", "text/plain", "text/plain", "application/json", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/markdown"]


def test_attached_messages_and_files_by_their_content(spark):
    outer = b"Subject: Fwd\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=Y\n\n--Y\nContent-Type: text/plain\n\nSee below.\n--Y\nContent-Type: message/rfc822\n\n" + EML + b"\n--Y--\n"
    pages = files.HANDLERS["message/rfc822"](outer, "m.eml")
    assert [p[1] for p in pages] == ["Message", "Attachment: Deal", "Attachment: Deal > Attachment: t.csv > Rows 1-1"] and pages[1][2].endswith("Hello there.")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", DOCX)
    rows = [(buffer.getvalue(), "x.bin"), (b"PK\x03\x04", "x.zip"), (b"x = 1\n", "a.py"), (b"select 1", "q.SQL"), (b"a: 1", "c.yaml"), (b"\xd0\xcf", "o.msg")]
    got = spark.createDataFrame(rows, "c binary, p string").select(files.mime(F.col("c"), F.col("p")).alias("m")).collect()
    assert [r["m"] for r in got] == [files.DOCX, "application/zip", "text/x-python", "text/x-sql", "text/plain", "application/vnd.ms-outlook"]
    found = files.parse(spark.createDataFrame([("a.py", b"x = 1\n"), ("o.msg", b"\xd0\xcf")], "path string, content binary")).collect()
    assert [(r["text"], r["error"]) for r in found] == [("x = 1\n", None), ("", "no handler for application/vnd.ms-outlook")]


def states(spark, out):
    return {r["path"].rsplit("/", 1)[1]: (r["state"], r["tries"]) for r in ingest.last_states(ingest.ledger(spark, out)).collect()}


def test_stream_retries_quarantines_replays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder, out, state = _folder(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    assert ingest.ledger(spark, out).collect() == []
    ingest.watch(spark, folder, out, state, once=True).awaitTermination()
    first = states(spark, out)
    assert first["a.txt"] == ("COMMITTED", 1) and first["bad.docx"] == ("FAILED", 1) and first["x.exe"] == ("QUARANTINED", 1)
    assert {r["path"].rsplit("/", 1)[1] for r in ingest.to_retry(ingest.ledger(spark, out)).collect()} == {"bad.docx", "lock.pdf"}
    (tmp_path / "in/ws/new.txt").write_text("Newer text.")
    ingest.watch(spark, folder, out, state, once=True).awaitTermination()  # failed files go with the new one
    assert states(spark, out)["bad.docx"] == ("FAILED", 2) and states(spark, out)["new.txt"] == ("COMMITTED", 1)
    (tmp_path / "in/ws/lock.pdf").unlink()
    assert ingest.retry_failed(spark, out) == 2
    assert states(spark, out)["bad.docx"] == ("QUARANTINED", 3) and states(spark, out)["lock.pdf"] == ("FAILED", 2)  # a file that is gone is left out
    assert ingest.quarantined(ingest.ledger(spark, out)).count() == 2
    (tmp_path / "in/ws/bad.docx").write_bytes((tmp_path / "in/ws/p.docx").read_bytes())
    bad = next(r["path"] for r in ingest.quarantined(ingest.ledger(spark, out)).collect() if r["path"].endswith("bad.docx"))
    assert ingest.replay(spark, out, [bad]) == 1 and states(spark, out)["bad.docx"][0] == "COMMITTED"
    a = bad.replace("bad.docx", "a.txt")
    (tmp_path / "in/ws/a.txt").write_text("Changed.")
    with pytest.raises(PermissionError):
        ingest.reparse(spark, out, a, "yes")
    ingest.reparse(spark, out, a, f"CONFIRM_REPARSE_{a}")
    pages = {r["path"].rsplit("/", 1)[1]: r["text"] for r in ingest.current_pages(spark, out).collect()}
    assert pages["a.txt"] == "Changed." and pages["new.txt"] == "Newer text." and "bad.docx" in pages
    assert ingest.reports(ingest.ledger(spark, out)).count() == 3 and ingest.attempts(ingest.ledger(spark, out)).where("path like '%bad.docx'").count() == 8


def test_progress(spark, tmp_path):
    progress = ingest.Progress(str(tmp_path / "status.json"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x")
    spark.streams.addListener(progress)
    try:
        ingest.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "s"), once=True).awaitTermination()
        for _ in range(100):
            if (tmp_path / "status.json").exists() and not json.loads((tmp_path / "status.json").read_text())["running"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    state = json.loads((tmp_path / "status.json").read_text())
    assert state["files"] >= 1 and state["batches"] >= 1 and not state["running"] and state["error"] is None
