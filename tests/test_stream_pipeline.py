"""The stream from a folder to searchable chunks: states, retries, restarts, vectors made once, metrics."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import embedding, search
from quillspark.sources import files
from quillspark.streaming import pipeline

GOOD = pipeline.STATES[:8]


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in/ws").mkdir(parents=True)
    return tmp_path


def folder(place, **more):
    return pipeline.Folder(str(place / "out"), dimension=16, parts=2, **{"backoff": 0.0, **more})


def run(spark, place, f):
    pipeline.watch(spark, str(place / "in"), f, str(place / "state"), once=True).awaitTermination()


def stories(spark, f):
    out = {}
    for r in pipeline.ledger(spark, f.out).orderBy("batch", "tries", "step").collect():
        out.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["tries"], r["state"]))
    return out


def until(spark, f, done, seconds=120):
    end = time.time() + seconds
    while time.time() < end:
        if done(stories(spark, f)):
            return
        time.sleep(1)
    raise AssertionError(stories(spark, f))


def test_a_dropped_file_is_found_and_a_copy_embeds_nothing(spark, place):
    f = folder(place)
    (place / "in/ws/lease.md").write_text("# Deposit\n\nThe tenant pays a security deposit of one month.\n\n# Rent\n\nRent is due monthly.")
    (place / "in/ws/.hidden.txt").write_text("x")
    (place / "in/ws/half.txt.part").write_text("x")
    run(spark, place, f)
    assert {k: tuple(s for _, s in v) for k, v in stories(spark, f).items()} == {"lease.md": GOOD}
    chunks = pipeline.chunks(spark, f)
    one = chunks.where("header = 'Deposit'").first()
    hit = search.search(chunks, "security deposit", "ws", [float(x) for x in one["embedding"]], floor=0.1).orderBy("position").first()
    assert hit["chunk_id"] == one["chunk_id"] and hit["citation"].startswith("lease.md")
    told = "Document: lease\nSection: Deposit\n" + one["content"]
    assert np.allclose(one["embedding"], embedding.deterministic([told], 16)[0], atol=1e-6) or one["heading_path"] != ["Deposit"]
    # A copy in another workspace: a document of its own, no vector more.
    count = lambda: pipeline._vectors(spark, pipeline.vectors_path(spark, f)).count()
    n = count()
    (place / "in/other").mkdir()
    (place / "in/other/lease.md").write_text((place / "in/ws/lease.md").read_text())
    run(spark, place, f)
    assert count() == n == 2 and pipeline.documents(spark, f).count() == 2 and pipeline.chunks(spark, f).where("embedding is null").count() == 0
    assert {r["workspace"] for r in pipeline.chunks(spark, f).collect()} == {"ws", "other"}
    pipeline.compact_vectors(spark, f, "all")
    assert count() == n and pipeline._vectors(spark, pipeline.vectors_path(spark, f)).select("mark").distinct().count() == 1


def test_tries_timers_quarantine_requests_and_metrics(spark, place):
    f = folder(place)
    (place / "in/ws/good.txt").write_text("Some text.")
    (place / "in/ws/bad.docx").write_bytes(b"PK\x03\x04broken")
    (place / "in/ws/x.exe").write_bytes(b"MZ")
    (place / "in/ws/e.txt").write_bytes(b"")
    query = pipeline.watch(spark, str(place / "in"), f, str(place / "state"), seconds=1)
    try:
        until(spark, f, lambda s: s.get("bad.docx", [(0, "")])[-1][1] == "QUARANTINED")
        found = stories(spark, f)
        assert [t for t, s in found["bad.docx"] if s == "FAILED"] == [1, 2, 3]
        assert [s for _, s in found["x.exe"]] == ["DETECTED", "STAGED", "HASHED", "FAILED", "QUARANTINED"] and "e.txt" not in found
        # Mended and asked for again, it becomes a document; one that is done is replaced.
        (place / "in/ws/bad.docx").unlink()
        (place / "in/ws/good.txt").write_text("Other text.")
        asked = pipeline.last_states(pipeline.ledger(spark, f.out)).where(F.col("path").rlike("good|bad"))
        pipeline.ask_again(asked, f.out)
        until(spark, f, lambda s: Counter(x for _, x in s["good.txt"])["ARCHIVED"] == 2 and Counter(x for _, x in s["bad.docx"])["QUARANTINED"] == 2)
    finally:
        query.stop()
    assert [r["content"] for r in pipeline.chunks(spark, f).collect()] == ["Other text."]
    rows = pipeline.ledger(spark, f.out)
    assert {r["path"].rsplit("/", 1)[1] for r in pipeline.quarantined(rows).collect()} == {"bad.docx", "x.exe"}
    assert rows.where("reason = 'file is gone'").count() == 2  # FAILED and QUARANTINED
    now = pipeline.metrics(spark, f.out)
    count = lambda c: rows.where(c).count()
    assert (now.processed, now.failed, now.quarantined, now.retries, now.active_retries) == (count("state = 'ARCHIVED'"), count("state = 'FAILED'"), count("state = 'QUARANTINED'"), count("state = 'DETECTED' and tries > 1"), 0)
    assert (now.processed, now.retries) == (2, 2)


def test_a_batch_that_dies_runs_again_and_counts_once(spark, place, monkeypatch):
    f = folder(place)
    (place / "in/ws/a.txt").write_text("First text.")
    run(spark, place, f)
    (place / "in/ws/b.txt").write_text("Second text.")
    for name in ("_record", "_add_metrics", "_commit"):  # the last: nothing of the batch is committed yet
        with monkeypatch.context() as m:
            m.setattr(pipeline, name, lambda *_: 1 / 0)
            with pytest.raises(Exception, match="division|FOREACH_BATCH"):
                run(spark, place, f)
        texts = sorted(r["content"] for r in pipeline.chunks(spark, f).collect())
        assert texts == (["First text."] if name == "_commit" and len(texts) == 1 else ["First text.", "Second text."])
    run(spark, place, f)
    assert sorted(r["content"] for r in pipeline.chunks(spark, f).collect()) == ["First text.", "Second text."]
    assert {k: tuple(s for _, s in v) for k, v in stories(spark, f).items()} == {"a.txt": GOOD, "b.txt": GOOD}
    assert pipeline.metrics(spark, f.out).processed == 2


def test_a_failing_handler_is_tried_again_after_a_restart(spark, place, monkeypatch):
    f = folder(place, tries=2)
    (place / "in/ws/a.eml").write_bytes(b"Subject: x\n\nHello.")

    def broken(*_):
        raise OSError("not now")

    with monkeypatch.context() as m:
        m.setitem(files.HANDLERS, "message/rfc822", broken)
        run(spark, place, f)
    assert stories(spark, f)["a.eml"][-1] == (1, "FAILED") and pipeline.metrics(spark, f.out).active_retries == 1
    query = pipeline.watch(spark, str(place / "in"), f, str(place / "state"), seconds=1)
    try:
        until(spark, f, lambda s: s["a.eml"][-1] == (2, "ARCHIVED"))
    finally:
        query.stop()
    assert pipeline.metrics(spark, f.out).active_retries == 0


def test_totals_hold_what_the_ledger_tells(spark, place, monkeypatch):
    """Whoever sees a try in the ledger may stop the stream and read the totals."""
    f = folder(place)
    (place / "in/ws/a.txt").write_text("Some text.")
    (place / "in/ws/x.exe").write_bytes(b"MZ")
    add, told = pipeline._add_metrics, []
    monkeypatch.setattr(pipeline, "_add_metrics", lambda *a: (told.append(list((place / "out/ledger").rglob("*.parquet"))), add(*a)))
    run(spark, place, f)
    assert told == [[]]
    now = pipeline.metrics(spark, f.out)
    assert (now.processed, now.failed, now.quarantined, now.retries) == (1, 1, 1, 0)
    assert {k: v[-1] for k, v in stories(spark, f).items()} == {"a.txt": (1, "ARCHIVED"), "x.exe": (1, "QUARANTINED")}


def test_page_cap_and_quota(spark, place):
    f = folder(place, most_pages=2, quota=60)
    (place / "in/ws/ok.txt").write_text("x" * 50)
    (place / "in/ws/long.csv").write_text("k,v\n" + "1,2\n" * 12)
    (place / "in/ws/wide.txt").write_text("y" * 61)
    run(spark, place, f)
    (place / "in/ws/later.txt").write_text("z" * 20)  # 50 characters are there
    (place / "in/other").mkdir()
    (place / "in/other/fine.txt").write_text("z" * 20)
    (place / "in/other/many.csv").write_text("k\n" + "1\n" * 4)
    monkey = pipeline.Folder(**{**f.__dict__, "most_pages": 0})
    run(spark, place, monkey)
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in pipeline.quarantined(pipeline.ledger(spark, f.out)).collect()}
    assert reasons == {"wide.txt": "quota of the workspace", "later.txt": "quota of the workspace", "fine.txt": "too many pages", "many.csv": "too many pages"}
    assert {r["filename"]: r["n_pages"] for r in pipeline.documents(spark, f).collect()} == {"ok.txt": 1, "long.csv": 1}
    assert pipeline.usage(spark, f).first()["used"] >= 50


def test_prometheus_text():
    text = pipeline.prometheus(pipeline.Metrics(processed=5, failed=4, quarantined=1, retries=2, queue_depth=7), "x")
    assert text == (
        "# HELP x_files_processed_total Files that became documents\n# TYPE x_files_processed_total counter\nx_files_processed_total 5\n"
        "# HELP x_files_failed_total Tries that failed\n# TYPE x_files_failed_total counter\nx_files_failed_total 4\n"
        "# HELP x_files_quarantined_total Files that are not tried again\n# TYPE x_files_quarantined_total counter\nx_files_quarantined_total 1\n"
        "# HELP x_retry_attempts_total Tries after the first\n# TYPE x_retry_attempts_total counter\nx_retry_attempts_total 2\n"
        "# HELP x_queue_depth Files in the folder that no batch has taken\n# TYPE x_queue_depth gauge\nx_queue_depth 7\n"
        "# HELP x_active_retries Files that wait for another try\n# TYPE x_active_retries gauge\nx_active_retries 1\n"
    )
