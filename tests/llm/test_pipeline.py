from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import quality_rules, toxicity
from tests.llm.test_neardup import brute
from tests.llm.test_tokens import check_packing


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in kept.items()}
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    text = {r["doc_id"]: r["text"] for r in source.collect()}
    assert ids["toxicity"] == {k for k, t in text.items() if model.score(t) < 0.5}
    good = {r["doc_id"] for r in quality_rules.ledger(source).where(quality_rules.verdict("v2")).collect()}
    assert ids["quality_rules"] == ids["toxicity"] & good
    least, _ = brute({k: text[k] for k in ids["quality_rules"]})
    assert ids["near_duplicates"] == set(least.values())
    assert ids["mixing"] == ids["near_duplicates"] == ids["packing"]
    covered, full = check_packing(kept["packing"].collect(), None)
    assert full > 0.97


def through(spark, docs, sf_dir, folder):
    """All stages, each written and read, with the rows that each leaves."""
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, sf_dir).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        assert name == "packing" or docs.columns == columns
        left[name] = docs.collect()
    return left


def test_odd_rows_and_clashing_columns(spark, sf_dir, tmp_path, odd):
    more = [(20 + i, f"Sentence number {i} tells of apples, pears and of plums in plenty." + " More words follow here now." * (i % 3), "en", None if i % 2 else "a", 60) for i in range(8)]
    rows = odd.unionByName(spark.createDataFrame(more + more[:2] + [(None, "A text of ten words without any id of its own.", "en", "a", 40)] * 2, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    rows = rows.withColumns({c: F.lit(1) for c in ("_key", "_salt", "_one", "_rows", "_row", "position", "slot", "epoch", "rep", "bucket")})
    left = through(spark, rows, sf_dir, tmp_path)
    kept = [r["doc_id"] for r in left["near_duplicates"]]
    assert len(kept) == len(set(kept)) and {20, 21, 22}.issuperset(k for k in kept if k in (20, 21, 22)) and kept.count(None) == 1
    assert {r["doc_id"] for r in left["packing"]} == {r["doc_id"] for r in left["mixing"]} == set(kept)
    assert {4, 5, 6, 7}.isdisjoint(kept)


def test_an_empty_table(spark, sf_dir, tmp_path, none):
    assert not any(through(spark, none, sf_dir, tmp_path).values())


def test_entry_without_the_subpackage(tmp_path):
    """The library's own queries stay when the optional folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for p in ("quillspark", "__spark_entry__.py"):
        (shutil.copytree if (root / p).is_dir() else shutil.copy)(root / p, tmp_path / p)
    shutil.rmtree(tmp_path / "quillspark" / "llm")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.stdout.split()[1] == "False", said.stderr
