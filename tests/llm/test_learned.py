import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import cotrain, toxicity
from quillspark.llm.common import stored

BIG = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    y, p = np.array([r["toxic"] for r in got]), np.array([r["score"] for r in got]) >= 0.5
    assert p[y == 1].mean() > 0.75 and p[y == 0].mean() < 0.03


def test_labels_of_the_held_out_fold_change_nothing(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_label_model_finds_the_better_voters():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.2
    good = np.stack([y & (rng.random(3000) < 0.7) for _ in range(4)], 1)
    twin = np.concatenate([good, good[:, :1]], 1)
    post, accuracy, voice = toxicity.label_model(twin)
    assert ((post > 0.5) == twin.any(1)).mean() > 0.98 and voice[0] == voice[4] == 0.5 and voice[1] == 1.0


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).collect() == []
    assert toxicity.clean(odd, model).columns == odd.columns


def test_a_toxicity_model_meets_odd_rows(spark, docs, sf_dir, odd):
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[4] == by[5] == by[6] and by[1] == by[2] == by[3]
    assert model.score("you worthless stupid idiot, you pathetic moron and scum") > 0.9 > 0.5 > model.score(None)


def test_scores_against_brute_force(spark, docs, sf_dir, texts):
    """A score is the logistic of the weights of all terms that a text has, each once."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for r in toxicity.score(docs, model).collect():
        z = model.bias + sum(w for t, w in model.weights.items() if t in toxicity.terms(texts[r["doc_id"]]))
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    feats = stored(cotrain.features(docs), "features")
    got = cotrain.score(feats, cotrain.fit(feats, labels)).join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    y, p = np.array([r["quality"] for r in got]), np.array([r["score"] for r in got])
    order = p.argsort().argsort() + 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    assert (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.97
    assert ((p >= 0.5) == y).mean() > 0.95 and abs(p.mean() - y.mean()) < 0.05  # calibrated to the share of good documents


def test_quality_against_brute_force(spark, docs, sf_dir):
    """Rounds of two naive Bayes views in plain Python give the same model."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    feats = stored(cotrain.features(docs), "features")
    model = cotrain.fit(feats, labels, rounds=2)
    known = {}
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", cotrain.held_out().alias("h"), F.lit(0)).collect()}
    back = {r["doc_id"]: r["b"] for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4).alias("b")).collect()}
    for r in labels.collect():
        if r["doc_id"] in held and not held[r["doc_id"]]:
            known[r["doc_id"]] = min(r["quality"], known.get(r["doc_id"], 1))
    rows = [(r["doc_id"], {"text_view": r["text_view"], "meta_view": r["meta_view"]}) for r in feats.collect()]
    odds = lambda view, steps: view.base + sum(w[s] for w, s in zip(view.weights, steps, strict=True))
    views, other = None, {"text_view": "meta_view", "meta_view": "text_view"}
    for turn in range(3):
        counts = {}
        for k, x in rows:
            for v in x:
                label, pseudo = known.get(k) if not back[k] else None, False
                if k not in known and turn:
                    z, pseudo = odds(views[other[v]], x[other[v]]), True
                    label = 1 if z > np.log(19) else 0 if z < -np.log(19) else None
                if label is not None:
                    for i, step in enumerate(x[v]):
                        key = (v, i, step, label, pseudo)
                        counts[key] = counts.get(key, 0) + 1
        views = {v: cotrain.bayes(counts, v) for v in other}
    for v in other:
        z = [(round(8 * min(30, max(-30, odds(views[v], x[v])))) / 8, known[k]) for k, x in rows if k in known and back[k]]
        want = views[v].scaled(*cotrain.platt(np.array([a for a, _ in z]), np.array([float(y) for _, y in z]), np.ones(len(z))))
        got = getattr(model, v)
        assert abs(got.base - want.base) < 1e-3 and all(np.allclose(a, b, atol=1e-3) for a, b in zip(got.weights, want.weights, strict=True))
    for r in cotrain.score(feats, model).collect():
        x = dict(rows)[r["doc_id"]]
        z = odds(model.text_view, x["text_view"]) + odds(model.meta_view, x["meta_view"]) - model.prior
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and r["kept"] == (r["score"] >= 0.5)


def test_quality_odd_rows(spark, docs, sf_dir, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    odd, none = cotrain.features(odd), cotrain.features(none)
    assert cotrain.fit(odd, labels) is None and cotrain.fit(none, labels) is None
    got = cotrain.score(odd, None).collect()
    assert len(got) == odd.count() and {r["score"] for r in got} == {0.5}
    model = cotrain.fit(stored(cotrain.features(docs), "features"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for m in (None, model):
        assert cotrain.score(none, m).collect() == []
    by = {r["doc_id"]: r["score"] for r in cotrain.score(odd, model).collect()}
    assert all(0 <= s <= 1 for s in by.values()) and by[1] == by[2]
