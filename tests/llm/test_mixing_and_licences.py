import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import licence_texts, licences, mixing


def test_schedule_keeps_windows_and_deviation():
    slots = mixing.shares({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05})
    period, done = sum(slots.values()), Counter()
    for s, i, t, release, deadline in mixing.schedule(slots):
        assert release <= t < deadline and i == done[s]
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * w / period) < 1 for x, w in slots.items())
    assert done == slots


def test_mixture(spark):
    sizes = {"a": 700, "b": 100, "c": 30, None: 9}
    data = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(data, "doc_id long, source string")
    got = mixing.mixture(docs).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(got)))
    assert {r["doc_id"] for r in got} == {i for i, _ in data}
    slots = mixing.shares(mixing.tempered(mixing.sizes(docs)))
    period, done = sum(slots.values()), Counter()
    for n, r in enumerate(got, 1):
        done[r["source"] or mixing._NONE] += 1
        if n % mixing.BLOCK == 0:
            assert all(abs(done[s] - n * w / period) < mixing.BLOCK for s, w in slots.items())
    assert sum(r["epoch"] > 0 for r in got if r["source"] == "a") < 0.1 * sizes["a"]


def test_mixture_keeps_the_exact_weights(spark):
    data = [(i, "tiny" if i == 0 else "a" if i % 3 else "b") for i in range(24_000)]
    weights = {"a": 0.63317, "b": 0.36673, "tiny": 0.0001}
    got = mixing.mixture(spark.createDataFrame(data, "doc_id long, source string").repartition(4), weights, block=2)
    total, done = sum(weights.values()), Counter()
    rows = got.select("source", "position", "slot", "release", "deadline").orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows))) and len(rows) >= 24_000
    for n, r in enumerate(rows, 1):
        done[r["source"]] += 1
        assert r["release"] <= r["slot"] < r["deadline"]
        assert all(abs(done[s] - n * w / total) < 2 for s, w in weights.items())
    with pytest.raises(ValueError):
        mixing.mixture(got, block=3)


def test_ends_of_periods_keep_the_exact_weights():
    rng = random.Random(3)
    for _ in range(60):
        whole = [rng.choice([1, 1, 2, 3, 7, 50, 1000, 12345]) for _ in range(rng.randint(1, 9))]
        period, total = rng.choice([1, 2, 5, 16, 64, 257]), sum(whole)
        needed = [max(1, 2000 * w // total) for w in whole]
        edges, done, at = list(mixing.ends(whole, needed, period)), [0] * len(whole), 0
        for low, high in zip(edges, edges[1:], strict=False):
            assert done == low
            for s, i, t, release, deadline in mixing.fill([b - a for a, b in zip(low, high, strict=True)]):
                assert release <= t < deadline and done[s] == low[s] + i
                done[s] += 1
                at += 1
                assert all(abs(d * total - w * at) < 2 * total for d, w in zip(done, whole, strict=True))
            assert all(abs(d * total - w * at) < total for d, w in zip(done, whole, strict=True))
        assert all(d >= n for d, n in zip(done, needed, strict=True)) and mixing.finish(edges, needed, period)[0] < at


def test_a_tiny_source_keeps_its_weight():
    """1,000,000 documents against one: the one comes as often as its weight says, not more."""
    counts = {"large": 1_000_000, "tiny": 1}
    share = mixing.shares(mixing.tempered(counts))
    whole, needed = list(share.values()), [250_000, 1]
    period = mixing.period_of(whole)
    edges = list(mixing.ends(whole, needed, period))
    last, most = mixing.finish(edges, needed, period)
    assert most[1] <= 2 and 250_000 <= last < 2 * 250_000
    assert abs(edges[-1][1] - (len(edges) - 1) * period * whole[1] / sum(whole)) < 1


def test_few_kept_ends_give_the_same_mixture(spark, docs, monkeypatch):
    """Many short periods, of which the driver keeps a few ends: tasks step on from these."""
    few = docs.select("doc_id", "source").where("doc_id < 400")
    monkeypatch.setattr(mixing, "PERIOD", 16)
    shown = lambda: sorted(map(str, mixing.mixture(few, {f"src{i}": i + 1.0 for i in range(20)}).collect()))
    want = shown()
    monkeypatch.setattr(mixing, "KEPT", 60)
    assert shown() == want and len(want) >= 400
    whole, needed = [5, 3, 1], [900, 500, 200]
    edges = list(mixing.ends(whole, needed, 9))
    kept, every, n, last, most = mixing.kept_ends(whole, needed, 9, 30)
    assert len(kept) * 3 <= 30 and every > 1 and kept == edges[::every] and n == len(edges) - 1 and (last, most) == mixing.finish(edges, needed, 9)


def test_the_whole_table(spark, sf_dir, docs):
    from quillspark.llm import entries

    rows = entries.queries()["op4_mixing"](spark, sf_dir).select("doc_id", "source", "position", "epoch").orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    assert {r["doc_id"] for r in rows if not r["epoch"]} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    share = mixing.shares(mixing.tempered(mixing.sizes(docs)))
    total, done = sum(share.values()), Counter()
    for n, r in enumerate(rows, 1):
        done[r["source"] or mixing._NONE] += 1
        assert all(abs(done[s] - n * w / total) < mixing.BLOCK for s, w in share.items())


def test_mixing_odd_rows(odd, none):
    assert mixing.mixture(odd.withColumn("slot", F.lit("x"))).count() >= odd.count()
    got = mixing.mixed(odd)
    assert got.columns == odd.columns and Counter(r["doc_id"] for r in got.collect()).keys() == Counter(r["doc_id"] for r in odd.collect()).keys()
    assert mixing.mixture(none).collect() == [] and mixing.mixed(none).collect() == []


def commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


FILES = {
    "a/LICENSE": "MIT License\n\nCopyright (c) 2021 Jane Doe\n\n" + licence_texts.TEXTS["MIT"][-1],
    "a/x.py": commented("Copyright 2020 ACME.\n\n" + licence_texts.TEXTS["Apache-2.0"][1].replace(". ", ".\n"), "#") + "\nimport os\nprint(os.name)\n" + "x = 1\n" * 50,
    "a/b/y.py": "plain words only",
    "a/b/c/COPYING": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright of the text below.\n\n" + "Each licensee may do as the sections below say, and no more. " * 40,
    "a/b/c/d/z.py": None,
    "a/b/c/e.c": "/*\n * SPDX-License-Identifier: BSD-2-Clause\n */\nint main() { return 0; }",
    "a/b/c/f.c": commented(licence_texts.TEXTS["LGPL-2.1"][-1], "//") + "\nint f();",
    "q/r.py": "a licence of a driver is no notice at all for this text",
    "q/bsd/LICENSE.txt": "Copyright (c) 1999, X\nAll rights reserved.\n\n" + licence_texts.TEXTS["BSD-3-Clause"][-1],
    "q/bsd/a": "",
    "q/two/LICENSE": licence_texts.TEXTS["BSD-2-Clause"][-1],
    "q/other.c": "// SPDX-License-Identifier: Foo-1.0",
    "w/notes": "Released under the MIT License.\nThis text goes on for quite a while with many other words that have nothing to do with it, so the file is no licence file.",
    "w/g.py": "# Licensed under the GNU General Public License, version 2.",
}
WANT = {
    "a/LICENSE": "MIT", "a/x.py": "Apache-2.0", "a/b/y.py": "MIT", "a/b/c/COPYING": "GPL-3.0", "a/b/c/d/z.py": "GPL-3.0", "a/b/c/e.c": "BSD-2-Clause", "a/b/c/f.c": "LGPL-2.1", "q/r.py": None,
    "q/bsd/LICENSE.txt": "BSD-3-Clause", "q/bsd/a": "BSD-3-Clause", "q/two/LICENSE": "BSD-2-Clause", "q/other.c": None, "w/notes": "MIT", "w/g.py": "GPL-2.0",
}


def test_licences(spark):
    files = [*FILES.items(), (None, "Licensed under CC BY-NC 4.0.")]
    got = {r["path"]: r for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: r["licence"] for p, r in got.items() if p} == WANT and got[None]["licence"] is None
    assert got["a/b/y.py"]["inherited_from"] == "a" and got["a/x.py"]["inherited_licence"] == "MIT" and got["a/b/c/d/z.py"]["inherited_from"] == "a/b/c"


def brute_licences(files):
    """Best licence and cosine of each file, by comparing every unit with every text."""
    def words(t):
        return re.findall(licences.TERM, t.lower())

    texts = [t for t in files.values() if t is not None]
    known = {w for ts in licences.TEMPLATES.values() for t in ts for w in words(t)}
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in set(words(t)) for t in texts))) + 1 for w in known}
    rows = licences.vectors(idf, licences.TEMPLATES)
    terms = {t for _, _, v in rows for t in v}
    out = {}
    for path, text in files.items():
        clean = re.sub(licences.COMMENT, "", text or "")
        lines = (text or "").split("\n")
        code = next((i for i, x in enumerate(lines) if re.search(licences.CODE, x)), 0)
        units = [*clean.split("\n"), *re.split(r"\n[ \t]*\n", clean), clean, re.sub(licences.COMMENT, "", "\n".join(lines[:code]))]
        best = None
        for u in units:
            bag = {t: n * (licences.weight(t, idf) if t in terms else 0.0 if " " in t else 1.0) for t, n in licences.bag(u).items()}
            norm = math.sqrt(sum(w * w for w in bag.values()))
            for name, _, v in rows:
                if norm and (score := round(sum(w * v.get(t, 0.0) for t, w in bag.items()) / norm, 6)) >= licences.LEAST:
                    best = min(best or (0.0, 0, ""), (-score, -len(v), name))
        if best:
            out[path] = (best[2], -best[0])
    return out


def test_licences_against_brute_force(spark, texts):
    some = {f"d/{k}": t for k, t in texts.items() if k % 2 or "icense" in t}
    files = {**FILES, **some}
    want = brute_licences(files)
    got = licences.own_licences(spark.createDataFrame(list(files.items()), "path string, text string")).collect()
    assert {r["path"]: r["licence"] for r in got} == {p: name for p, (name, _) in want.items()}
    assert all(abs(r["score"] - want[r["path"]][1]) < 2e-6 for r in got) and len(got) > 20


def test_licences_odd_rows(odd, none):
    as_files = lambda d: d.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    assert licences.scan(as_files(odd)).count() == odd.count()
    assert licences.scan(as_files(none)).collect() == []


def test_whole_table(spark, sf_dir, texts):
    from quillspark.llm import entries

    got = {r["doc_id"]: r["own_licence"] for r in entries.queries()["op9_licences"](spark, sf_dir).collect()}
    for name, lines in licences.TEMPLATES.items():
        assert all(got[k] == name for k, t in texts.items() if lines[0] in t.split("\n"))
    assert all(v is None for k, v in got.items() if not re.search("(?i)licen|creative|cc0|redistribution", texts[k]))
