import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import neardup, setsketch
from quillspark.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def true_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()


def brute(texts):
    """Least id of each component, by comparing all pairs that share a rare shingle."""
    sets = {k: true_set(t) for k, t in texts.items()}
    seen = Counter(s for x in sets.values() for s in x)
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holds = {}
    for k in sorted(texts):
        mine = sorted(sets[k], key=lambda s: (seen[s], s))
        near = set()
        for s in mine[: len(mine) - -(-4 * len(mine) // 5) + 1]:
            near.update(holds.setdefault(s, []))
            holds[s].append(k)
        for o in near:
            both = len(sets[k] & sets[o])
            if 100 * both >= 80 * (len(sets[k]) + len(sets[o]) - both):
                a, b = find(k), find(o)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in texts}, {k: len(s) for k, s in sets.items()}


def test_against_brute_force(docs, texts):
    want, sizes = brute(texts)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k: r["n_shingles"] for k, r in got.items()} == sizes
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_a_crowd_of_edits(spark):
    """Many edits of one text: every link counts, though no two members need be near each other."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for k in range(150):
        w = list(base)
        for i in rng.integers(0, 120, 4):
            w[i] = f"x{k}_{i}"
        texts[k] = " ".join(w)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want, _ = brute(texts)
    assert got == want


def test_a_templated_crowd(spark):
    """Members share 0.7 to 0.8 with each other, and only some pairs reach 0.8."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(240)]
    texts = {}
    for k in range(0, 400, 2):
        at = rng.choice(120, 15, replace=False)
        for who, own in ((k, at[3:9]), (k + 1, at[9:])):  # three words that only the pair has, and six of its own
            w = list(base)
            for i in at[:3]:
                w[2 * i] = f"x{k}"
            for i in own:
                w[2 * i] = f"y{who}"
            texts[who] = " ".join(w)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want, _ = brute(texts)
    assert len(set(want.values())) > 150
    assert got == want


def test_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count() and by[2]["component_id"] == by[3]["component_id"] == 1 and not by[3]["kept"]
    assert by[4]["component_id"] == 4 and by[4]["kept"] and by[6]["n_shingles"] == 0 and by[7]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert neardup.near_duplicates(none).collect() == []
    kept = neardup.representatives(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9]
    assert neardup.representatives(none).collect() == []


def test_rows_without_a_doc_id_or_with_the_same_one(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "A b c d e f"), (None, "a b c d e f"), (None, "x y z"), (None, "X Y Z"), (None, ""), (None, None), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in neardup.representatives(docs).collect()]
    assert sorted((k or 0) for k, _ in kept) == [0, 0, 0, 1, 3]
    assert sum((t or "").lower() == "x y z" for _, t in kept) == 1 and (2, "A b c d e f") not in kept


def test_random_edits_of_one_text(spark):
    """Three crowds of 1,200 texts of 120 words, 5 or 6 of them edited: most pairs are just below or above 0.8."""
    texts = {10_000 * seed + k: t for seed in (1, 2, 3) for k, t in crowd(seed).items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    want, _ = brute(texts)
    assert len(set(want.values())) > 60
    assert got == want


def crowd(seed):
    rng = np.random.default_rng(seed)
    base, texts = [f"{seed}w{i}" for i in range(120)], {}
    for k in range(1200):
        w = list(base)
        for i in rng.choice(120, rng.integers(10, 13) // 2, replace=False):
            w[i] = f"x{rng.integers(0, 10**6)}"
        texts[k] = " ".join(w)
    for k in range(1200, 1260):  # and a few that are further away
        w = texts[k - 1200].split()
        for i in rng.choice(120, 7, replace=False):
            w[i] = f"y{rng.integers(0, 10**6)}"
        texts[k] = " ".join(w)
    return texts


def test_blocks_and_rounds(spark, monkeypatch):
    """The same with small blocks, hot keys from the start, and leader rounds."""
    from quillspark.llm import common

    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for k in range(300):
        w = list(base)
        for i in rng.choice(120, 6, replace=False):
            w[i] = f"x{k}_{i}"
        texts[k] = " ".join(w)
    want, _ = brute(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block, work in ((16, 0),):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "WORK", work)
        monkeypatch.setattr(neardup, "SMALL", 3)
        monkeypatch.setattr(common, "HOT_ROWS", 50)
        assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == want


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = x[:2000], x[1000:]
    r = setsketch.registers([a, b, x, a[:0]])
    assert np.array_equal(np.maximum(r[0], r[1]), r[2]) and not r[3].any()
    j = setsketch.estimate((r[:1] > r[1:2]).sum(1), (r[:1] < r[1:2]).sum(1), np.array([2000]), np.array([2000]))[0]
    assert abs(j - 1 / 3) < 0.1


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (103, 101)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 103: 100}
