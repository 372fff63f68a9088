import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import fingerprints as P
from quillspark.llm.shingles import shingles


def true_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té ", max_size=40), min_size=1, max_size=5))
def test_shingles_are_those_of_each_text(texts):
    for text, got in zip(texts, shingles(texts, 2), strict=True):
        assert len(set(got.tolist())) == len(true_set(text, 2))
        assert np.array_equal(got, shingles([text], 2)[0])


def test_sketches_merge_and_estimate():
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    x, y, both = P.sketch([a, b, " ".join(words)])
    assert np.array_equal(P.merge(x, y), both)
    assert abs(P.resemblance(x, y) - 1 / 3) < 0.12 and abs(P.containment(x, y) - 0.5) < 0.15 and abs(P.distinct(both) - 2996) < 900
    assert np.array_equal(P.from_text(P.to_text(x)), x)


def test_against_brute_force(docs, texts):
    got = {r["doc_id"]: r for r in P.against_next(docs).collect()}
    order = sorted(texts, reverse=True)
    off = []
    for i, k in enumerate(order):
        own, after = texts[k], texts[order[(i + 1) % len(order)]]
        n = len(own)
        edited = own[: n - n // 2] + after[: n // 2]
        assert got[k]["n_chars"] == n and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = true_set(own), true_set(edited)
        off.append(got[k]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert len(got) == len(texts) and np.std(off) < 0.05 and np.abs(off).max() < 0.2


def test_odd_rows(odd, none):
    got = P.against_next(odd).collect()
    assert len(got) == odd.count() and len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert [r["fingerprint"] for r in got if r["doc_id"] == 4] == [""]
    assert P.against_next(none).collect() == []


def test_one_row_is_its_own_next(spark):
    r = P.against_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()[0]
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1.0


def test_merged_by_key(odd):
    from pyspark.sql import functions as F

    got = P.merged(P.fingerprint(odd).withColumn("k", F.lit("all")), "k").collect()[0]["fingerprint"]
    want = np.unique(np.concatenate(P.sketch([r["text"] for r in odd.collect()])))[: P.K]
    assert np.array_equal(P.from_text(got), want)
