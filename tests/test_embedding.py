"""The deterministic backend against its rule written out."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import embedding


def by_rule(text, dim):
    def drawn(seed):
        seed = hashlib.sha256(seed.encode()).digest()
        return [int.from_bytes(hashlib.sha256(seed + i.to_bytes(4, "big")).digest()[:4], "big") / 0xFFFFFFFF * 2 - 1 for i in range(dim)]

    clean = re.sub(r"\s+", " ", text).strip()
    v = drawn(clean)
    for w in [w for w in re.findall(r"\w+", clean.lower()) if len(w) > 1] or [clean.lower() or "_empty_"]:
        v = [a + 2 * b for a, b in zip(v, drawn(w), strict=True)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


@pytest.mark.parametrize("text", ["pay the rent.", "", "  ", "?", "a", "Rent, rent\n\tdue", "Été § 1950.5"])
def test_vectors_follow_the_rule(text):
    got = embedding.deterministic([text], 48)[0]
    assert np.abs(got - by_rule(text, 48)).max() < 2e-6 and abs(np.linalg.norm(got) - 1) < 1e-4


def test_a_shared_word_is_seen_through_punctuation_and_white_space_is_not():
    a, b, c, d = embedding.deterministic(["pay the rent.", "Rent, due", "other words", "pay  the\nrent."], 256)
    assert a @ b > 0.2 > 0.15 > abs(a @ c) and (a == d).all()


def test_column(spark):
    got = spark.createDataFrame([("pay the rent.",), (None,)], "t string").select(embedding.embed(F.col("t"), dim=8).alias("v")).collect()
    assert np.allclose(got[0]["v"], by_rule("pay the rent.", 8), atol=1e-5) and np.allclose(got[1]["v"], by_rule("", 8), atol=1e-5)


def test_words_of_a_large_vocabulary_are_drawn_once(monkeypatch):
    """More words than were kept before, twice in the same order: the second time none is drawn again."""
    seen, sha256 = [], hashlib.sha256
    monkeypatch.setattr(embedding.hashlib, "sha256", lambda x: seen.append(x) or sha256(x))
    for _ in range(2):
        embedding.deterministic([" ".join(f"word{i}" for i in range(low, low + 100)) for low in range(0, 20_000, 100)], 2)
    assert len(seen) == len([x for x in seen if b" " in x]) + 20_000 and seen.count(b"word7") == 1


@pytest.mark.parametrize("most", [2, 7, 40])
def test_a_full_memory_changes_no_vector(monkeypatch, most):
    texts = [" ".join(f"w{(i * k) % 31}" for k in range(1, 60)) for i in range(40)] + ["w1", "", "w2 w2 w3"]
    monkeypatch.setattr(embedding, "TEXTS", 3)
    monkeypatch.setattr(embedding, "_memory", lambda dim, kept=embedding._Memory(16): kept)
    whole = embedding.deterministic(texts, 16)
    monkeypatch.setattr(embedding, "KEPT", most * 4 * 16)
    monkeypatch.setattr(embedding, "_memory", lambda dim, kept=embedding._Memory(16): kept)
    assert all((a == b).all() for a, b in zip(embedding.deterministic(texts, 16), whole, strict=True))
    assert embedding._memory(16).most == most and len(embedding._memory(16).at) <= most
