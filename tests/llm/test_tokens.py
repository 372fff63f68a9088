import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import packing, token_store, tokens
from quillspark.llm.tokens import BYTE_BPE, Encoder, encoder

ODD = ["a  b\n\n c", "don't we'll x_y_z.", "tab\there nbsp", "12abc 3.14 <|endoftext|>x", "日本語 テスト　全角", "ñ é", "\x1c\x1d \x85", " lead", "trail ", "", "🙂🙂 🙂.", "a.b,c;d:e!f?", "Ⅷ ² x² ٣", "\r\n x \t y", "é ß'S ''tis''"]


@pytest.fixture(scope="module")
def whole():
    enc = encoder(BYTE_BPE)
    return lambda texts: [np.array(e.ids, "<u4") for e in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_segments_give_the_ids_of_the_whole(whole, texts):
    rng = random.Random(1)
    parts = ["a", "Bc", "é", " ", "  ", "\n", "\n\n", " \n", "\t", ".", ",", "!", "'s", "'", "23", "\u00a0", "\u2003", "\u3000", "日本", "🙂", "<|endoftext|>", "<", "-", "\x85", "\x1c", "\r\n", "٣", "²", "x.y", "…"]
    mixed = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(5000)]
    some = [*list(texts.values())[:300], *ODD, *mixed, None, "word " * 50_000]
    enc = encoder(BYTE_BPE)
    ids, at = enc.encode(pa.array(some))
    for a, b, want in zip(at, at[1:], whole(some), strict=False):
        assert np.array_equal(ids[a:b], want)
    enc._forget()
    again, _ = enc.encode(pa.array(["left out", *some]).slice(1))
    assert np.array_equal(ids, again)
    assert enc.encode(pa.array([], pa.string()))[1].tolist() == [0] and enc.encode(pa.array([None, ""]))[1].tolist() == [0, 0, 0]


def test_joined_words_and_cuts_at_marks(whole):
    rng = random.Random(3)
    parts = ["a", "Bc", "é", "ß", "×", "÷", "ª", "ÿ", "Ā", "ж", " ", " ", "\n", "\n ", "###", "%", "_", "-", "(", "/", "'s", "'T", "7", "<", "|", ">", "<|endoftext|>", "\0", "…", "\u00a0"]
    some = [*("".join(rng.choices(parts, k=rng.randint(0, 10))) for _ in range(10_000)), "\n".join(["Oné***", "x", "é."] * 300), " zq" * 300]
    enc = Encoder(BYTE_BPE)
    assert enc.joined > 1
    for joined in (enc.joined, 1):
        enc._forget()
        enc.joined = joined
        ids, at = enc.encode(pa.array(some))
        assert all(np.array_equal(ids[a:b], want) for a, b, want in zip(at, at[1:], whole(some), strict=False))
    assert tokens._joins(b"e t") and tokens._joins(b"\na") and not any(map(tokens._joins, (b" the", b"\n\n", b" \xc2\xa0 \xc2\xa0", b"\n", b"e.g. a")))


def test_words_that_come_again_are_encoded_once(monkeypatch):
    """Where the memory overflows, what the texts at hand still use stays."""
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    common = " ".join(f"common{name(i)}" for i in range(60))
    batches = [pa.array([f"x {common} " + " ".join(f"rare{name(100 * k + i)}" for i in range(20))]) for k in range(10)]
    enc, asked = Encoder(BYTE_BPE), []
    monkeypatch.setattr(tokens, "KEPT", 200)

    class Counted:
        def __init__(self, model):
            self.model = model

        def encode_batch_fast(self, strings, **more):
            asked.extend(strings)
            return self.model.encode_batch_fast(strings, **more)

    enc.model = Counted(enc.model)
    for b in batches:
        enc.encode(b)
    assert len(enc.known) <= 200
    assert sum(s.count("common") for s in asked) == 60 and sum(s.count("rare") for s in asked) == 200


def test_re_pair_round_trip():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 6, 5000), np.full(4000, 3), np.zeros(50, int), np.array([1]), np.array([], int)):
        seq, rules = token_store.re_pair(ids, 10, 0)
        assert np.array_equal(token_store.expand(seq.astype(np.int64), rules.astype(np.int64), 10), ids)


def plain_re_pair(ids, first, least):
    """One pair at a time, by counting all pairs anew."""
    seq, rules = ids.tolist(), []
    while True:
        counts, last = Counter(), {}
        for i, p in enumerate(zip(seq, seq[1:], strict=False)):
            if 0 not in p and last.get(p) != i - 1:
                counts[p] += 1
                last[p] = i
        if not counts or max(counts.values()) < least:
            return seq, rules
        pair = counts.most_common(1)[0][0]
        out, i = [], 0
        while i < len(seq):
            both = tuple(seq[i : i + 2]) == pair
            out.append(first + len(rules) if both else seq[i])
            i += 2 if both else 1
        rules.append(pair)
        seq = out


def test_re_pair_against_a_plain_version():
    rng = np.random.default_rng(7)
    words = [rng.integers(1, 300, rng.integers(1, 6)) for _ in range(400)]
    ids = np.concatenate([words[min(399, int(x))] for x in rng.exponential(40, 6000)])
    ids[::500] = 0
    want, want_rules = plain_re_pair(ids, 1000, 16)
    got, rules = token_store.re_pair(ids, 1000, 0)
    assert len(got) + 2 * len(rules) < 1.03 * (len(want) + 2 * len(want_rules))
    pairs = Counter(p for i, p in enumerate(zip(got.tolist(), got.tolist()[1:], strict=False)) if 0 not in p and p[0] != p[1])
    assert max(pairs.values()) < 16
    assert len(set(map(tuple, rules.tolist()))) == len(rules)


@pytest.mark.parametrize("seed", [2, 8, 37])
def test_re_pair_leaves_no_frequent_pair_where_a_symbol_is_made_again(seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(1, [2, 3, 6, 20, 60, 300][seed % 6], rng.integers(1, 6)) for _ in range(100)]
    ids = np.concatenate([words[min(99, int(x))] for x in rng.exponential(20, 3000)])
    ids[::97] = 0
    seq, rules = token_store.re_pair(ids, 1000, 0)
    assert np.array_equal(token_store.expand(seq.astype(np.int64), rules.astype(np.int64), 1000), ids)
    assert max(Counter(p for p in zip(seq.tolist(), seq.tolist()[1:], strict=False) if 0 not in p and p[0] != p[1]).values()) < 16


def test_shard_is_read_by_rules_or_by_steps():
    for docs in ([np.tile(np.arange(1, 8), 90).astype("<u2")] * 9, [np.full(5000, 3, "<u2"), np.zeros(0, "<u2")], [np.zeros(0, "<u2")]):
        shard = token_store.Shard(token_store.write_shard(list(range(len(docs))), docs, 50))
        assert shard.size.sum() <= shard.n_ids
        want = np.concatenate([np.append(d, 0) for d in docs])
        assert np.array_equal(shard.ids(), want)
        shard.n_ids = -1  # as if its rules stood for more
        assert np.array_equal(shard.ids(), want)


def test_shard_random_access():
    rng = np.random.default_rng(2)
    docs = [np.tile(rng.integers(1, 40, 7), rng.integers(0, 60)).astype("<u2") for _ in range(40)]
    payload = token_store.write_shard([None, *range(39)], docs, 50)
    shard = token_store.Shard(payload)
    assert shard.keys == [None, *range(39)]
    assert len(payload) < 2 * sum(map(len, docs))
    for i, d in enumerate(docs):
        full = np.append(d, 0)
        assert np.array_equal(shard.read(i), full)
        for start in range(0, len(full), 11):
            assert np.array_equal(shard.read(i, start, 5), full[start : start + 5])


def test_store_against_brute_force(spark, docs, texts, whole, tmp_path):
    path = str(tmp_path / "shards")
    token_store.write(docs, path, shard_ids=20_000)
    got = {r["doc_id"]: r for r in token_store.digests(spark, path).collect()}
    at = 0
    for k, ids in zip(sorted(texts), whole([texts[k] for k in sorted(texts)]), strict=True):
        ids = np.append(ids, 0).astype("<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(texts)


def test_store_odd_rows(spark, odd, none, tmp_path):
    token_store.write(odd, str(tmp_path / "odd"))
    got = token_store.digests(spark, str(tmp_path / "odd")).collect()
    assert len(got) == odd.count() and min(got, key=lambda r: r["start"])["doc_id"] is None
    assert [r["n_tokens"] for r in got if r["doc_id"] == 4] == [1]
    token_store.write(none, str(tmp_path / "none"))
    assert token_store.digests(spark, str(tmp_path / "none")).collect() == []


def check_packing(rows, ids, size=1024):
    covered, ends = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["start"])):
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
        if ids is not None:
            piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert max(ends.values()) <= size
    return covered, sum(ends.values()) / size / len(ends)


def test_packing_against_brute_force(docs, texts, whole):
    ids = {k: np.append(x, 0).astype("<u4") for k, x in zip(texts, whole(list(texts.values())), strict=True)}
    rows = packing.pack(packing.digest(packing.pieces(docs))).collect()
    covered, full = check_packing(rows, ids)
    assert covered == {k: len(x) for k, x in ids.items()} and full > 0.97


def test_packing_odd_rows(odd, none):
    rows = packing.pack(packing.digest(packing.pieces(odd))).collect()
    covered, _ = check_packing(rows, None)
    assert covered[4] == 1 and covered[7] == 2 * covered[7] // 2 and len([r for r in rows if r["doc_id"] == 7]) == 2
    assert packing.pack(packing.digest(packing.pieces(none))).collect() == []


def test_plan_places_every_length():
    rng = np.random.default_rng(3)
    histogram = {int(x): int(c) for x, c in zip(range(1, 1025), rng.integers(0, 50, 1024), strict=True) if c}
    patterns = packing.plan(histogram)
    placed = {}
    for count, lengths in patterns:
        assert sum(lengths) <= 1024
        for x in lengths:
            placed[x] = placed.get(x, 0) + count
    assert placed == histogram and len(patterns) <= 2 * 1024
