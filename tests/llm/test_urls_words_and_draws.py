"""Operators 11 to 13 against brute force and on odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from quillspark.llm import bytewords, entries, importance, spelling, url_filter
from tests.conftest import rows

UP = str.maketrans(url_filter.UPPER, url_filter.LOWER)
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


# Urls.


def test_urls_same_as_sql(spark, duck, sf_dir):
    got, want = entries.op11_url_filter(spark, sf_dir), duck.sql(entries.URL_FILTER)
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_urls_odd(spark):
    data = [
        (1, None, "", "", None, "allow"),
        (2, "http://A.ORG", "a.org", "", None, "allow"),
        (3, "no host, but casino", "", "", None, "block"),
        (4, "HTTP://ex%61mple.net/%63asino/#a", "ex%61mple.net", "/%63asino/", None, "block"),
        (5, "http://Bücher.DE?x=//windows", "bücher.de", "", None, "allow"),
        (6, "http://a.b://c.com/de/", "a.b:", "//c.com/de/", None, "allow"),
        (7, "http://win24.net/free?bets", "win24.net", "/free", None, "block"),
        (8, "http://a\nb.net/x\ny/#z", "a\nb.net", "/x\ny/", None, "allow"),
        (9, "http://casino.org/", "casino.org", "/", "org/", "allow"),
        (10, "http://m.example.org/es/1", "m.example.org", "/es/1", "example.org/es/", "block"),
        (11, "http://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"),
        (12, "http://xwin.net/awin/winwin", "xwin.net", "/awin/winwin", None, "allow"),
        (13, "http://x.net/win/win-win", "x.net", "/win/win-win", None, "allow"),  # one soft term, three times
        (13, "http://x.net/win/win-win", "x.net", "/win/win-win", None, "allow"),
        (None, "", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(*d[:2], "mine", 7) for d in data], "page_id long, url string, host string, n_soft int")
    got = url_filter.judge(pages).collect()
    key = lambda r: (r[0] or 0, str(r))
    assert sorted([(r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got], key=key) == sorted(data, key=key)
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules=(), vocabulary={}).collect()} == {"allow"}


def test_terms_by_brute_force():
    words = ["ab", "abc", "bc", "x-1", "1"]
    weights = frozenset((w, 50) for w in words)
    for text in ["ab", "abc", "xab", "ab1", "1ab", "AB/abc-bc", "äab", "x-1", "x-12", "1-1", "", "ab" * 9]:
        low = text.lower()
        joined = lambda a, b: (a.isalpha() and b.isalpha()) or (a.isdigit() and b.isdigit())
        want = [(w, 50) for w in words for i in range(len(low)) if low.startswith(w, i) and not (i and joined(low[i - 1], low[i])) and not (i + len(w) < len(low) and joined(low[i + len(w) - 1], low[i + len(w)]))]
        assert sorted(url_filter.hits(text, weights)) == sorted(want), text


# Words and n-grams from bytes.


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_bytewords(most):
    texts = ["Ab cd-1 É日本 x", None, "", "  ", "a" * 200 + " B" + "c" * 70 + "é", "Zz", "\x00é\x7fà🙂b ÀÿZ×"]
    column = pa.concat_arrays([pa.array(["gone"]), pa.array(texts)]).slice(1)
    got = [(Counter(), 0) for _ in texts]
    for at, part in bytewords.slices(column, most):
        found, row, n = bytewords.gram_buckets(part, 3, 997)
        for b, r in zip(found.tolist(), row.tolist(), strict=True):
            got[at + r][0][b] += 1
        got[at : at + len(part)] = [(got[at + i][0], int(k)) for i, k in enumerate(n)]
        data, start, size, of = bytewords.words(part, bytewords.in_run)
        runs = [(int(r), bytes(data[s : s + k]).decode()) for s, k, r in zip(start, size, of, strict=True)]
        assert runs == [(i, w) for i, t in enumerate(part.to_pylist()) for w in re.findall("[A-Za-z\u00c0-\u00ff]+", (t or "").translate(UP))]
    for text, (seen, n) in zip(texts, got, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
        grams = [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
        assert (seen, n) == (Counter(zlib.crc32(g.encode()) % 997 for g in grams), len(w))


# Spelling variants.


def brute_variants(data):
    total = Counter()
    for doc_id, text in data:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", (text or "").translate(UP)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            total[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    known = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    form, near = {}, {}
    for w, n in known.items():
        cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in LETTERS} | {a + c + b for a, b in cut for c in LETTERS}
        found = (edits & known.keys()) - {w}
        best = min(found, key=lambda x: (-known[x], x), default=None)
        near[w], form[w] = len(found), best if best is not None and known[best] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n, near[w], form[w] or "", known.get(form[w], 0), root(w)) for w, n in known.items())


def shown(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"] or "", r["form_n"] or 0, r["root"]) for r in df.collect())


def test_variants_by_brute_force(spark, sf_dir, docs):
    want = brute_variants([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert len(want) > 10_000 and sum(1 for w in want if w[3]) > 3_000
    assert shown(entries.op12_spelling(spark, sf_dir)) == want


def test_variants_in_many_tries_and_rounds(spark, monkeypatch):
    """Small tries, rounds and blocks; runs of equal letters, prefixes, the first and the last letter, ties, a chain of forms, a very long word."""
    counts = {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 13, "baaaa": 3, "aaaab": 3, "abaaa": 6, "ábaaa": 6, "ÿaaaaa": 3, "zebra": 40, "zebrae": 80, "zebraes": 160, "ebraes": 400, "q" * 400: 3, "q" * 399 + "r": 9}
    data = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())] + [(None, "aaaaa"), (50, None), (51, ""), (52, "a" * 5), (52, "a" * 5)]
    want = brute_variants(data)
    monkeypatch.setattr(spelling, "ROUND", 600)
    monkeypatch.setattr(spelling, "BLOCK", 3)
    monkeypatch.setattr(spelling, "tries", lambda words, cut=spelling.tries: cut(words, 25))
    assert shown(spelling.variants(spark.createDataFrame(data, "doc_id long, text string"))) == want
    assert max(len(w[0]) for w in want) == 400 and any(w[5] == "ebraes" and w[0] == "zebra" for w in want)


def test_variants_odd(spark, odd, none):
    assert shown(spelling.variants(odd)) == brute_variants([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert shown(spelling.variants(none)) == []


# Importance resampling.


def brute_draw(data, target, percent=25, least=20):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    of = [(i, *grams(t)) for i, t in data]
    s, t = Counter(b for *_, g in of for b in g), Counter(b for x in target for b in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, g in of:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        out.append([i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able):
        r.append(k + 1 if k < percent * len(able) // 100 else None)
    return sorted([*(r if len(r) == 6 else [*r, None] for r in out)], key=str)


def drawn(df):
    return sorted([list(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()], key=str)


def test_draw_by_brute_force(spark, sf_dir, docs):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute_draw([tuple(r) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in target.collect()])
    got = entries.op13_importance(spark, sf_dir).collect()
    assert sorted([[r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in got], key=str) == sorted([[w[0], *w[2:]] for w in want], key=str)
    assert sum(1 for w in want if w[5]) > 200


def test_draw_odd(spark, odd, none):
    data = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert drawn(importance.resample(odd, none, 60, 1)) == brute_draw(data, [], 60, 1)
    assert drawn(importance.resample(none, odd)) == []
    assert all(r[5] is None for r in drawn(importance.resample(odd, odd, 0)))


def test_draw_without_doc_ids(spark):
    """Half of the rows have no doc_id and one score, so they tie wholly; ids far apart fill few slices."""
    data = [(None, "one two three")] * 500 + [(i * i * i * 1000, "one two") for i in range(300)] + [(7, "two two")] * 200
    got = drawn(importance.resample(spark.createDataFrame(data, "doc_id long, text string").repartition(7), spark.createDataFrame([("two",)], "text string"), 75, 1))
    want = brute_draw(data, ["two"], 75, 1)
    assert sorted(r[5] for r in got if r[5]) == list(range(1, 751))
    assert Counter(map(str, got)) == Counter(map(str, want))
