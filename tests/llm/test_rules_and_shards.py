import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import entries, quality_rules, sharding
from tests.conftest import rows


def test_rules_same_as_sql(spark, duck, sf_dir):
    got = entries.queries()["op5_quality_rules"](spark, sf_dir)
    want = duck.sql(entries.oracle_sql()["op5_quality_rules"])
    names = [d[0] for d in want.description]
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def repeat_words(words):
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)})


@pytest.mark.parametrize("text", ["a b c d e", "a b c d e a b c d e", "a a a a a a", "a b c d e f a b c d e f g a b c d", "x " * 9, "p q r s t u p q r s t", ""])
def test_repeats(spark, text):
    got = quality_rules.ledger(spark.createDataFrame([(text,)], "text string")).collect()[0]
    assert got["n_repeat_words"] == repeat_words(text.split())


def test_rules_odd_rows(odd, none):
    got = quality_rules.ledger(odd).collect()
    assert len(got) == odd.count() and all(r["fail_mask"] & 1 for r in got if r["n_words"] < 10)
    assert {r["doc_id"] for r in quality_rules.clean(odd).collect()} == {1, 2, 3}
    assert quality_rules.clean(odd).columns == odd.columns and quality_rules.ledger(none).collect() == []


def test_ablation(spark):
    masks = [0, 1, 1, 2, 3, 4]
    got = {r["rule"]: r for r in quality_rules.ablation(spark.createDataFrame([(m,) for m in masks], "fail_mask long"), "v1").collect()}
    assert (got["few_words"]["n_failed"], got["few_words"]["n_only_this"], got["few_words"]["n_kept_without"]) == (3, 2, 4)


def draw(node, key):
    h = xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=xxhash.xxh64(node.path.encode(), seed=42).intdigest()).intdigest()
    return -node.weight / np.log(((h >> 11) + 0.5) / 2.0**53)


def descend(node, key):
    while node.children:
        node = max(node.children, key=lambda c: draw(c, key)) if len(node.children) > 1 else node.children[0]
    return node.shard


def test_shards_against_brute_force(spark, sf_dir, texts):
    got = entries.queries()["op10_sharding"](spark, sf_dir).collect()
    old, new = sharding.tree(16), sharding.tree(17)
    slots = {}
    for r in got:
        k, text = r["doc_id"], texts[r["doc_id"]].encode()
        assert (r["shard"], r["grown_shard"]) == (descend(old, k), descend(new, k)) and r["grown_shard"] in (r["shard"], 16)
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_only_changed_subtrees_move(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    shards = lambda t: {r["doc_id"]: r["shard"] for r in sharding.assign(keys, t).collect()}
    before, after = shards(sharding.tree(16)), shards(sharding.tree(16, {3: 2.0}))
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    # whoever changes region comes to the heavier one, whoever changes rack within it to its heavier rack, and there to the heavier shard
    assert moved and all(b // 8 == 0 for a, b in moved if a // 8 != b // 8)
    assert all(b // 4 == 0 for a, b in moved if a // 8 == b // 8 and a // 4 != b // 4)
    assert all(b == 3 for a, b in moved if a // 4 == b // 4)
    assert abs(sum(s == 3 for s in after.values()) - 4000 * 2 / 17) < 120


def test_shards_odd_rows(odd, none):
    placed = sharding.with_slots(sharding.assign(odd, sharding.tree(16))).collect()
    assert len(placed) == odd.count()
    assert sharding.with_slots(sharding.assign(none, sharding.tree(16))).collect() == []


def test_a_grown_tree_moves_keys_only_into_the_new_shard(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    for n in (1, 5, 9, 15, 16, 23):
        old, new = sharding.tree(n), sharding.grown(sharding.tree(n), n)
        rows = sharding.assign(sharding.assign(keys, old), new, name="after").where("shard != after")
        assert {r["after"] for r in rows.collect()} == {n}


def test_helper_columns_do_not_clash(spark):
    rows = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y")], "doc_id long, text string, _m string").withColumns({"_own": F.lit(1), "_part": F.lit(2), "_start": F.lit(3), "_total": F.lit(4), "shard": F.lit(9), "slot": F.lit(9)})
    got = sharding.with_slots(sharding.assign(rows, sharding.tree(2))).collect()
    assert all((r["_own"], r["_part"], r["_start"], r["_total"]) == (1, 2, 3, 4) and r["shard"] < 2 for r in got)
    assert [r["_m"] for r in quality_rules.ledger(rows).orderBy("doc_id").collect()] == ["x", "y"]
