import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxsite.llm import queries, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_sharding(spark, sf).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    assert len(rows) == len(texts) and {r.law for r in rows} == {"key"}
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    moved = sum(r.grown_shard == 16 for r in rows)
    assert 0.5 < moved / (len(rows) / 17) < 1.6


def placed(spark, tree, n=20_000):
    return {r.k: r.shard for r in sharding.place(spark.range(n).withColumnRenamed("id", "k"), "k", tree, "shard").collect()}


def test_weights_decide_shares_and_confine_movement(spark):
    tree = [[[1.0, 2.0], [1.0]], [[3.0, 0.0], [1.0]]]
    before = placed(spark, tree)
    count = Counter(before.values())
    assert set(count) == {0, 1, 2, 3, 5}  # weight 0 gets nothing
    for shard, weight in {0: 1, 1: 2, 2: 1, 3: 3, 5: 1}.items():
        assert abs(count[shard] / 20_000 - weight / 8) < 0.02
    # one weight of region 0 grows: rows move into region 0 only, none between the shards of region 1
    after = placed(spark, [[[1.0, 3.0], [1.0]], tree[1]])
    assert all(after[k] <= 2 for k in before if before[k] != after[k])
    # within region 0, rows that were there move only into the rack that grew
    assert all(after[k] in (before[k], 0, 1) for k in before if before[k] <= 2)
    # a region of its own takes rows and moves no others
    grown = placed(spark, sharding.with_new_region(tree, 2.0))
    assert all(grown[k] in (before[k], 6) for k in before) and 6 in grown.values()


def test_nulls_repeats_hot_keys_and_empty_table(spark):
    rows = [(None, None, None, None, None)] * 3 + [(7, "é", "en", "a", 1)] * 500 + [(8, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(-1))
    out = sharding.shard_documents(docs).collect()
    assert len(out) == len(rows)
    assert len({r.shard for r in out if r.doc_id == 7}) == 1 and len({r.shard for r in out if r.doc_id is None}) == 1
    assert {(r.size, r.text_crc32) for r in out if r.doc_id is None} == {(1, 0)}
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_the_law_holds_at_every_count(spark):
    """From n to n + 1 shards rows go only into the new one, and it gets its share."""
    for base, most in ((1, 40), (16, 40)):
        before = placed(spark, sharding.tree_of(base, base), 2000)
        for n in range(base, most + 1):
            after = placed(spark, sharding.tree_of(n + 1, base), 2000)
            assert all(after[k] in (before[k], n) for k in before), (base, n)
            assert 0.3 < sum(s == n for s in after.values()) / (2000 / (n + 1)) < 1.8, (base, n)
            before = after


def test_one_call_grows_by_its_own_law(spark):
    docs = spark.createDataFrame([(k, "x", "en", "a", 1) for k in range(600)], DOCS)
    for n in (1, 10, 17, 20):
        out = sharding.shard_documents(docs, n).collect()
        assert {r.shard for r in out} <= set(range(n)) and all(r.grown_shard in (r.shard, n) for r in out)
    grown = {r.doc_id: r.grown_shard for r in sharding.shard_documents(docs, 10).collect()}
    assert grown == {r.doc_id: r.shard for r in sharding.shard_documents(docs, 11, base=10).collect()}
    with pytest.raises(ValueError, match="began with 16"):
        sharding.tree_of(8, 16)
