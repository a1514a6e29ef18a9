import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxsite.llm import queries, ranked_search

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    documents, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        found = []
        for i, c, n in bags:
            m = 100 - 50 + (50 * n * documents) // total
            score = 0
            for t in own & c.keys():
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if missing else i, -s) for rank, (s, missing, i) in enumerate(sorted(found)[:k], 1)]
    return out


def rows(df):
    return [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]


def by_item(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert by_item(rows(queries.op12_ranked_search(spark, SF))) == by_item(brute(docs, items))


def words(rng, n):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) % 400)


@pytest.mark.parametrize("k,postings", [(1, 1), (3, 200), (10, 1 << 20)])
def test_small_shards_and_few_places(spark, k, postings):
    """Shards of one row to all rows; with few places accumulators are refused early."""
    rng = np.random.default_rng(k)
    docs = [(int(i), words(rng, int(rng.integers(1, 60)))) for i in rng.permutation(300)]
    items = [(i, words(rng, 12) + f" w{i}") for i in range(25)]
    got = ranked_search.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), k, postings)
    assert by_item(rows(got)) == by_item(brute(docs, items, k))


def test_no_accumulator_is_opened_once_the_rest_cannot_reach_the_kth():
    """Term 0 (rare, heavy) fills the places; term 1 only raises those that have an accumulator."""
    terms, times, sizes = np.array([0, 1, 0, 1, 1, 1]), np.ones(6, np.int64), np.array([2, 2, 1, 1])
    shard = ranked_search.Shard(terms, times, sizes, np.full(4, 100), np.array([1000, 1]))
    docs, scores = shard.search(np.array([0, 1]), 2, 0)
    assert docs.tolist() == [0, 1] and len(set(scores.tolist())) == 1
    assert scores[0] == 1001 * (1_000_000_000 // 3000)
    assert shard.search(np.array([0, 1]), 2, int(scores[0]) + 1)[0].tolist() == []
    assert sorted(shard.search(np.array([0, 1]), 3, 0)[0].tolist()) == [0, 1, 2, 3]  # ties of the third place


def test_defined_cases(spark):
    docs = [(5, "alpha beta"), (5, "alpha beta"), (3, "Alpha BETA"), (None, "alpha beta"), (7, None), (8, ""), (9, "ÀB àb é"), (10, "...")]
    items = [(1, "ALPHA"), (1, "beta alpha"), (2, None), (3, "zzz"), (4, "Àb"), (None, "é")]
    table = spark.createDataFrame(docs, DOCS).withColumns({"n": F.lit("clash"), "terms": F.lit(0), "rank": F.lit(1), "item": F.lit(2)})
    asked = spark.createDataFrame(items, ITEMS).withColumns({"doc_id": F.lit("clash"), "block": F.lit(1)})
    got = by_item(rows(ranked_search.search(table, asked)))
    assert got == by_item(brute(docs, items))
    assert [r[2] for r in got if r[0] == 1] == [3, 5, 5, None]
    assert [r[0] for r in got if r[2] == 9] == [4, None]


def test_empty_tables(spark):
    none, docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert ranked_search.search(none, items).count() == 0
    out = ranked_search.search(docs, spark.createDataFrame([], ITEMS))
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_blocks_of_items(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [(i, words(rng, 30)) for i in range(60)]
    items = [(i, words(rng, 9)) for i in range(12)]
    table, asked = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS).coalesce(1)
    held = ranked_search.item_blocks
    weights = {i: 64 + len(set(terms(t))) for i, t in items}
    for parts in (1, 4, 30):  # however the items lie, blocks fill up
        blocks = {}
        for r in held(asked.repartition(parts), 200).collect():
            blocks.setdefault(r.block, []).append(weights[r.item_id])
        assert len(blocks) == -(-sum(weights.values()) // 200) or len(blocks) == sum(weights.values()) // 200
        assert all(sum(w) - max(w) < 200 for w in blocks.values())
    monkeypatch.setattr(ranked_search, "item_blocks", lambda items: held(items, 200))
    assert by_item(rows(ranked_search.search(table, asked, 5))) == by_item(brute(docs, items, 5))


def test_very_long_text(spark):
    text = "alpha " * 700_000 + "beta " + "x" * 5_000_000 + " gamma"
    docs, items = [(1, text), (2, "beta gamma"), (3, "other")], [(1, "alpha beta"), (2, "gamma " + "x" * 5_000_000)]
    got = ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert by_item(rows(got)) == by_item(brute(docs, items))


def test_slices_keep_terms_whole(monkeypatch):
    monkeypatch.setattr(ranked_search, "SLICE", 10)
    text = "Émile et   Zoé, " * 20 + "y" * 50
    assert [t.decode() for part in ranked_search.terms_in(text) for t in part] == terms(text)


def test_norms_beyond_64_bits():
    n = np.array([10, 4 * 10**9], np.int64)
    assert ranked_search.lengths_norm(n, 10**11, 10**13).tolist() == [50 + 50 * int(x) * 10**11 // 10**13 for x in n]
