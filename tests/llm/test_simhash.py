import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fluxsite.llm import queries, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=3):
    """prints: {id: fingerprint} -> {id: least id reachable}."""
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark):
    rows = queries.op5_simhash(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    parts = brute_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", parts[i]) for i in texts}
    assert len(rows) == len(texts)


def test_texts_of_many_megabytes(spark):
    rng = random.Random(6)
    words = [f"Word{rng.randrange(10**6)}" for _ in range(500_000)]
    texts = {1: " ".join(words), 2: "\t".join(words[:-1]) + " last", 3: " ".join(reversed(words)), 4: "short text"}
    assert len(texts[1]) > 4 << 20
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    prints = {}
    for i, t in texts.items():
        own = t.lower().encode().split()
        h = np.array([xxhash.xxh64_intdigest(b" ".join(own[k : k + 3]), 42) for k in range(max(1, len(own) - 2))], np.uint64)
        prints[i] = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    parts = brute_components(prints)
    out = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{prints[i]:016x}", parts[i]) for i in texts}


@pytest.mark.parametrize("block", [4, 2048])
def test_links_of_random_clusters(spark, block):
    """Chains and balls around shared centres; crowded cells are dealt as block pairs."""
    rng = random.Random(5)
    prints = {0: 0, 1: (1 << 64) - 1}
    for centre in [0, (1 << 64) - 1, *[rng.getrandbits(64) for _ in range(12)]]:
        at = centre
        for _ in range(25):
            at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 5])))
            prints[len(prints)] = at
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in prints.items()}
    rows = spark.createDataFrame([(i, p, str(i)) for i, p in signed.items()], "doc_id long, fp long, sha string")
    prints_df = rows.select("fp").distinct()
    edges = simhash.links(prints_df, block=block)
    found = simhash.components(edges).collect()
    root = {r.node: r.root for r in found}
    least = {}
    for i, p in signed.items():
        least.setdefault(root.get(p, p), []).append(i)
    got = {i: min(v) for v in least.values() for i in v}
    assert got == brute_components(prints)


def test_defined_cases(spark):
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \t\n", "en", "a", 3), (4, "One", "en", "a", 3),
        (5, "one", "en", "a", 3), (5, "one", "en", "a", 3), (None, "one", "en", "a", 3), (6, "x " * 30000, "en", "a", 60000),
        (7, "È b c d", "en", "b", 7), (8, "è b c d", "en", "b", 7),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: (r.fingerprint, r.component_id) for r in out}
    zero = "0" * 16
    assert by[1] == by[2] == by[3] == (zero, 1)
    one = f"{xxhash.xxh64_intdigest(b'one', 42):016x}"
    assert by[4] == by[5] == by[None] == (one, 4)
    assert by[7][0] != by[8][0]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8]
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_the_bound_filters_pairs_before_their_bits_are_checked(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    prints = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64) & np.uint64(0x1111222244448888))
    prints = np.unique(np.concatenate([prints, prints ^ np.uint64(3 << 40)]))
    counts = simhash.segment_counts(prints).astype(int)
    distance = np.abs(counts[:, None] - counts[None, :]).sum(axis=2)
    bits = np.bitwise_count(prints[:, None] ^ prints[None, :])
    half = np.triu(np.ones_like(bits, bool), 1)
    checked, real = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: checked.append(x) or real(x))
    a, b = simhash._links_of(prints, prints, np.ones(len(prints), bool), 3)
    pairs = sum(x.size for x in checked if x.ndim == 1)  # bits of single pairs
    assert pairs == (half & (distance <= 3)).sum() < half.sum() / 2
    whole = [x for x in checked if x.ndim == 2 and x.shape == bits.shape]
    assert len(whole) == 1 and (real(whole[0]) == distance).all()
    i, j = np.nonzero(half & (bits <= 3))
    label = simhash.spanning(len(prints), i, j)
    moved = label != np.arange(len(prints))
    assert (a == prints[moved]).all() and (b == prints[label[moved]]).all() and moved.any()
