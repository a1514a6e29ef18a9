import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxsite.llm import queries, spelling_variants as S

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def count_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    words = count_words(docs)
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and distance_one(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.op13_spelling_variants(spark, SF)) == brute(docs)


def made(seed, n=400):
    """Few letters: most words have near ones, and many share a vector."""
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("abné"), int(rng.integers(4, 9)))) for _ in range(n)]
    return [(int(k) if k % 9 else None, " ".join(rng.choice(pool, 60))) for k in range(200)]


@pytest.mark.parametrize("seed,block,visits", [(1, 3, 5), (2, 64, 20), (3, 8192, 1 << 15)])
def test_small_blocks_and_crowded_ones(spark, seed, block, visits):
    docs = made(seed)
    got = rows(S.variants(spark.createDataFrame(docs, DOCS).repartition(6), block, visits))
    assert got == brute(docs) and any(r[4] > 3 for r in got)


def test_chains_are_followed_to_the_last(spark):
    chain = ["aaaaa" + "bcdefghij"[:k] for k in range(9)]  # each form occurs twice as often
    docs = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k)))]
    assert rows(S.variants(spark.createDataFrame(docs, DOCS))) == brute(docs)
    links = spark.createDataFrame([(str(k), str(k + 1)) for k in range(37)] + [("x", "5")], "word string, form string")
    assert {r.root for r in S.roots(links).collect()} == {"37"}


def test_defined_cases(spark):
    docs = [(1, "Hello hello HELLO hellos hellos hellos hellos hellos hellos"), (1, "Hello"), (None, "ÉÉÉÉÉ ÉÉÉÉÉ ÉÉÉÉÉ ÉÉÉÉé"), (3, None), (4, ""), (5, "a-b ÿÿÿÿÿ×÷ ÿÿÿÿÿ×÷Āÿÿÿÿÿ×÷")]
    table = spark.createDataFrame(docs, DOCS).withColumns({"word": F.lit("clash"), "n": F.lit(1), "form": F.lit(2), "block": F.lit(3)})
    assert rows(S.variants(table)) == brute(docs) != []
    out = S.variants(spark.createDataFrame([], DOCS))
    assert sorted(out.columns) == ["form", "form_n", "n", "n_near", "root", "word"] and out.count() == 0


def test_very_long_texts_and_words(spark):
    long = "q" * 1_500_000
    docs = [(1, "tests " * 700_000 + f"{long} {long}x"), (2, f"{long} {long}x {long} {long}x tested tested tested")]
    got = rows(S.variants(spark.createDataFrame(docs, DOCS)))
    assert {r[0]: r[3] for r in got} == count_words(docs)
    assert [r[4] for r in got if len(r[0]) > 10] == [1, 1]  # the two long words


def test_slices_keep_runs_whole(monkeypatch):
    monkeypatch.setattr(S, "SLICE", 10)
    text = "Émile et   Zoé, " * 20 + "Y" * 50 + "."
    want = [re.sub("[A-Z]", lambda m: m[0].lower(), r) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert [r for part in S.runs_of(text) for r in part] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcné", min_size=1, max_size=7), min_size=1, max_size=25, unique=True))
def test_search_finds_every_near_pair_once(pool):
    i, j = S.near_pairs(pool, pool)
    found = [frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)]
    want = {frozenset((a, b)) for a in range(len(pool)) for b in range(a) if distance_one(pool[a], pool[b])}
    assert len(found) == len(set(found)) and set(found) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcno", min_size=1, max_size=6), min_size=1, max_size=30, unique=True), st.integers(1, 7))
def test_blocks_that_hold_near_words_are_visited(pool, size):
    vectors = S.Letters(pool).vectors()
    order = np.lexsort(vectors.T[::-1])
    cuts = [order[k : k + size] for k in range(0, len(order), size)]
    trie = S.Trie(np.array([vectors[c[0]] for c in cuts]), np.array([vectors[c[-1]] for c in cuts]))
    seen = {(int(i), b) for alive, begin, end in trie.search(vectors, 1) for i in alive for b in range(begin, end)}
    of = {int(i): b for b, cut in enumerate(cuts) for i in cut}
    for i in range(len(pool)):
        for j in range(i):
            if distance_one(pool[i], pool[j]):
                assert (i, of[j]) in seen or (j, of[i]) in seen


def test_pairs_in_small_slices(monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 40)
    pool = [w for w, _ in Counter(t for _, text in made(5) for t in text.split()).most_common(150)]
    i, j = S.near_pairs(pool, pool)
    want = {(a, b) for a, w in enumerate(pool) for b, v in enumerate(pool[:a]) if distance_one(w, v)}
    assert {(max(p), min(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want
