import math
import random

import pytest
from pyspark.sql import functions as F

from fluxsite.llm import queries, topk

EMB = "vec_id long, embedding array<float>, label int"


def brute(vectors, is_query, k=20):
    out = []
    for q in vectors:
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(vectors[q], vectors[c])), c) for c in vectors if c != q)
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block", [7, 1024])
def test_exact_over_clusters_copies_and_ties(spark, block):
    rng = random.Random(8)
    centres = [[rng.randrange(-40, 40) for _ in range(6)] for _ in range(5)]
    vectors = {k: [x + rng.randrange(-2, 3) for x in rng.choice(centres)] for k in range(300)}
    vectors |= {k: list(centres[0]) for k in range(300, 450)}  # one very common vector
    vectors |= {450: [0] * 6, 451: [10**6] * 6}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<bigint>")
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, n_pivots=8, block=block)
    assert got(out) == brute(vectors, lambda q: q % 20 == 0)


def test_annuli_are_skipped_by_the_bound():
    """The bound excludes what cannot reach the k-th score, and nothing that can."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-3, 4, (200, 8)) + 100 * rng.integers(-1, 2, 8) for _ in range(6)])
    most = float((x**2).sum(axis=1).max())
    pivots = topk.Pivots(x[::200], most)
    pivot, distance = pivots.nearest(x)
    rows = [type("R", (), {"block": int(p), "pivot": int(p), "near": distance[pivot == p].min(), "far": distance[pivot == p].max(), "n": int((pivot == p).sum())}) for p in np.unique(pivot)]
    annuli, visited = topk.Annuli(rows), 0
    for q in x[::97]:
        scores = x @ q
        bound = np.sort(scores)[-20]
        gaps = annuli.gaps(pivots.from_queries(q[None])[0])
        found = set(annuli.block[annuli.within(gaps, float((q**2).sum()), most, bound)].tolist())
        assert set(pivot[scores >= bound].tolist()) <= found
        visited += len(found)
    assert visited < 0.8 * len(x[::97]) * len(rows)


def test_query_skips_unusable_vectors(spark, write):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(4)], 0) for k in range(45)]
    rows += [(60, None, 0), (80, [1.0, None, 0.0, 0.0], 0), (100, [math.nan, 0.0, 0.0, 0.0], 0), (101, [math.inf, 0.0, 0.0, 0.0], 0), (None, [0.5] * 4, 0), (20, rows[20][1], 1)]
    d = write("embeddings", rows, EMB)
    import numpy as np

    vectors = {k: [math.floor(64 * float(np.float32(x))) for x in v] for k, v, _ in rows[:45]}
    assert got(queries.op8_topk(spark, d)) == brute(vectors, lambda q: q % 20 == 0)


def test_few_candidates_uneven_lengths_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, []), (3, [5, 5, 5])], "vec_id long, v array<bigint>").withColumn("block", F.lit("clash"))
    assert got(topk.top_k(df, F.col("vec_id") == 0)) == [(0, 1, 3, 15), (0, 2, 1, 3), (0, 3, 2, 0)]
    assert topk.top_k(df.where("vec_id = 0"), F.lit(True)).count() == 0
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_no_group_holds_all_queries_of_an_annulus(spark, monkeypatch):
    """A third of the vectors is equal, so their queries visit the same annuli."""
    rng = random.Random(9)
    vectors = {k: [5, 5, 5] if k % 3 == 0 else [rng.randrange(-9, 10) for _ in range(3)] for k in range(600)}
    real = topk._score

    def watched(dim, k):
        score = real(dim, k)

        def run(key, queries, block):
            assert queries.num_rows <= 60, f"{queries.num_rows} queries in a group"
            return score(key, queries, block)

        return run

    monkeypatch.setattr(topk, "_score", watched)
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<bigint>")
    out = topk.top_k(df, F.col("vec_id") % 2 == 0, k=5, n_pivots=4, block=50, most_visits=20)
    assert got(out) == brute(vectors, lambda q: q % 2 == 0, 5)


def test_scores_beyond_64_bits_are_refused(spark):
    rows = spark.createDataFrame([(20, [64 * 10**10, 1]), (1, [64 * 10**10, 2]), (2, [1, 1])], "vec_id long, v array<bigint>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(rows, F.col("vec_id") % 20 == 0)
    big = [(20, [2 * 10**9, 10**9]), (1, [2 * 10**9, -(10**9)]), (2, [-2 * 10**9, 10**9])]
    got = topk.top_k(spark.createDataFrame(big, "vec_id long, v array<bigint>"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 3 * 10**18), (2, 2, -3 * 10**18)]
