import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from fluxsite.llm import exact_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", "s", 0) for i, t in texts]


def brute(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(t or "", []).append(i)
    return sorted((i, max(by[t or ""]), len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)


def sample():
    rng = random.Random(1)
    base = "".join(rng.choice("abcdé \n") for _ in range(60000))
    texts = [base, base, base[:-1], "x" + base, base[:30000] + "!" + base[30000:], None, "", "a", "a", "A", "z" * 50000, "z" * 50000, "z" * 50001]
    return list(enumerate(texts))


def test_groups_equal_brute_force(spark):
    rows = rows_of(sample())
    docs = spark.createDataFrame(rows, DOCS).withColumn("recipe", F.lit("clash")).withColumn("row", F.lit(1))
    out = exact_dedup.groups(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == brute(rows)
    assert {r.doc_id for r in out if r.kept} == {r.keep_id for r in out}


def test_texts_longer_than_a_slice(spark):
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefgh é\n", k=5_000_000))
    assert len(text) > exact_dedup.SLICE
    rows = rows_of(enumerate([text, text, text + "!", "!" + text, text[:-1], "short", text]))
    out = exact_dedup.groups(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == brute(rows)


def test_a_weak_digest_is_found_out(spark):
    """A digest that stands for two chunks is not an identifier: the next one is taken."""
    rows = rows_of(sample())
    docs = spark.createDataFrame(rows, DOCS)
    weak = lambda b: bytes([len(b) % 2])
    assert not exact_dedup.verified(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), weak)
    out = exact_dedup.groups(docs, digests=(weak, lambda b: b)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == brute(rows)


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = rows_of([(1, "a"), (1, "a"), (None, "a"), (2, "b"), (None, "c"), (None, "c")])
    docs = spark.createDataFrame(rows, DOCS)
    out = exact_dedup.groups(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out) == [
        ("1", "1", 3), ("1", "1", 3), ("2", "2", 1), ("None", "1", 3), ("None", "None", 2), ("None", "None", 2)]
    assert sum(r.kept for r in out) == 3
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["a", "b", "c"]
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def test_cuts_do_not_depend_on_slices(monkeypatch):
    data = np.random.default_rng(2).integers(97, 123, 150_000).astype(np.uint8)
    whole = exact_dedup.cut_points(data).tolist()
    assert len(whole) > 40
    for size in (whole[3], whole[5] - 1, whole[7] + 1, 1_000):  # cuts at, before and after the end of a slice
        monkeypatch.setattr(exact_dedup, "SLICE", size)
        assert exact_dedup.cut_points(data).tolist() == whole


def test_chunks_depend_on_content_alone():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 123, 200_000).astype(np.uint8)
    shifted = np.concatenate([rng.integers(97, 123, 3_001).astype(np.uint8), text])
    ends = lambda d, start: [e - start for e in exact_dedup.chunk_ends(exact_dedup.cut_points(d), start, len(d))]
    assert ends(text, 0) == ends(shifted, 3_001)
    sizes = np.diff([0, *ends(text, 0)])
    assert sizes.max() <= exact_dedup.MAX_CHUNK and sizes[:-1].min() >= exact_dedup.MIN_CHUNK
