import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxsite.llm import queries, quality_fm
from fluxsite.llm.quality_fm import Machine, Shape

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
SMALL = Shape(word_buckets=256, max_rows=200, shards=2, rounds=2)


def test_pairs_by_squares_equal_the_double_sum():
    shape = Shape(word_buckets=64, rank=5)
    m, rng = Machine(shape), np.random.default_rng(1)
    m.linear[:] = rng.normal(size=shape.size)
    index, value = rng.choice(shape.size, 12, replace=False), rng.normal(size=12).astype(np.float32)
    pairs = sum(float(m.factors[index[i]] @ m.factors[index[j]]) * value[i] * value[j] for i in range(12) for j in range(i))
    assert m.raw_score(index, value)[0] == pytest.approx(float(m.linear[index] @ value) + pairs, rel=1e-4)


def test_gradient_is_that_of_the_loss():
    shape = Shape(word_buckets=16, rank=3, epochs=1, l2=0.0)
    index, value = np.array([1, 4, 9]), np.array([0.5, 1.0, -0.7], np.float32)

    def loss(m):
        return -np.log(m.score(index, value))

    m = Machine(shape)
    before = loss(m)
    m.fit([(index, value, 1)] * 20, shape, 0)
    assert loss(m) < 0.3 * before


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_quality_fm(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    unseen = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in unseen)
    assert right / len(unseen) > 0.95


def brute_features(text, declared):
    """{slot: value} of a document, from the definitions."""
    raw = (text or "").encode()
    words, lines = raw.split(), raw.split(b"\n")
    n, size = max(1, len(words)), max(1, len(raw))
    some = lambda chars: sum(c in chars for c in raw)
    upper, digits = set(range(65, 91)), set(b"0123456789")
    letters = max(1, some(upper | set(range(97, 123)) | set(range(128, 256))))
    symbols = {c for c in range(33, 127) if not chr(c).isalnum()} - set(b".,;:?!|'\"-()")
    times = {w: words.count(w) for w in set(words)}
    sizes = [len(words), len(lines)]
    shares = [
        len(times) / n, sum(a == b for a, b in zip(words, words[1:])) / n, max(times.values(), default=0) / n, 1 - len(set(lines)) / len(lines),
        some(symbols) / size, raw.count(b"|") / n, raw.count(b"!") / n, some(set(b".,;:?")) / n, some(digits) / size, some(upper) / letters, some({0xC3, 0xE2}) / size,
    ]
    log_bin = lambda x: min(15, int(math.log2(1 + x)))
    slots = [*map(log_bin, [*sizes, 4 * size / n]), *[sum(x > end for end in quality_fm.SHARE_BINS) for x in shares]]
    slots += [15 if declared is None else log_bin(max(0, declared)), 2 if declared is None else int(declared != len(text or ""))]
    hashed = {}
    for w in words:
        at = zlib.crc32(w.lower()) % (1 << 13)
        hashed[at] = hashed.get(at, 0) + 1
    norm = max(1e-6, math.sqrt(sum(hashed.values())))
    return {at: math.sqrt(k) / norm for at, k in hashed.items()} | {(1 << 13) + 16 * k + slot: 0.5 for k, slot in enumerate(slots)}


def test_every_score_equals_the_double_sum_over_pairs(spark):
    """The whole query on a whole table: features from their definitions, pairs one by one."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = quality_fm.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {}
    for r in docs.collect():
        found = brute_features(r.text, r.n_chars)
        index, value = list(found), np.array(list(found.values()))
        v = m.factors[index].astype(np.float64)
        pairs = np.triu((v @ v.T) * np.outer(value, value), 1).sum()
        want[r.doc_id] = 1 / (1 + math.exp(-(m.bias + m.linear[index] @ value + pairs)))
    got = {r.doc_id: r.score for r in queries.op1_quality_fm(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def toy(rng, n=400):
    good = [" ".join(rng.choice(["sun", "sea", "hill", "rain"]) for _ in range(20)) + "." for _ in range(n)]
    rows = [(k, t if k % 4 else t.replace(" ", " | "), "en", "s", len(t)) for k, t in enumerate(good)]
    return rows, [(k, int(k % 4 > 0), 0) for k in range(n)]


def test_held_out_labels_teach_nothing(spark):
    rows, labels = toy(random.Random(1))
    docs = spark.createDataFrame(rows, DOCS)
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    wrong = [(k, 1 - q if held(k) else q, t) for k, q, t in labels]
    a, b = (quality_fm.train(docs, spark.createDataFrame(x, LABELS), SMALL) for x in (labels, wrong))
    assert a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()
    scores = {r.doc_id: r.score for r in quality_fm.score(docs, a, SMALL).collect()}
    assert all((scores[k] >= 0.5) == q for k, q, _ in labels)


def test_the_bound_of_the_sample_holds(spark):
    rows, labels = toy(random.Random(2))
    docs = spark.createDataFrame(rows * 3, DOCS)
    shape = Shape(word_buckets=256, max_rows=50)
    assert quality_fm.sample(docs, spark.createDataFrame(labels, LABELS), shape).count() == 50


def test_defined_cases(spark):
    rows, labels = toy(random.Random(3), 80)
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", None), (1002, "sun " * 200_000, "en", "s", 7), (None, "sun", "en", "s", 3), (1000, None, None, None, None)]
    docs = spark.createDataFrame(rows + odd, DOCS).withColumns({"score": F.lit("clash"), "declared": F.lit(1), "a b`c": F.lit(2)})
    labels = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (1000, 1, 0)], LABELS)
    machine = quality_fm.train(docs, labels, SMALL)
    out = quality_fm.score(docs, machine, SMALL).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    kept = quality_fm.keep_good(docs, machine, SMALL)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(str(r.doc_id) for r in out if r.score >= 0.5)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality_fm.score(docs, quality_fm.train(docs, none, SMALL), SMALL).collect()} != set()
    empty = spark.createDataFrame([], DOCS)
    assert quality_fm.score(empty, machine, SMALL).count() == 0 and quality_fm.keep_good(empty, machine, SMALL).count() == 0
    assert quality_fm.train(empty, labels, SMALL).bias == 0


@pytest.mark.parametrize("usable", [[], [(k, 1, 0) for k in range(80)], [(k, 0, 0) for k in range(80)]])
def test_without_both_classes_every_score_is_one_half(spark, usable):
    rows, _ = toy(random.Random(4), 80)
    docs = spark.createDataFrame(rows, DOCS)
    machine = quality_fm.train(docs, spark.createDataFrame(usable, LABELS), SMALL)
    scores = quality_fm.score(docs, machine, SMALL).collect()
    assert len(scores) == 80 and {r.score for r in scores} == {0.5}
    assert sorted(r.doc_id for r in quality_fm.keep_good(docs, machine, SMALL).collect()) == list(range(80))
