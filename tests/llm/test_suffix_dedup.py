import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxsite.llm import induction, queries, suffix_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SIZE = induction.LENGTH


def brute(texts):
    """Per text: bytes, removed bytes, spans, hash of what stays."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + SIZE] for t in raw for i in range(len(t) - SIZE + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - SIZE + 1):
            if seen[t[i : i + SIZE]] > 1:
                gone[i : i + SIZE] = b"\1" * SIZE
        spans = sum(gone[i] and (not i or not gone[i - 1]) for i in range(len(t)))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(rows):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(rows, key=lambda r: r.doc_id)]


def patchwork(rng, texts=30):
    """Texts of shared passages around the length limit, runs, short periods and noise."""
    base = "".join(rng.choice("ab cdé") for _ in range(3000))
    out = []
    for _ in range(texts):
        t, size = "", rng.choice([150, 400, 1500])
        while len(t) < size:
            kind = rng.random()
            if kind < 0.5:
                at = rng.randrange(2800)
                t += base[at : at + rng.choice([50, 150, 199, 200, 201, 230, 500])]
            elif kind < 0.7:
                t += rng.choice("xy") * rng.randrange(300)
            elif kind < 0.8:
                t += ("".join(rng.choice("pqr") for _ in range(rng.randrange(1, 9))) * 200)[: rng.randrange(700)]
            else:
                t += "".join(rng.choice("0123456789") for _ in range(rng.randrange(100)))
        out.append(t)
    return out


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got(queries.op6_suffix_dedup(spark, SF).collect()) == brute([texts[i] for i in sorted(texts)])


@pytest.mark.parametrize("crowded", [2, 256])
def test_patchwork_equals_brute_force(spark, crowded, monkeypatch):
    """Both ways of resolving the ends of passages, and texts longer than a slice."""
    texts = patchwork(random.Random(4)) + [None, "", "z" * (SIZE - 1), "w" * SIZE, "w" * SIZE]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    docs = docs.withColumn("row", F.lit("clash")).withColumn("place", F.lit(1))
    assert got(suffix_dedup.remove_repeats(docs, crowded).collect()) == brute(texts)


def test_slices_of_long_texts(monkeypatch):
    """The anchors of a long text are found in slices; every window is in one of them."""
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    raw = [t.encode() for t in patchwork(random.Random(9), 8)] + [b"ab" * 3000]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    windows = Counter()
    for text, _, anchor, first, last in suffix_dedup.text_runs(data, offsets):
        for t, p, a, b in zip(text.tolist(), anchor.tolist(), first.tolist(), last.tolist(), strict=True):
            assert a <= b <= p <= a + induction.SPREAD - 1
            windows.update((t, i) for i in range(a, b + 1))
    assert windows == Counter((t, i) for t, x in enumerate(raw) for i in range(len(x) - SIZE + 1))


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(2).choice("abcdef ") for _ in range(450))
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (1, text, "en", "s", 0), (None, text[:100], None, None, None)], DOCS)
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((r.doc_id is None, r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [(False, 450, 450, 1), (False, 450, 450, 1), (True, 100, 0, 0)]
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
