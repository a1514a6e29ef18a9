import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxsite.llm import packing, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "  a  b ", "a\n b", "\n\n x", "it's we'll", "tab\t tab", "é 🎉 ß\u00a0 x\u2003 y", "<|endoftext|> a<|endoftext|>", "x" * 5000, "12 34  56", "\x1f z \x85 q", "a \x1c b", " lead", "trail "]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(spark, reference):
    tokens = packing.Tokens()
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in texts * 2:
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == reference(text), repr(text[:80])


def test_new_segments_of_a_batch_are_encoded_together(reference):
    tokens, asked = packing.Tokens(), []
    ids_of = tokens.segments._ids
    tokens.segments._ids = lambda texts: asked.extend(texts) or ids_of(texts)
    texts = [f"word{k} some, {k} words. End\nof line{k}" for k in range(300)]
    for _ in range(2):
        found = [np.frombuffer(x, "<u4").tolist() for x in tokens.encode_all(texts)]
        assert found == list(map(reference, texts))
    assert len(asked) < 10  # not one call for each of 1,500 segments
    odd = ODD + texts + ["", "a\0 b \0", "  ", " " * 300 + "x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode_all(odd)] == list(map(reference, odd))


def check(rows, sizes, ids, length):
    """Every id in exactly one piece, sequences gapless and full but for the last."""
    seen, by_sequence = {}, {}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == sizes[r.doc_id] and len(part) == r.length > 0
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == sizes[doc]
    assert seen.keys() == sizes.keys()
    assert sorted(by_sequence) == list(range(-(-sum(sizes.values()) // length)))
    for k, parts in by_sequence.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or k == max(by_sequence) and at <= length


def test_query(spark, reference):
    ids = {r.doc_id: [*reference(r.text), 0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(queries.op4_packing(spark, SF).collect(), {k: len(v) for k, v in ids.items()}, ids, 1024)


@pytest.mark.parametrize("length,partitions", [(16, 1), (16, 7), (1024, 5)])
def test_boundary_records_over_many_partitions(spark, reference, length, partitions):
    texts = ODD + [None, "w " * 3000] + [f"short {k}" for k in range(60)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS).repartition(partitions)
    docs = docs.withColumns({"part": F.lit("clash"), "ids": F.lit(1), "n": F.lit(2)})
    ids = {k: [*reference(t), 0] for k, t in enumerate(texts)}
    sequences = packing.pack(docs, length)
    check(packing.pieces(sequences).collect(), {k: len(v) for k, v in ids.items()}, ids, length)
    for r in sequences.collect():
        assert r.n_tokens * 4 == len(r.ids) and r.padded_length == (r.n_tokens if r.n_tokens.bit_count() == 1 else length)


def test_repeated_rows_nulls_and_empty_table(spark):
    rows = [(1, "a b", "en", "s", 3)] * 3 + [(None, None, None, None, None)] * 2
    out = packing.pieces(packing.pack(spark.createDataFrame(rows, DOCS))).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.doc_tokens) for r in out) == [("1", 0, 3, 3)] * 3 + [("None", 0, 1, 1)] * 2
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
