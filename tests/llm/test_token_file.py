import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxsite.llm import queries, token_file

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    "", " ", "  a  b ", "a\n b", "\n\n x", "it's we'll", "tab\t tab", "é 🎉 ß  x  y", "<|endoftext|> a<|endoftext|>", "x" * 5000,
    "12 34  56", "\x1f z \x85 q", "a \x1c b", " lead", "trail ", "! !! !", "　 wide　 x", "one  two",
]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def expected(docs, reference):
    """(doc_id, start, n_tokens, crc) in ascending order of doc_id."""
    out, at = [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        ids = np.array([*reference(text), 0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_query_equals_brute_force(spark, reference):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(queries.op11_token_file(spark, SF)) == expected(docs, reference)


def test_segments_have_the_ids_of_the_whole_text(reference):
    tokens = token_file.Tokens(token_file.VOCABULARY)
    for raw, text in zip(tokens.encode(ODD), ODD, strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == reference(text), repr(text[:60])


def test_random_texts_have_the_ids_of_the_library(reference):
    """White space, marks and letters in any order; a batch in which a text holds the mark of the splits, too."""
    rng = np.random.default_rng(7)
    letters = list("aabeS1' \n\t.,&  \r") + ["'s", "\u00e9", "\u00a0", "\u2003", "\x1c", "\x85", "\u200b", "\U0001f389", "</s>", " the", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    tokens = token_file.Tokens(token_file.VOCABULARY)
    for batch in (texts[:1500], [*texts[1500:1600], "a\0 b  \0c"], texts[1600:], ["only"], [""]):
        for raw, text in zip(tokens.encode(batch), batch, strict=True):
            assert np.frombuffer(raw, "<u2").tolist() == reference(text), repr(text)


def test_long_texts_are_split_in_slices(reference, monkeypatch):
    monkeypatch.setattr(token_file, "SLICE", 50)
    tokens = token_file.Tokens(token_file.VOCABULARY)
    texts = ["word  and \n words, " * 40, "x" * 300, "short", "a b " * 100]
    for raw, text in zip(tokens.encode(texts), texts, strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == reference(text)


def test_a_text_of_many_megabytes(spark, reference, tmp_path):
    text = "".join(f"word{k % 977} and, {k}\n" for k in range(300_000))
    assert len(text) > 4_000_000
    docs = spark.createDataFrame([(2, text, None, None, 0), (1, "first", None, None, 0), (3, None, None, None, 0)], DOCS)
    token_file.write_ids(docs, f"{tmp_path}/f", block=1 << 18)
    assert rows(token_file.documents(spark, f"{tmp_path}/f")) == expected([(2, text), (1, "first"), (3, None)], reference)


@pytest.mark.parametrize("partitions,block", [(1, 64), (7, 1000), (5, 1 << 20)])
def test_blocks_cut_documents(spark, reference, tmp_path, partitions, block):
    texts = [*ODD, None, "w " * 3000] + [f"short {k}" for k in range(60)]
    docs = [(1000 - 7 * k, t) for k, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS).repartition(partitions)
    table = table.withColumns({"part": F.lit("clash"), "ids": F.lit(1), "n": F.lit(2), "at": F.lit(0)})
    token_file.write_ids(table, f"{tmp_path}/f", block=block, lanes=16, span=4)
    assert rows(token_file.documents(spark, f"{tmp_path}/f")) == expected(docs, reference)
    pieces = {}
    for r in token_file.read_pieces(spark, f"{tmp_path}/f").collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for doc_id, text in docs:
        assert np.frombuffer(b"".join(raw for _, raw in sorted(pieces[doc_id])), "<u4").tolist() == [*reference(text), 0]


def test_repeated_rows_missing_ids_and_empty_table(spark, reference, tmp_path):
    docs = [(1, "a b")] * 3 + [(None, None)] * 2 + [(2, "c")]
    token_file.write_ids(spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], DOCS), f"{tmp_path}/a")
    assert rows(token_file.documents(spark, f"{tmp_path}/a")) == expected(docs, reference)
    token_file.write_ids(spark.createDataFrame([], DOCS), f"{tmp_path}/b")
    out = token_file.documents(spark, f"{tmp_path}/b")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 0


def coded(n, seed=0, lanes=64, span=8):
    ids = np.minimum(np.random.default_rng(seed).zipf(1.3, n), 40_000).astype(np.uint32) - 1
    table = token_file.Table.of(*np.unique(ids, return_counts=True))
    return ids, table, token_file.encode_block(ids, table, lanes, span)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 127, 128, 129, 4095, 4096, 4097, 64 * 64 * 3, 64 * 64 * 3 + 5])
def test_round_trip_of_block_sizes(n):
    ids, table, raw = coded(n)
    assert (token_file.decode_block(raw, table, table.slots) == ids).all()


def test_size_is_near_the_entropy():
    ids, table, raw = coded(400_000, lanes=256, span=512)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(raw) * 8 / len(ids) < 1.03 * -(share * np.log2(share)).sum()


def test_checkpoints_decode_a_part_alone():
    ids, table, raw = coded(20_000)
    for begin, end in [(0, 1), (511, 513), (512, 1024), (19_000, 20_000), (19_999, 20_000), (7, 18_000), (5, 5)]:
        assert (token_file.decode_block(raw, table, table.slots, begin, end) == ids[begin:end]).all()


def test_damage_is_found():
    _, table, raw = coded(5000)
    for at in (0, len(raw) // 2, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 4
        with pytest.raises(ValueError, match="damaged"):
            token_file.decode_block(bytes(bad), table, table.slots)
    with pytest.raises(ValueError, match="another"):
        token_file.decode_block(raw, coded(5000, seed=1)[1], table.slots)


def test_frequencies_keep_every_id_and_fill_the_range():
    table = token_file.Table.of(np.arange(1000), np.array([10**12] + [1] * 999), bits=10)
    assert table.frequencies.min() == 1 and table.frequencies.sum() == 1024
    with pytest.raises(ValueError, match="bits"):
        token_file.Table.of(np.arange(5), np.ones(5, int), bits=2)


def test_joined_checksums():
    data = bytes(range(256)) * 5
    for cut in (0, 1, 100, len(data)):
        assert token_file.crc32_joined(zlib.crc32(data[:cut]), zlib.crc32(data[cut:]), len(data) - cut) == zlib.crc32(data)
