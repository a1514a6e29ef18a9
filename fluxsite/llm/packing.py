"""Concatenate and cut: token packing with global offsets.

First pass: every text is tokenised once and written with its place in its
partition. The partitions' token totals give, by a prefix sum, where each
partition starts in the one long run of all tokens. Second pass: the run is cut
into windows of fixed length. A window that lies in one task leaves it whole;
the pieces of a window that crosses tasks are boundary records, and only those
are shuffled to be put together.

Defined cases: a NULL or empty text is its end mark alone; repeated rows are
packed as often as they occur; the last window may be shorter and is padded to
the full length unless its length is a power of two; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import token_file
from .common import text_or_empty, work_table

LENGTH = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k.tiktoken"  # the vocabulary of byte_bpe_50k.json as ranks

PIECE = "struct<doc_id:{key},start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>"


class Tokens:
    """Ids of texts as little-endian uint32 bytes."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.segments = _Segments(encoding, ranks)

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        return self.segments.encode(texts)


class _Segments(token_file.Tokens):
    """Texts split, and the ids of their segments kept, as for token files; new
    segments go through the rank file, together in one string."""

    def __init__(self, encoding, ranks: dict[bytes, int]):
        self.encoding, self.width, self.later = encoding, 4, {}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return list(map(self.encoding.encode_ordinary, texts))


_TOKENS: dict[str, Tokens] = {}


def _tokenise(vocabulary: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        if vocabulary not in _TOKENS:
            _TOKENS[vocabulary] = Tokens(vocabulary)
        tokens = _TOKENS[vocabulary]
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [own + end for own in tokens.encode_all(batch.column("text").to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), part, np.int64)), pa.array(first), pa.array(n), pa.array(ids, pa.binary())],
                ["doc_id", "part", "first", "n", "ids"],
            )

    return run


def tokenise(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, first, n, ids): ids with the end mark, and the place in the partition."""
    key = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    return texts.mapInArrow(_tokenise(vocabulary, end_id), f"doc_id {key}, part long, first long, n long, ids binary")


def _windows(length: int, key: pa.DataType):
    kind = pa.struct([("doc_id", key), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
    names = ["sequence_id", "first", "whole", "ids", "pieces"]

    def run(batches):
        done: list[tuple] = []
        window, first, fill, held, pieces = -1, 0, 0, [], []

        def close():
            if held:
                done.append((window, first, first == 0 and fill == length, b"".join(held), pieces))

        def batch_of():
            out = pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.bool_()),
                 pa.array([d[3] for d in done], pa.binary()), pa.array([d[4] for d in done], pa.list_(kind))], names)
            done.clear()
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "begin", "n", "ids")]
            for doc_id, begin, n, ids in zip(*columns, strict=True):
                at = 0
                while at < n:
                    sequence, offset = divmod(begin + at, length)
                    take = min(n - at, length - offset)
                    if sequence != window or offset != fill:
                        close()
                        window, first, fill, held, pieces = sequence, offset, offset, [], []
                    held.append(ids[4 * at : 4 * (at + take)])
                    pieces.append({"doc_id": doc_id, "start": at, "length": take, "doc_tokens": n, "offset": offset})
                    fill, at = fill + take, at + take
                    if fill == length:
                        close()
                        window, held, pieces = -1, [], []
                if len(done) >= 1000:
                    yield batch_of()
        close()
        yield batch_of()

    return run


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, pieces, n_tokens, padded_length), one row per sequence.

    ids: little-endian uint32; pieces: array<struct<doc_id, start, length,
    doc_tokens, offset>> in order of offset."""
    tokens = work_table(tokenise(docs, vocabulary, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per task of the first pass; written, so Spark broadcasts it by its known size
    places = work_table(totals.select(F.col("part").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("place")), "places")
    run = tokens.join(places, F.col("part") == F.col("of")).select("doc_id", (F.col("place") + F.col("first")).alias("begin"), "n", "ids")
    key = docs.schema["doc_id"].dataType
    piece = PIECE.format(key=key.simpleString())
    found = run.mapInArrow(_windows(length, to_arrow_type(key)), f"sequence_id long, first long, whole boolean, ids binary, pieces array<{piece}>")
    found = work_table(found, "windows")
    whole = found.where("whole").select("sequence_id", "ids", "pieces")
    # boundary records: at most `length` of a window, put together by their offsets
    parts = found.where("not whole").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("first", "ids", "pieces"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    parts = parts.select("sequence_id", joined.alias("ids"), F.flatten(F.transform("parts", lambda p: p["pieces"])).alias("pieces"))
    n = (F.octet_length("ids") / 4).cast("long")
    out = whole.unionByName(parts).withColumn("n_tokens", n)
    power_of_two = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return out.withColumn("padded_length", F.when(power_of_two, F.col("n_tokens")).otherwise(F.lit(length)))


def pieces(sequences: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece."""
    out = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    ids = F.substring("ids", F.col("p.offset").cast("int") * 4 + 1, F.col("p.length").cast("int") * 4)
    return out.select(
        "p.doc_id", "p.start", "p.length", F.crc32(ids).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset"
    )
