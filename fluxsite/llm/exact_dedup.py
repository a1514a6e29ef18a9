"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes says so, which makes the
chunks of equal passages equal. Every chunk is moved at most once per task and
digest to prove that equal digests mean equal bytes; a digest that passes is a
verified identifier. A document is then the ordered list of its chunk
identifiers (its recipe), and only recipes are grouped and joined. Should a
digest ever stand for two different chunks, the next one is taken; the last is
the chunk itself.

Defined cases: a NULL text equals the empty text; of equal texts the row with
the largest doc_id stays (NULL doc_id last, and one row of those that tie);
repeated rows count as rows of their group; an empty table gives an empty
result; other columns are ignored by ``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import row_ranges, string_list, text_bytes
from .common import rows_named, text_or_empty, work_table

MIN_CHUNK, MAX_CHUNK = 512, 16384
CUT_BITS = 11  # a cut every 2048 bytes beyond the minimum, on average
SLICE = 4 << 20  # bytes that a task handles at a time

DIGESTS: tuple[Callable[[bytes], bytes], ...] = (
    lambda b: xxhash.xxh3_128_digest(b),
    lambda b: hashlib.sha256(b).digest(),
    lambda b: b,
)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the 16 bytes before asks for a cut; worked out
    for ``SLICE`` bytes at a time, as it takes many times their memory."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(data), SLICE):
        first = max(0, at - 15)
        cuts = first + _slice_cuts(data[first : at + SLICE])
        found.append(cuts[cuts > at])
    return np.concatenate(found)


def _slice_cuts(data: np.ndarray) -> np.ndarray:
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    factor, width = 0x85EBCA6B, 1
    while width < 16:
        grown = h.copy()
        grown[width:] += h[:-width] * np.uint32(factor)
        h, factor, width = grown, factor * factor & 0xFFFFFFFF, 2 * width
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_ends(cuts: np.ndarray, start: int, end: int) -> list[int]:
    """Chunk ends of the text at [start, end): a cut counts from MIN_CHUNK bytes
    on (so its hash never reaches back into another text or chunk), and a chunk
    ends at MAX_CHUNK bytes at the latest."""
    ends, at = [], start
    while end - at > MIN_CHUNK:
        k = np.searchsorted(cuts, at + MIN_CHUNK)
        cut = min(int(cuts[k]) if k < len(cuts) else end, at + MAX_CHUNK, end)
        ends.append(cut)
        at = cut
    if at < end:
        ends.append(end)
    return ends


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(row, chunks) of each text of a column."""
    data, offsets = text_bytes(column)
    for first, last in row_ranges(offsets, SLICE):
        base, part = int(offsets[first]), data[offsets[first] : offsets[last]]
        cuts, raw = cut_points(part), part.tobytes()
        for row in range(first, last):
            at, chunks = int(offsets[row]) - base, []
            for end in chunk_ends(cuts, at, int(offsets[row + 1]) - base):
                chunks.append(raw[at:end])
                at = end
            yield row, chunks


def _recipes(digest):
    def run(batches):
        for batch in batches:
            recipes, hashes = [], []
            for _, chunks in _chunks(batch.column("text")):
                whole = hashlib.sha256()
                for c in chunks:
                    whole.update(c)
                recipes.append([digest(c) for c in chunks])
                hashes.append(whole.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), string_list(recipes), pa.array(hashes, pa.string())], ["doc_id", "recipe", "sha"]
            )

    return run


def _chunk_rows(digest):
    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for _, chunks in _chunks(batch.column("text")):
                rows += chunks
                held += sum(map(len, chunks))
                if held > SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(map(digest, rows), pa.binary()), pa.array(rows, pa.binary())], ["digest", "chunk"])
                    rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, rows), pa.binary()), pa.array(rows, pa.binary())], ["digest", "chunk"])

    return run


def verified(texts: DataFrame, digest) -> bool:
    """True if no digest stands for two different chunks. Equal chunks collapse
    within each task before they move."""
    chunks = texts.mapInArrow(_chunk_rows(digest), "digest binary, chunk binary")
    distinct = chunks.groupBy("digest", "chunk").agg(F.count(F.lit(1)).alias("n"))
    per_digest = distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return (per_digest.agg(F.max("n")).first()[0] or 0) <= 1


def groups(docs: DataFrame, digests=DIGESTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document."""
    texts = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    digest = next((d for d in digests[:-1] if verified(texts, d)), digests[-1])
    key = docs.schema["doc_id"].dataType.simpleString()
    recipes = texts.mapInArrow(_recipes(digest), f"doc_id {key}, recipe array<binary>, sha string")
    recipes = work_table(recipes.withColumn("row", F.monotonically_increasing_id()), "recipes")
    best = F.max(F.struct(F.col("doc_id").alias("id"), F.col("row").alias("row")))
    found = recipes.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    found = work_table(found.select(F.col("recipe").alias("of"), "best", "group_size"), "recipe-groups")
    out = recipes.join(found, F.col("recipe") == F.col("of"))
    return out.select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, same columns. Rows equal in doc_id and text are one."""
    stay = groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("sha"))
    return rows_named(docs, work_table(stay, "kept-texts"))
