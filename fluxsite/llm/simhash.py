"""SimHash near-duplicates by segment popcounts.

A fingerprint is mapped to the bit counts of its sixteen 4-bit segments. The
Manhattan distance of two such vectors is at most their bit distance, so a
range join over the integer grid of these counts finds every linked pair: of 3
differing bits, one half of the fingerprint holds at most 1, so in one half the
counts are equal or differ by one in one segment. Every distinct fingerprint is
at home in one grid cell per half and a guest in the cells one count below;
pairs of a cell are checked by the bound and then bit by bit. A cell of many
fingerprints is dealt out as pairs of blocks, and a task returns the spanning
links of its pairs only. Components come from those links.

Defined cases: a NULL, empty or blank text has fingerprint zero, linked like
any other; fewer words than a shingle are one shingle; repeated rows share a
fingerprint; the component id is the smallest doc_id (NULL only if all are); an
empty table gives an empty result; other columns are ignored by
``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import text_bytes
from .common import rows_named, text_or_empty, work_table
from .components import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
BLOCK = 2048  # fingerprints of a cell that one task pairs with as many others


# -- fingerprints ----------------------------------------------------------
def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 majority bits over the XXH64 of all word shingles (A-Z lower-cased)."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *[e + 1 for e in ends[: len(ends) - shingle]]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    hashes = np.array(hashes, dtype="<u8")
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_ += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_ > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            prints = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            hashes = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints, pa.int64()), pa.array(hashes, pa.string())], ["doc_id", "fp", "sha"]
            )

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, sha): fingerprint as a signed 64-bit integer, SHA-256 of the text."""
    key = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    return texts.mapInArrow(_fingerprints(shingle), f"doc_id {key}, fp long, sha string")


# -- grid cells ------------------------------------------------------------
def segment_counts(prints: np.ndarray) -> np.ndarray:
    """Bits set in each of the sixteen 4-bit segments, one row per fingerprint."""
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    segments = (prints[:, None] >> shifts) & np.uint64(15)
    return np.bitwise_count(segments).astype(np.int8)


def levels(prints: np.ndarray) -> np.ndarray:
    """Each segment's count c as c low bits of its four: the bits in which two
    fingerprints' levels differ number the Manhattan distance of their counts."""
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    ones = (np.uint64(1) << segment_counts(prints).astype(np.uint64)) - np.uint64(1)
    return np.bitwise_or.reduce(ones << shifts, axis=1)


def _cells(batches: Iterator[pa.RecordBatch]):
    """Rows (cell, fp, home): per half, the home cell and the cells one count below."""
    place = 5 ** np.arange(8, dtype=np.int64)
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        counts = segment_counts(prints).astype(np.int64)
        for half in (0, 1):
            own = counts[:, 8 * half : 8 * half + 8]
            home = own @ place + half * 5**8
            rows, segments = np.nonzero(own)
            cell = np.concatenate([home, home[rows] - place[segments]])
            fp = np.concatenate([prints, prints[rows]]).view(np.int64)
            at_home = np.arange(len(cell)) < len(home)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp), pa.array(at_home)], ["cell", "fp", "home"])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node reachable from each of n nodes over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    return label


def _links_of(homes: np.ndarray, visitors: np.ndarray, at_home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs home x visitor within ``max_bits``."""
    nodes, inverse = np.unique(np.concatenate([homes, visitors]), return_inverse=True)
    home_at, visitor_at = inverse[: len(homes)], inverse[len(homes) :]
    home_levels, visitor_levels = levels(homes), levels(visitors)
    left, right = [], []
    step = max(1, (1 << 19) // max(1, len(visitors)))
    for k in range(0, len(homes), step):
        own = homes[k : k + step]
        # the bound over all segments: the distance of the counts is at most that of the bits
        near = np.bitwise_count(home_levels[k : k + step, None] ^ visitor_levels[None, :]) <= max_bits
        # two that are both at home meet twice
        i, j = np.nonzero(near & (~at_home[None, :] | (own[:, None] < visitors[None, :])))
        linked = np.bitwise_count(own[i] ^ visitors[j]) <= max_bits
        i, j = i[linked], j[linked]
        left.append(home_at[k + i])
        right.append(visitor_at[j])
    a, b = np.concatenate(left), np.concatenate(right)
    label = spanning(len(nodes), a, b)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _links(max_bits: int):
    def group(columns: list[np.ndarray]):
        _, _, _, fp, role = columns
        prints = fp.view(np.uint64)
        visitor = role > 0
        return _links_of(prints[role % 2 == 0], prints[visitor], role[visitor] > 1, max_bits)

    def run(batches: Iterator[pa.RecordBatch]):
        # rows come sorted by (cell, i, j); role 0: at home, 1: a guest, 2: at home and
        # its own visitor, 3: at home here but a visitor of this block pair
        held: list[np.ndarray] = []
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "i", "j", "fp", "role")]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            last = np.flatnonzero(np.any([np.diff(x) != 0 for x in held[:3]], axis=0)) + 1
            if len(last):
                yield from done([x[: last[-1]] for x in held], last[:-1])
                held = [x[last[-1] :] for x in held]
        if held and len(held[0]):
            yield from done(held, np.zeros(0, int))

    def done(columns, bounds):
        found = [group(part) for part in zip(*[np.split(x, bounds) for x in columns], strict=True) if (part[4] % 2 == 0).any() and (part[4] > 0).any()]
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column ``fp``)."""
    if max_bits > 3:
        raise ValueError("two halves with one count apart cover at most 3 differing bits")
    cells = work_table(prints.mapInArrow(_cells, "cell long, fp long, home boolean"), "cells")
    size = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("lived_in")).where("lived_in")
    crowded = work_table(
        size.where(F.col("n") > block).select(F.col("cell").alias("of"), F.ceil(F.col("n") / block).cast("int").alias("k")), "crowded"
    )
    rows = cells.join(crowded, F.col("cell") == F.col("of"), "left")
    k = F.coalesce(F.col("k"), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), k).cast("int")
    every = F.sequence(F.lit(0), k - 1)
    # home block i meets visitor block j in (i, j); an uncrowded cell is (0, 0)
    place = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    as_home = F.transform(every, lambda x: place(own, x, 0))
    as_visitor = lambda role: F.transform(every, lambda x: place(x, own, role))
    both = F.array(place(F.lit(0), F.lit(0), 2))
    guest = F.transform(every, lambda x: place(x, own, 1))
    at = F.when(~F.col("home"), guest).when(k == 1, both).otherwise(F.concat(as_home, as_visitor(3)))
    rows = rows.select("cell", "fp", F.explode(at).alias("at")).select("cell", "at.i", "at.j", "fp", "at.role")
    rows = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return rows.mapInArrow(_links(max_bits), "a long, b long")


# -- components ------------------------------------------------------------
def classes(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id, keep_sha) of every distinct fingerprint of rows (doc_id,
    fp, sha); keep_sha tells the row of the smallest doc_id by its text."""
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "sha"))).alias("first")
    other = F.min(F.struct("doc_id", "sha")).alias("other")
    prints = rows.groupBy("fp").agg(first, other)
    prints = work_table(prints.select("fp", F.coalesce("first", "other").alias("first")), "fingerprints")
    roots = work_table(components(links(prints.select("fp"), max_bits)), "roots")
    nodes = prints.join(roots, F.col("fp") == F.col("node"), "left")
    nodes = work_table(nodes.select("fp", "first", F.coalesce("root", "fp").alias("root")), "nodes")
    named = nodes.groupBy(F.col("root").alias("of")).agg(F.min(F.when(F.col("first.doc_id").isNotNull(), F.col("first"))).alias("a"), F.min("first").alias("b"))
    named = work_table(named.select("of", F.coalesce("a", "b").alias("keep")), "classes")
    out = nodes.join(named, F.col("root") == F.col("of"))
    return work_table(out.select(F.col("fp").alias("of"), F.col("keep.doc_id").alias("component_id"), F.col("keep.sha").alias("keep_sha")), "class-ids")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id, sha, keep_sha), one row per document."""
    rows = work_table(fingerprints(docs, shingle), "simhash")
    out = rows.join(classes(rows, max_bits), F.col("fp") == F.col("of"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "sha", "keep_sha")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, that of the smallest doc_id; same columns as ``docs``."""
    rows = near_duplicates(docs, shingle, max_bits)
    stay = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("sha") == F.col("keep_sha")))
    return rows_named(docs, work_table(stay.select("doc_id", "sha"), "kept-texts"))
