"""Repeated passages by external induced sorting of sampled suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else
is removed. Not all suffixes are sorted, only those at anchors: positions that
the content itself picks, one at least in each window (``induction``), so that
two copies of a window have their anchors at the same place. Suffix tuples
(hash of the anchor's bytes, document, position) are first reduced: anchors
whose bytes occur once are dropped, and anchors with equal surroundings become
one class; all windows of a class of two or more are repeats. What is left,
the ends of copied passages, is sorted by Spark's external sort (its spill
files are merged by a priority queue) and resolved by induction: the order and
common-prefix lengths of the suffixes at the anchors give those of the suffixes
one byte before, and so on. A window is a repeat where a neighbour shares
LENGTH bytes. Groups of more than CROWDED different surroundings (a passage
that very many texts share) are resolved by blocks of windows instead, by
counts that collapse within each task; the result is the same.

Defined cases: a NULL text is empty; texts shorter than LENGTH keep everything;
repeated rows are copies of each other; an empty table gives an empty result;
other columns are ignored. Positions are bytes of UTF-8.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import row_ranges, text_bytes
from .common import text_or_empty, work_table
from .induction import LENGTH, induced_repeats, runs

CROWDED = 256  # different surroundings of one anchor that a task resolves by induction
SLICE = 2 << 20  # bytes that a task handles at a time
ROWS = 20_000  # contexts that a task resolves at a time


def _step(df: DataFrame, name: str) -> DataFrame:
    """A written table, after which the shuffle files of the step are let go (Spark
    removes them once the driver's garbage collector has seen their plan)."""
    out = work_table(df, f"suffix-{name}")
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


# -- anchors ---------------------------------------------------------------
def text_runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``runs`` of texts in slices: (text, hash, anchor, first, last), positions
    within the text. A long text is cut into slices that overlap by LENGTH - 1."""
    for a, b in row_ranges(offsets, SLICE):
        start, end = int(offsets[a]), int(offsets[b])
        if end - start <= SLICE:
            text, h, anchor, first, last = runs(data[start:end], offsets[a : b + 1] - start)
            base = offsets[a:b][text] - start
            yield text + a, h, anchor - base, first - base, last - base
            continue
        for at in range(start, end - LENGTH + 1, SLICE):
            part = data[at : min(end, at + SLICE + LENGTH - 1)]
            text, h, anchor, first, last = runs(part, np.array([0, len(part)]))
            moved = at - start
            yield text + a, h, anchor + moved, first + moved, last + moved


def _anchors(batches: Iterator[pa.RecordBatch]):
    """Rows (hash, context, row, place): place packs the anchor's position and how
    many bytes before it the first and the last of its windows start."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        rows = batch.column("row").to_numpy(zero_copy_only=False)
        raw = memoryview(data)
        for text, h, anchor, first, last in text_runs(data, offsets):
            base = offsets[text]
            digest = xxhash.xxh3_64_intdigest
            contexts = [digest(raw[a:b]) for a, b in zip((base + first).tolist(), (base + last + LENGTH).tolist(), strict=True)]
            place = (anchor << 16) | ((anchor - first) << 8) | (anchor - last)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(np.array(contexts, np.uint64).view(np.int64)), pa.array(rows[text]), pa.array(place)],
                ["hash", "context", "row", "place"])


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, longest, shortest distance of a window's start before it)."""
    return place >> 16, (place >> 8) & 255, place & 255


# -- ends of passages ------------------------------------------------------
def _contexts(batches: Iterator[pa.RecordBatch]):
    """The bytes around each open anchor of a text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        raw = data.tobytes()
        columns: list[list] = [[], [], [], [], [], []]
        for k, (row, found) in enumerate(zip(batch.column("row").to_pylist(), batch.column("open").to_pylist(), strict=True)):
            base = int(offsets[k])
            for x in found:
                at, longest, shortest = x["place"] >> 16, x["place"] >> 8 & 255, x["place"] & 255
                bytes_ = raw[base + at - longest : base + at - shortest + LENGTH]
                for column, value in zip(columns, (x["hash"], x["k"], x["single"], row, x["place"], bytes_), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["hash", "k", "single", "row", "place", "bytes"])


def _stretches(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of consecutive numbers."""
    if not len(starts):
        return []
    starts = np.sort(starts)
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist(), strict=True))


def _resolve(batches: Iterator[pa.RecordBatch]):
    """Rows (row, first, last) of repeated windows; input sorted by hash."""

    def done(part: pa.Table):
        hashes, place = part["hash"].to_numpy(), part["place"].to_numpy()
        at, longest, shortest = _unpack(place)
        group = np.cumsum(np.r_[0, np.diff(hashes) != 0])
        found = induced_repeats(group, part["bytes"].to_pylist(), longest, shortest)
        out = []
        for single, row, position, windows in zip(part["single"].to_pylist(), part["row"].to_pylist(), at.tolist(), found, strict=True):
            if single:
                out += [(row, a, b) for a, b in _stretches(position - np.flatnonzero(windows))]
        rows = np.array(out, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["row", "first", "last"])

    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if len(held) >= ROWS:
            hashes = held["hash"].to_numpy()
            full = int(np.searchsorted(hashes, hashes[-1]))  # the last group may go on
            if full:
                yield done(held.slice(0, full))
                held = held.slice(full)
    if held is not None and len(held):
        yield done(held)


# -- crowded anchors -------------------------------------------------------
PART = "row long, at long, low long, high long, single boolean, bytes binary, core binary, whole binary"
WIDTHS = (43, 11, 3, 1)  # distances of a block in each round; the first round has SPREAD / 43 blocks


def _parts(width: int):
    """The windows of each context, dealt to blocks of ``width`` distances.

    core: digest of the bytes that all windows of the block have in common;
    whole: digest of the bytes that the context's own windows of it cover."""

    def run(batches: Iterator[pa.RecordBatch]):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("row", "at", "low", "high", "single", "bytes")]
            for row, at, low, high, single, raw in zip(*columns, strict=True):
                for start in range(low - low % width, high + 1, width):
                    first, last = max(low, start), min(high, start + width - 1)
                    own = raw[high - last : high - first + LENGTH]
                    core = raw[high - start : high - start - width + 1 + LENGTH]
                    out.append((row, at, first, last, single, own, digest(core), digest(own)))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = (*[pa.int64()] * 4, pa.bool_(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["row", "at", "low", "high", "single", "bytes", "core", "whole"])

    return run


def resolve_crowded(open_: DataFrame) -> DataFrame:
    """(row, first, last) of repeated windows of contexts (row, at, low, high, single,
    bytes): block by block, with finer blocks where that leaves it open.

    Two that agree in a block's whole bytes repeat all its windows; one that
    shares the core with no other repeats none of them. Of equal parts one goes
    on as evidence for others with the same core. Counts collapse within each
    task, so one passage in very many texts never meets in one."""
    found = []
    for width in WIDTHS:
        parts = work_table(open_.mapInArrow(_parts(width), PART), "suffix-parts")
        one = F.min(F.struct("row", "at", "low", "high", "single", "bytes")).alias("one")
        classes = work_table(parts.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), one), "suffix-part-classes")
        twice = classes.where("n > 1").select(F.col("core").alias("c"), F.col("whole").alias("w"))
        same = parts.where("single").join(work_table(twice, "suffix-part-repeats"), (F.col("core") == F.col("c")) & (F.col("whole") == F.col("w")), "left_semi")
        found.append(same.select("row", (F.col("at") - F.col("high")).alias("first"), (F.col("at") - F.col("low")).alias("last")))
        shared = classes.groupBy(F.col("core").alias("c")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("c")
        shared = work_table(shared, "suffix-part-cores")
        if shared.isEmpty():
            break
        rest = classes.join(shared, F.col("core") == F.col("c"), "left_semi")
        open_ = rest.select("one.row", "one.at", "one.low", "one.high", (F.col("one.single") & (F.col("n") == 1)).alias("single"), "one.bytes")
    return reduce(DataFrame.union, found)


# -- removal ---------------------------------------------------------------
def _remove(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        out, kept_texts = [], []
        columns = [batch.column(c).to_pylist() for c in ("shared", "open", "ends")]
        for k, (shared, open_, ends) in enumerate(zip(*columns, strict=True)):
            text = data[offsets[k] : offsets[k + 1]]
            edge = np.zeros(len(text) + 1, np.int64)
            at, longest, shortest = _unpack(np.setdiff1d(np.array(shared or [], np.int64), np.array(open_ or [], np.int64)))
            ends = np.array([(e["first"], e["last"]) for e in ends or []], np.int64).reshape(-1, 2)
            np.add.at(edge, np.r_[at - longest, ends[:, 0]], 1)
            np.add.at(edge, np.r_[at - shortest, ends[:, 1]] + LENGTH, -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept = text[~gone].tobytes()
            spans = int(gone[:1].sum()) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            kept_texts.append(kept)
        n, removed, spans, sha = list(zip(*out, strict=True)) or ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_texts, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per document;
    ``kept`` holds the bytes that stay."""
    texts = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row"))
    texts = _step(texts, "texts")
    anchors = texts.select("row", "text").mapInArrow(_anchors, "hash long, context long, row long, place long")
    often = anchors.groupBy(F.col("hash").alias("of")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("of")
    often = _step(often, "shared-hashes")
    shared = _step(anchors.join(often, F.col("hash") == F.col("of"), "left_semi"), "shared-anchors")
    one = F.min(F.struct("row", "place")).alias("one")
    classes = _step(shared.groupBy("hash", "context").agg(F.count(F.lit(1)).alias("n"), one), "classes")
    # a class of one may hold repeats where its anchor has other surroundings too
    groups = classes.groupBy(F.col("hash").alias("of")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    groups = _step(groups.where("k > 1 AND least = 1").select("of", "k"), "groups")
    work = classes.join(groups, F.col("hash") == F.col("of"))
    work = work.select(F.col("one.row").alias("at_row"), F.struct("hash", "k", (F.col("n") == 1).alias("single"), F.col("one.place").alias("place")).alias("x"))
    work = work.groupBy("at_row").agg(F.collect_list("x").alias("open"))
    found = texts.select("row", "text").join(work, F.col("row") == F.col("at_row")).select("row", "text", "open")
    contexts = found.mapInArrow(_contexts, "hash long, k long, single boolean, row long, place long, bytes binary")
    contexts = _step(contexts, "contexts")
    some = contexts.where(F.col("k") <= crowded).repartition("hash").sortWithinPartitions("hash")
    ends = some.mapInArrow(_resolve, "row long, first long, last long")
    place = F.col("place")
    many = contexts.where(F.col("k") > crowded).select(
        "row", F.shiftright(place, 16).alias("at"), place.bitwiseAND(255).alias("low"),
        F.shiftright(place, 8).bitwiseAND(255).alias("high"), "single", "bytes",
    )
    ends = _step(ends.union(resolve_crowded(many)), "ends")

    by_row = lambda df, value, name: df.groupBy(F.col("row").alias(f"{name}_row")).agg(F.collect_list(value).alias(name))
    open_ = classes.where("n = 1").select(F.col("one.row").alias("row"), F.col("one.place").alias("place"))
    out = texts
    for part in (by_row(shared, F.col("place"), "shared"), by_row(open_, F.col("place"), "open"), by_row(ends, F.struct("first", "last"), "ends")):
        key = part.columns[0]
        out = out.join(part, F.col("row") == F.col(key), "left").drop(key)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return out.select("doc_id", "text", "shared", "open", "ends").mapInArrow(_remove, schema)
