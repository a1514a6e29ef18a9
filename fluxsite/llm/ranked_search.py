"""Ranked lexical search: term at a time with limited accumulators, exact.

The documents are searched in shards of their own index. In a shard an item's terms
are taken rarest first. A posting adds its impact to the accumulator of its document,
or opens one. Once the largest impacts of the terms still to come, added up, stay
below the k-th best partial score, no document without an accumulator can enter the
result any more: from then on no accumulator is opened, and those that exist are
brought to their full scores. The k-th score that a task has reached in one shard
is the start of its next one. The shards' best are then ranked together.

Only terms of the items are indexed. Items are taken in blocks of a bounded number of
items and terms, and each block passes over the whole texts. Tasks hold the postings
of a bounded number of documents; nothing about documents comes to the driver but the
counts of a block's terms.

Defined cases: NULL and empty texts have no term; a repeated row is a document of its
own; rows that share an item_id are one item with the terms of all; items without
terms, or whose terms no document holds, have no rows; a document without id comes
after others of its score; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import send_package, text_or_empty, work_table

TOP = 50
WEIGHT = 1 << 18  # of a block's items together: their terms, and ITEM for each
ITEM = 64
POSTINGS = 1 << 22  # of a shard, about
SLICE = 1 << 22  # bytes of a text that are split at a time

# Bytes of terms: digits, letters in lower case, and all that is not ASCII.
_TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_in(text: str) -> Iterator[list[bytes]]:
    """All terms of a text, in slices of a bounded size."""
    raw = text.encode().translate(_TERM_BYTES)
    at = 0
    while len(raw) - at > SLICE:
        cut = raw.find(b" ", at + SLICE)
        if cut < 0:
            break
        yield raw[at:cut].split()
        at = cut
    yield raw[at:].split()


# -- items -------------------------------------------------------------------
def _item_terms(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        found = [sorted({t for part in terms_in(text) for t in part}) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])


def _weighed(batches: Iterator[pa.RecordBatch]):
    """Adds the task and the weight of its items before each: its terms and ``ITEM``."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        weights = ITEM + batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        before = at + np.cumsum(weights) - weights
        at += int(weights.sum())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(batch), part, np.int64)), pa.array(before), pa.array(weights)], [*batch.schema.names, "part", "before", "weight"])


def item_blocks(items: DataFrame, most: int = WEIGHT) -> DataFrame:
    """(item_id, terms, block) of the items that have terms. A block's items weigh
    ``most`` at most, but for the last of them."""
    key = items.schema["item_id"].dataType.simpleString()
    texts = items.select("item_id", text_or_empty(F.col("text")).alias("text"))
    terms = texts.mapInArrow(_item_terms, f"item_id {key}, terms array<binary>")
    terms = terms.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    run = work_table(terms.mapInArrow(_weighed, f"item_id {key}, terms array<binary>, part long, before long, weight long"), "items")
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    places = run.groupBy(F.col("part").alias("of")).agg(F.sum("weight").alias("total"))
    places = places.select("of", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("place"))
    dealt = run.join(places, F.col("part") == F.col("of")).withColumn("block", F.floor((F.col("place") + F.col("before")) / most))
    return work_table(dealt.select("item_id", "terms", "block"), "item-blocks")


# -- index -------------------------------------------------------------------
def _forward(vocabulary: dict[bytes, int]):
    """(doc_id, n, terms, times): the length of each document and its terms of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ends, lengths, terms, times = [0], [], [], []
            for text in batch.column("text").to_pylist():
                n, found = 0, Counter()
                for part in terms_in(text):
                    n += len(part)
                    found.update(map(vocabulary.get, part))
                found.pop(None, None)
                terms.extend(found)
                times.extend(found.values())
                ends.append(len(terms))
                lengths.append(n)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, kind)) for c, kind in ((terms, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    return run


def _frequencies(size: int):
    """(term, df) of a task."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["term", "df"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def lengths_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 50 + (50 * n * N) div L of each document of n terms."""
    if len(n) and 50 * int(n.max()) * documents >= 1 << 63:
        return np.array([50 + 50 * int(x) * documents // total for x in n], np.int64)
    return 50 + 50 * n * documents // total


class Shard:
    """Postings of some documents: by term, the rows of its documents and their impacts."""

    def __init__(self, terms: np.ndarray, times: np.ndarray, sizes: np.ndarray, norms: np.ndarray, weights: np.ndarray):
        self.rows = len(sizes)
        of = np.repeat(np.arange(self.rows, dtype=np.int32), sizes)
        order = np.argsort(terms, kind="stable")
        terms, times, self.docs = terms[order], times[order], of[order]
        self.impacts = weights[terms] * (1_000_000_000 * times // (1000 * times + 20 * norms[self.docs]))
        self.held, self.begins = np.unique(terms, return_index=True)
        self.ends = np.append(self.begins[1:], len(terms))
        self.most = np.maximum.reduceat(self.impacts, self.begins) if len(terms) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the documents that can be among the k best, given that k
        others score ``least`` or more. ``terms``: rarest first."""
        places = np.searchsorted(self.held, terms)
        places = places[np.append(self.held, -1)[places] == terms]  # those that the shard holds
        left = np.cumsum(self.most[places][::-1])[::-1]  # the most that the terms from here on can add
        scores, kth, opening = np.zeros(self.rows, np.int64), least, True
        for place, most in zip(places.tolist(), left.tolist(), strict=True):
            docs, impacts = self.docs[self.begins[place] : self.ends[place]], self.impacts[self.begins[place] : self.ends[place]]
            if opening and scores.max() > most:  # else the k-th cannot be above it either
                kth = max(kth, kth_best(scores[scores > 0], k))
            if opening and most < kth:
                opening = False
            if opening:
                scores[docs] += impacts
            else:
                open_ = scores[docs] > 0
                scores[docs[open_]] += impacts[open_]
        kth = max(least, kth_best(scores[scores > 0], k), 1)
        rows = np.flatnonzero(scores >= kth)
        return rows, scores[rows]


def kth_best(scores: np.ndarray, k: int) -> int:
    """The k-th largest score; 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


class Best:
    """An item's best documents so far."""

    def __init__(self):
        self.scores, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> None:
        scores, ids, missing = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.missing, missing)
        order = np.lexsort((ids, missing, -scores))[:k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]

    def least(self, k: int) -> int:
        return int(self.scores[-1]) if len(self.scores) == k else 0


def _search(items: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int, postings: int):
    def run(batches: Iterator[pa.RecordBatch]):
        best = [Best() for _ in items]

        def visit(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, lists = table["doc_id"].combine_chunks(), table["terms"].combine_chunks()
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            norms = lengths_norm(table["n"].to_numpy(), documents, total)
            shard = Shard(lists.flatten().to_numpy(zero_copy_only=False), table["times"].combine_chunks().flatten().to_numpy(zero_copy_only=False), sizes, norms, weights)
            for terms, found in zip(items, best, strict=True):
                rows, scores = shard.search(terms, k, found.least(k))
                found.add(scores, ids[rows], missing[rows], k)

        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += len(batch.column("terms").flatten()) + len(batch)
            if size >= postings:
                visit(held)
                held, size = [], 0
        if held:
            visit(held)
        of = np.repeat(np.arange(len(items)), [len(b.scores) for b in best])
        columns = [pa.array(np.concatenate([getattr(b, name) for b in best] or [[]])) for name in ("ids", "scores")]
        missing = np.concatenate([b.missing for b in best])
        ids = pa.array(np.concatenate([b.ids for b in best]), pa.int64(), mask=missing)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), ids, columns[1]], ["item", "doc_id", "score"])

    return run


def search_block(docs: DataFrame, items: list, k: int = TOP, postings: int = POSTINGS) -> DataFrame:
    """(item, doc_id, score): for each item (a row with ``terms``) of a bounded list the
    best documents of every task, its k best overall among them. ``item``: its place in the list."""
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for row in items for t in row.terms}))}
    forward = work_table(docs.mapInArrow(_forward(vocabulary), "doc_id long, n long, terms array<int>, times array<long>"), "forward")
    facts = forward.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    # at most one row per term of the block
    counts = forward.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(len(vocabulary), np.int64)
    for row in counts:
        df[row.term] = row.df
    weights = np.array([weight(facts.documents, int(n)) for n in df], np.int64)
    rarest = []
    for row in items:
        terms = np.array([vocabulary[bytes(t)] for t in row.terms], np.int32)
        terms = terms[df[terms] > 0]
        rarest.append(terms[np.lexsort((terms, df[terms]))])
    return forward.where("n > 0").mapInArrow(_search(rarest, weights, facts.documents, facts.total, k, postings), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    send_package(spark)
    key = items.schema["item_id"].dataType
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    blocks = item_blocks(items)
    found = spark.createDataFrame([], f"item_id {key.simpleString()}, doc_id long, score long")
    for block in blocks.select("block").distinct().orderBy("block").collect():  # one row per WEIGHT of the items
        rows = blocks.where(F.col("block") == block.block).collect()  # bounded by WEIGHT
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"of long, item_id {key.simpleString()}")
        ranked = work_table(search_block(texts, rows, k, postings), "ranked")
        found = found.unionByName(ranked.join(names, F.col("item") == F.col("of")).select("item_id", "doc_id", "score"))
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
