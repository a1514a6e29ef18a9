"""Exact top-k inner products by a pivot-distance index.

Vectors get one more coordinate that gives them all the same length, so the
largest inner products with a query are its nearest vectors. Each vector is
indexed under its nearest pivot by its distance to it, in sorted blocks: a
block is an annulus around its pivot. A query first expands the annuli nearest
to it until they hold k vectors; the k-th best score of these is its bound.
Then it visits the annuli that the triangle inequality can't exclude, and no
others. The queries of an annulus that many visit are dealt out by hash to groups,
each with its own copy of the annulus. Scores are integer; the distances only decide what is skipped, with a
margin above their rounding error.

Vectors whose squared length reaches 2**63 are refused: a score could pass 64 bits.

Defined cases: vectors that are NULL or hold NULL or non-finite components take
no part, nor do rows without id; of rows with one id the largest vector counts;
shorter vectors count as filled up with zeros; fewer candidates than k are all
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import work_table

PIVOTS = 64  # fitted on that many vectors (those of smallest hash); every vector is indexed
BLOCK = 1024  # vectors of an annulus, more once the blocks would pass MAX_BLOCKS
MAX_BLOCKS = 1 << 16  # bounds the table of annuli that every task gets: about 3 MB
VISITS = 1024  # queries that meet an annulus in one group, about; more of them share it out
MARGIN = 1e-6


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:  # every partial sum is an exact double
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _lengthened(squares: np.ndarray, most: float) -> np.ndarray:
    """The coordinate that brings vectors of these squared lengths to ``most``."""
    return np.sqrt(np.maximum(0.0, most - squares))


class Pivots:
    def __init__(self, vectors: np.ndarray, most: float):
        self.vectors, self.most = vectors.astype(np.float64), most
        self.extra = _lengthened((self.vectors**2).sum(axis=1), most)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, distance) of each indexed vector."""
        x = x.astype(np.float64)
        extra = _lengthened((x**2).sum(axis=1), self.most)
        square = 2 * self.most - 2 * (x @ self.vectors.T) - 2 * extra[:, None] * self.extra[None, :]
        pivot = square.argmin(axis=1)
        return pivot, np.sqrt(np.maximum(0.0, square[np.arange(len(x)), pivot]))

    def from_queries(self, q: np.ndarray) -> np.ndarray:
        """Distance of each query (added coordinate 0) to each pivot."""
        q = q.astype(np.float64)
        square = (q**2).sum(axis=1)[:, None] + self.most - 2 * (q @ self.vectors.T)
        return np.sqrt(np.maximum(0.0, square))


class Annuli:
    """The blocks of the index: pivot, least and largest distance, size."""

    def __init__(self, rows):
        self.block = np.array([r.block for r in rows], np.int64)
        self.pivot = np.array([r.pivot for r in rows], np.int64)
        self.near = np.array([r.near for r in rows], np.float64)
        self.far = np.array([r.far for r in rows], np.float64)
        self.n = np.array([r.n for r in rows], np.int64)

    def gaps(self, distances: np.ndarray) -> np.ndarray:
        """Least distance that a vector of each block can have from a query."""
        d = distances[self.pivot]
        return np.maximum(0.0, np.maximum(self.near - d, d - self.far))

    def first(self, gaps: np.ndarray, k: int) -> np.ndarray:
        """The nearest annuli that hold more than k vectors together."""
        order = np.argsort(gaps, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(self.n[order]), k + 1)) + 1]

    def within(self, gaps: np.ndarray, square: float, most: float, bound: float) -> np.ndarray:
        """Annuli whose best possible score reaches ``bound``."""
        best = (square + most - gaps**2) / 2
        return np.flatnonzero(best + MARGIN * (1 + square + most) >= bound)


def _visits(pivots: Pivots, annuli: Annuli, dim: int, k: int, again: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            q = _matrix(batch.column("v"), dim)
            distances = pivots.from_queries(q)
            bounds = batch.column("bound").to_pylist() if again else [None] * len(q)
            blocks, rows = [], []
            for i, bound in enumerate(bounds):
                gaps = annuli.gaps(distances[i])
                found = annuli.first(gaps, k)
                if again:
                    square = float((q[i].astype(np.float64) ** 2).sum())
                    more = annuli.within(gaps, square, pivots.most, -np.inf if bound is None else bound)
                    found = np.setdiff1d(more, found)
                blocks.append(annuli.block[found])
                rows.append(np.full(len(found), i))
            take = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            columns = [pa.array(np.concatenate(blocks)) if blocks else pa.array([], pa.int64()), batch.column("vec_id").take(take), batch.column("v").take(take)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "query_id", "q"])

    return run


def _score(dim: int, k: int):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by("vec_id")
        ids, x = block["vec_id"].to_numpy(), _matrix(block["v"], dim)
        names, q = queries["query_id"].to_numpy(), _matrix(queries["q"], dim)
        out = []
        step = max(1, (1 << 21) // max(1, len(ids)))
        for at in range(0, len(names), step):
            own, scores = names[at : at + step], _products(q[at : at + step], x)
            scores[own[:, None] == ids[None, :]] = np.iinfo(np.int64).min
            # ids ascend, so a stable sort breaks ties by the smaller one
            best = np.argsort(-scores.clip(np.iinfo(np.int64).min + 1), axis=1, kind="stable")[:, :k] if len(ids) else np.zeros((len(own), 0), int)
            row = np.repeat(np.arange(len(own)), best.shape[1])
            best = best.ravel()
            out.append((own[row], ids[best], scores[row, best]))
        a, b, c = (np.concatenate(z) if out else np.zeros(0, np.int64) for z in (zip(*out, strict=True) if out else ([], [], [])))
        real = c != np.iinfo(np.int64).min
        return pa.table({"query_id": a[real], "vec_id": b[real], "score": c[real]})

    return run


def _cut(block: int):
    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        base, number, pivot, fill = TaskContext.get().partitionId() << 32, -1, None, 0
        for batch in batches:
            numbers = []
            for p in batch.column("pivot").to_pylist():
                if p != pivot or fill == block:
                    number, pivot, fill = number + 1, p, 0
                fill += 1
                numbers.append(base + number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "block"])

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 20, n_pivots: int = PIVOTS, block: int = BLOCK, most_visits: int = VISITS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row (vec_id, v: array<bigint>)
    where ``is_query`` holds, the k other rows of the largest inner product."""
    rows = rows.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.max("v").alias("v"))
    rows = work_table(rows.withColumn("query", F.coalesce(is_query, F.lit(False))), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    facts = rows.agg(F.max(F.size("v")).alias("dim"), F.max(square).alias("most"), F.count(F.lit(1)).alias("n")).first()
    dim, most = facts["dim"] or 1, facts["most"] or 0.0
    if most >= 2.0**63:  # no score is larger than the largest squared length
        raise ValueError("components too large: inner products could pass 64 bits")
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
    pivots = Pivots(np.unique(np.array([r.v for r in fitted] or [[0] * dim], np.int64), axis=0), most)

    def assign(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            pivot, distance = pivots.nearest(_matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(pivot.astype(np.int64)), pa.array(distance)], ["vec_id", "v", "pivot", "distance"])

    schema = "vec_id long, v array<bigint>, pivot long, distance double"
    placed = work_table(rows.select("vec_id", "v").mapInArrow(assign, schema), "placed")
    # (pivot, distance, id): equal vectors are dealt out by their ids
    by = ["pivot", "distance", "vec_id"]
    size = max(block, -(-facts["n"] // (MAX_BLOCKS // 2)))
    index = placed.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_cut(size), f"{schema}, block long")
    index = work_table(index, "pivot-index")
    annuli = index.groupBy("block").agg(
        F.first("pivot").alias("pivot"), F.min("distance").alias("near"), F.max("distance").alias("far"), F.count(F.lit(1)).alias("n")
    ).orderBy("block").collect()
    annuli = Annuli(annuli)
    block_rows = index.select("block", "vec_id", "v")

    def visit(queries: DataFrame, again: bool) -> DataFrame:
        visits = work_table(queries.mapInArrow(_visits(pivots, annuli, dim, k, again), "block long, query_id long, q array<bigint>"), "visits")
        crowded = visits.groupBy(F.col("block").alias("of")).agg(F.ceil(F.count(F.lit(1)) / most_visits).cast("int").alias("groups"))
        crowded = F.broadcast(work_table(crowded.where(F.col("groups") > 1), "crowded"))  # at most one row a block
        dealt = lambda rows: rows.join(crowded, F.col("block") == F.col("of"), "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
        salted = dealt(visits).select("block", F.pmod(F.xxhash64("query_id"), "groups").cast("int").alias("salt"), "query_id", "q")
        copies = dealt(block_rows).select("block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), "vec_id", "v")
        by = ["block", "salt"]
        found = salted.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(_score(dim, k), "query_id long, vec_id long, score long")
        return work_table(found, "scored")

    queries = rows.where("query").select("vec_id", "v")
    first = visit(queries, False)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    bounds = ranked.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    bounds = bounds.select("query_id", F.when(F.col("n") >= k, F.col("least").cast("double")).alias("bound"))
    queries = queries.join(bounds, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "bound")
    found = first.union(visit(queries, True))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
