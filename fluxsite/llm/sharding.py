"""Hierarchical weighted hash tree: regions, racks, shards.

At each level a row draws an exponential variate per child, divided by the
child's weight, from a hash of (key, child); the smallest draw wins. Raising
one weight therefore pulls rows into that subtree only, and a new region takes
rows from the others without moving any row between them. DataFrame functions
only.

Defined cases: a NULL key is a key like any other (all NULL keys share one
place); repeated keys share a shard and get different slots; a NULL text
counts no bytes (size 1, CRC of the empty string); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash52, text_or_empty, work_table

SEED = "tree-1"
RACKS_PER_REGION, SHARDS_PER_RACK = 2, 4
BASE = 16  # shards that a tree begins with; later ones open regions of their own

Tree = list  # regions -> racks -> shard weights


def tree_of(shards: int, base: int | None = None) -> Tree:
    """The tree of a shard count: ``base`` shards (at most ``BASE``, all of fewer) in
    regions and racks, and each later one in a region of its own. So for one base,
    ``tree_of(n + 1)`` is ``tree_of(n)`` with a new subtree, and only the new shard takes rows."""
    base = min(shards, BASE) if base is None else base
    if not 1 <= base <= shards:
        raise ValueError(f"a tree that began with {base} shards cannot have {shards}")
    tree: Tree = []
    for k in range(base):
        region, rest = divmod(k, RACKS_PER_REGION * SHARDS_PER_RACK)
        rack = rest // SHARDS_PER_RACK
        if region == len(tree):
            tree.append([])
        if rack == len(tree[region]):
            tree[region].append([])
        tree[region][rack].append(1.0)
    for _ in range(base, shards):
        tree = with_new_region(tree)
    return tree


def with_new_region(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` and one more shard in a region of its own: rows move only into it."""
    return [*tree, [[weight]]]


def _draw(key: Column, path: str, weights: list[float], seed: str) -> Column:
    """Index of the child of ``path`` that a key descends to."""
    if len(weights) == 1:
        return F.lit(0)
    draws = [
        F.struct((-F.log((hash52(F.lit(seed), key, F.lit(f"{path}.{i}")) + 1) / F.lit(float(1 << 52))) / F.lit(float(w))).alias("d"), F.lit(i).alias("i"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*draws))["i"] if len(draws) > 1 else draws[0]["i"]


def _case(selector: Column, branches: list[Column]) -> Column:
    out = F.when(selector == 0, branches[0])
    for i, b in enumerate(branches[1:], 1):
        out = out.when(selector == i, b)
    return out


def place(df: DataFrame, key: str, tree: Tree, out: str, seed: str = SEED) -> DataFrame:
    """``df`` with column ``out``: the shard number (leaves counted in tree order)."""
    k = F.col(key)
    weigh = lambda node: sum(map(weigh, node)) if isinstance(node, list) else node
    df = df.withColumn("__region", _draw(k, "r", [weigh(r) for r in tree], seed))
    df = df.withColumn(
        "__rack", _case(F.col("__region"), [_draw(k, f"r.{i}", [weigh(x) for x in r], seed) for i, r in enumerate(tree)])
    )
    regions, first = [], 0
    for i, region in enumerate(tree):
        racks = []
        for j, rack in enumerate(region):
            racks.append(F.lit(first) + _draw(k, f"r.{i}.{j}", list(rack), seed))
            first += len(rack)
        regions.append(_case(F.col("__rack"), racks))
    return df.withColumn(out, _case(F.col("__region"), regions).cast("int")).drop("__region", "__rack")


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (column ``shard``) with ``slot``: 0, 1, ... within each shard, by ``order``.

    No shard is ever gathered in one task: rows are range-partitioned by
    (shard, order, row number of the written input), so that even equal rows
    spread; each partition numbers its own rows, and a prefix sum over the
    (shard, partition) counts gives the offsets.
    """
    cols = rows.columns
    rows = work_table(rows.withColumn("__row", F.monotonically_increasing_id()), "shard-rows")
    by = ["shard", *order, "__row"]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = work_table(
        ranged.select(*cols, F.monotonically_increasing_id().alias("__at")), "shard-ranges"
    ).withColumn("__part", F.shiftright("__at", 33))
    counts = ranged.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = work_table(
        counts.select(
            F.col("shard").alias("__o_shard"), F.col("__part").alias("__o_part"), "__first",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        ),
        "shard-offsets",
    )
    out = ranged.join(offsets, (F.col("shard") == F.col("__o_shard")) & (F.col("__part") == F.col("__o_part")))
    return out.select(*cols, (F.col("__offset") + F.col("__at") - F.col("__first")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: str = SEED, base: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), by the law ``key``: with
    one more shard rows go only into it, at every count. ``base``: the count that the
    tree began with (see ``tree_of``); a cluster that grows keeps it."""
    base = min(shards, BASE) if base is None else base
    text = text_or_empty(F.col("text"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = place(rows, "doc_id", tree_of(shards, base), "shard", seed)
    rows = place(rows, "doc_id", tree_of(shards + 1, base), "grown_shard", seed)
    rows = rows.withColumn("__order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))))
    out = with_slots(rows, ["__order", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
