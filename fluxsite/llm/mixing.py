"""Mixing sources to target weights.

Tokens are aggregated per source, target shares are filled up to a cap, and
each document is emitted floor(rate) times plus one hash-seeded Bernoulli copy
whose probability is the fraction of the rate. DataFrame functions only.

Defined cases: a NULL or blank text has size 0; NULL is a source of its own,
ranked last; a source of size 0 has target 0 and gives no copies; repeated
rows (same doc_id) share one draw; an empty table gives an empty result; other
columns of the input are ignored by ``mix_plan`` and kept by ``emit_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, unit_draw, word_count, work_table

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
SHARE = (3, 2)  # all targets together: 150 % of all sizes
CAP = 2  # a target stops at this multiple of its source's size
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    The level at which ``min(weight * level, cap * size)`` adds up to the
    shared total is the largest of the levels that result when the sources of
    smallest cap/weight ratio stop at their caps, so one ordered pass over the
    aggregated sources (one row each) finds it: no rounds of resharing.
    """
    num, den = share
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", pick.cast("long").alias("w"))
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = (num * F.sum("source_size").over(everything) - den * cap * capped) / (den * F.sum("w").over(onward))
    per = per.select("source", "source_size", "w", level.alias("level"))
    level = F.max("level").over(everything)
    target = F.least(F.col("w") * level, (cap * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def copies(doc_id: Column, target: Column, source_size: Column, seed: str = SEED) -> Column:
    """How often a document is taken: floor(rate), and once more with probability frac(rate)."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    again = unit_draw(F.lit(seed), doc_id) < (rate - F.floor(rate))
    return F.floor(rate) + again.cast("long")


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Left join on the source, NULL equal to NULL. The targets come from a
    written table, so Spark knows their size: it broadcasts them only under
    its threshold, and splits a hot source's partition otherwise."""
    t = targets.select(F.col("source").alias("__t_source"), "source_size", "target")
    return rows.join(t, rows["__source"].eqNullSafe(t["__t_source"]), "left")


def mix_plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per document."""
    slim = work_table(
        docs.select("doc_id", F.col("source").alias("__source"), word_count(F.col("text")).alias("size")), "mix-sizes"
    )
    targets = work_table(
        source_targets(slim.select(F.col("__source").alias("source"), "size"), weights, share, cap), "mix-targets"
    )
    out = _with_targets(slim, targets)
    n = copies(F.col("doc_id"), F.col("target"), F.col("source_size"), seed)
    out = out.select("doc_id", F.col("__source").alias("source"), "size", "source_size", "target", n.alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def emit_copies(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, same columns."""
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = work_table(source_targets(sizes, weights, share, cap), "mix-targets")
    rows = docs.withColumn("__source", F.col("source"))
    out = rows.join(
        targets.select(F.col("source").alias("__t_source"), F.col("source_size").alias("__size"), F.col("target").alias("__target")),
        F.col("__source").eqNullSafe(F.col("__t_source")),
        "left",
    )
    n = copies(F.col("doc_id"), F.col("__target"), F.col("__size"), seed)
    out = out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), n.cast("int"))))
    return out.select(*[column(c) for c in docs.columns])
