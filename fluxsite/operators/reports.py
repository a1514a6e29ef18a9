"""The three reports: per building, per unit, per building and unit.

The reference builds each one as five per-resource aggregates chained by
full outer joins. Here the five resources share one long table with a
``resource`` column, and each report is a single ``groupBy`` of conditional
aggregates: one Exchange, no join. The complete-case filter of the per-unit
report is reproduced per resource on the aggregated row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxsite.config import AnalysisConfig
from fluxsite.functions.nulls import ieee_div, present, row_sum_na_rm, sql_str, strict_sum
from fluxsite.functions.text import member_count
from fluxsite.operators.allocation import building_occupancy, first_state, null_safe_left_join, priced
from fluxsite.operators.meters import sum_of_shares


def unit_terms(
    stats: DataFrame, occ: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), state: DataFrame | None = None
) -> DataFrame:
    """Per (resource, building, occupancy row): the building's latest readings
    allocated to the unit (sum over the meters, rebuilt from the building
    statistics) and its cost, once per state row of the building (the state
    join comes before the sums). Buildings without occupancy keep one row with
    NULL unit and NULL values, as the left join does."""
    occ_cols = occ.select("num_bat", "Unite", "metrage_unite_ajus", "metrage_batiment")
    if state is not None:
        occ_cols = null_safe_left_join(occ_cols, state.select("num_bat"))
    j = null_safe_left_join(stats, occ_cols)
    v = sum_of_shares("metrage_unite_ajus", "metrage_batiment")
    return j.select("resource", "num_bat", "Unite", v.alias("v")).withColumn("c", priced(F.col("v"), cfg))


def wide_report(terms: DataFrame, keys, omit=(), cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Five resources side by side on ``keys`` in one aggregation.

    Per resource: strict sums of value and cost; the resource's cells are
    kept when it has rows for the key and, for resources in ``omit``, when
    the key and both sums are neither NULL nor NaN. A key is output when at
    least one resource keeps it (the full-outer-join row set).
    """
    keys = list(keys)
    aggs = []
    for r in cfg.resources:
        is_r = f"resource = {sql_str(r)}"
        aggs += [
            strict_sum("v", is_r).alias(f"_v_{r}"),
            strict_sum("c", is_r).alias(f"_c_{r}"),
            present(is_r).alias(f"_n_{r}"),
        ]
    g = terms.groupBy(*keys).agg(*aggs)
    keep = {}
    for r in cfg.resources:
        k = [f"_n_{r}"]
        if r in omit:
            k += [f"{key} IS NOT NULL" for key in keys]
            k += [f"NOT ({c} IS NULL OR isnan({c}))" for c in (f"_v_{r}", f"_c_{r}")]
        keep[r] = "(" + " AND ".join(k) + ")"
    g = g.filter(" OR ".join(keep.values()))
    out = list(keys)
    for r in cfg.resources:
        out += [
            f"CASE WHEN {keep[r]} THEN _v_{r} END AS {cfg.value_columns[r]}",
            f"CASE WHEN {keep[r]} THEN _c_{r} END AS {cfg.cost_columns[r]}",
        ]
    return g.selectExpr(*out)


def cost_columns(cfg: AnalysisConfig = AnalysisConfig()) -> list[str]:
    return [cfg.cost_columns[r] for r in cfg.resources]


def by_unit(
    stats: DataFrame, occ: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), state: DataFrame | None = None
) -> DataFrame:
    """Allocated consumption and cost per unit over all buildings, member
    count of shared labels and the total cost of the unit. Without ``state``
    every building counts as having one state row."""
    rep = wide_report(unit_terms(stats, occ, cfg, state), ["Unite"], cfg.omit_incomplete, cfg)
    return rep.withColumns({"countU": member_count("Unite"), "cout_global_unite": row_sum_na_rm(cost_columns(cfg))})


def by_building_unit(
    stats: DataFrame, occ: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), state: DataFrame | None = None
) -> DataFrame:
    """Allocated consumption and cost per (building, unit); rows without unit
    dropped; key label ``batu`` = 'num_bat-Unite'."""
    rep = wide_report(unit_terms(stats, occ, cfg, state), ["num_bat", "Unite"], (), cfg)
    rep = rep.filter(F.col("Unite").isNotNull())
    return rep.withColumns(
        {
            "countU": member_count("Unite"),
            "batu": F.concat(F.coalesce(F.col("num_bat"), F.lit("NA")), F.lit("-"), F.col("Unite")),
            "cout_global_batunite": row_sum_na_rm(cost_columns(cfg)),
        }
    )


def by_building(
    stats: DataFrame, occ: DataFrame, state: DataFrame, cfg: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """Per building: consumption and cost per m2 of each resource from its
    first meter, with state and floor area taken from the electricity rows.

    One ``groupBy(num_bat)`` sets the resources side by side; the floor area (first
    occupancy row by site) and the state (first state row by ordinal) are joined to
    the few rows of its result.
    """
    aggs = []
    for r in cfg.resources:
        is_r = f"resource = {sql_str(r)}"
        aggs += [F.expr(f"max(CASE WHEN {is_r} THEN d_first END)").alias(f"_d_{r}"), present(is_r).alias(f"_n_{r}")]
    g = stats.groupBy("num_bat").agg(*aggs)
    g = g.filter(" OR ".join(f"_n_{r}" for r in cfg.resources))
    g = null_safe_left_join(g, building_occupancy(occ).withColumnRenamed("metrage_batiment", "_mb"))
    g = null_safe_left_join(g, first_state(state).withColumnRenamed("etat_energie", "_etat"))
    first = cfg.resources[0]
    out = [
        F.col("num_bat"),
        F.when(F.col(f"_n_{first}"), F.col("_etat")).alias("etat_energie"),
        F.when(F.col(f"_n_{first}"), F.col("_mb")).alias("metrage_batiment"),
    ]
    for r in cfg.resources:
        conso_m2 = F.when(F.col(f"_n_{r}"), ieee_div(F.col(f"_d_{r}"), F.col("_mb")))
        out += [
            conso_m2.alias(cfg.value_columns[r]),
            (conso_m2 * F.lit(cfg.price(r)) * F.lit(cfg.coef(r))).alias(cfg.cost_columns[r]),
        ]
    rep = g.select(*out)
    return rep.withColumn("cout_global_bat", row_sum_na_rm(cost_columns(cfg)))
