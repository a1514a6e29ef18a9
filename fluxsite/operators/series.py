"""Series behind the charts: totals per year, per building, per unit, and the
year-over-year variation of each building.

The reference sums the year columns of the joined export table, where each
meter row is repeated once per occupying unit. That total is rebuilt without
the fan-out: per (resource, building, year) the NULL-skipping sum of the
readings times the number of rows the joins give the building.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxsite.config import AnalysisConfig
from fluxsite.functions.nulls import ieee_div, sum_na_rm
from fluxsite.operators.meters import drop_excluded


def building_year_totals(meters_coded: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Per (resource, num_bat, year): NULL/NaN-skipping sum of the readings."""
    return (
        meters_coded.filter(F.col("resource").isin(list(cfg.resources)))
        .groupBy("resource", "num_bat", "year")
        .agg(sum_na_rm("conso").alias("conso"))
    )


def join_multiplicity(occ: DataFrame, state: DataFrame) -> DataFrame:
    """Rows a building gets from the state and occupancy left joins (at least
    one each): both inputs tagged, unioned and counted in one aggregation."""
    o = occ.select("num_bat", F.lit(1).alias("o"), F.lit(0).alias("s"))
    s = state.select("num_bat", F.lit(0).alias("o"), F.lit(1).alias("s"))
    return (
        o.unionByName(s)
        .groupBy("num_bat")
        .agg(
            F.greatest(F.sum("o"), F.lit(1)).alias("n_occ"),
            F.greatest(F.sum("s"), F.lit(1)).alias("n_state"),
        )
    )


def unit_label(cfg: AnalysisConfig = AnalysisConfig()):
    """Display unit of the row's resource (the chart title's unit)."""
    return F.create_map(*[x for r in cfg.resources for x in (F.lit(r), F.lit(cfg.unit_labels[r]))])[F.col("resource")]


def series_by_year(
    meters_coded: DataFrame, occ: DataFrame, state: DataFrame, cfg: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """Yearly total of each resource as the chart of the export table shows it
    (excluded buildings out, each reading counted once per joined row)."""
    bt = drop_excluded(building_year_totals(meters_coded, cfg), cfg)
    mult = join_multiplicity(occ, state).withColumnRenamed("num_bat", "_nb")
    j = bt.join(mult, bt["num_bat"].eqNullSafe(mult["_nb"]), "left")
    weight = F.coalesce(F.col("n_occ"), F.lit(1)) * F.coalesce(F.col("n_state"), F.lit(1))
    out = j.groupBy("resource", "year").agg(F.sum(F.col("conso") * weight).alias("total"))
    return out.withColumn("unit", unit_label(cfg)).orderBy("resource", "year")


def series_by_year_raw(meters_coded: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Yearly total of each resource over the meters as read (no join, no
    exclusion)."""
    out = (
        meters_coded.filter(F.col("resource").isin(list(cfg.resources)))
        .groupBy("resource", "year")
        .agg(sum_na_rm("conso").alias("total"))
    )
    return out.withColumn("unit", unit_label(cfg)).orderBy("resource", "year")


def _long_values(report: DataFrame, key: str, cfg: AnalysisConfig) -> DataFrame:
    ids = [key]
    vals = [cfg.value_columns[r] for r in cfg.resources]
    long = report.select(key, *vals).unpivot(ids, vals, "value_col", "value")
    name_to_res = F.create_map(*[x for r in cfg.resources for x in (F.lit(cfg.value_columns[r]), F.lit(r))])
    return long.select(key, name_to_res[F.col("value_col")].alias("resource"), "value")


def series_by_building(report_bu: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Per (resource, num_bat): total allocated consumption (missing as 0)."""
    return _long_values(report_bu, "num_bat", cfg).groupBy("resource", "num_bat").agg(
        sum_na_rm("value").alias("total_conso")
    )


def series_by_unit(report_bu: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Per (resource, Unite): total allocated consumption (missing as 0)."""
    return _long_values(report_bu, "Unite", cfg).groupBy("resource", "Unite").agg(
        sum_na_rm("value").alias("total_conso")
    )


def year_over_year(meters_coded: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Absolute and percent change of each building's consumption against the
    calendar year before; NULL where that year has no reading.

    The window is partitioned by (resource, building), so each task holds
    one building's handful of years; its frame is the previous year by value,
    not the previous row."""
    bt = building_year_totals(meters_coded, cfg)
    w = Window.partitionBy("resource", "num_bat").orderBy("year").rangeBetween(-1, -1)
    prev = F.first("conso").over(w)
    evol = F.col("conso") - prev
    return bt.withColumns({"conso_prev": prev, "evol": evol, "evol_pct": ieee_div(evol, prev) * F.lit(100.0)})
