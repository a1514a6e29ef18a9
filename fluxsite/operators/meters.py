"""Meter readings in long form and their building-level statistics.

Contract of the long meter table: one row per (resource, ordinal, year) with
``batiment`` (the sheet label) and ``conso`` (double, NULL when the cell is
missing). ``ordinal`` is the meter's position key inside its sheet.

The reports only need, per (resource, building), a handful of numbers about
the latest reading of its meters. ``building_stats`` computes them in one
aggregation that combines map-side, so a hot building never lands whole in
one task, and every later step runs on buildings instead of meters.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from fluxsite.config import AnalysisConfig
from fluxsite.functions.nulls import not_in_null_safe, sign_class_counts, sql_name, sql_str, sum_na_rm
from fluxsite.functions.text import meter_building_code

METER_COLUMNS = ["resource", "ordinal", "batiment", "year", "conso"]


def rows_of(df: DataFrame, resources) -> DataFrame:
    """The rows of some resources. Of a union of sheets only those sheets are read."""
    return df.filter(F.col("resource").isin(list(resources)))


def assign_building_codes(
    meters: DataFrame, code_map: DataFrame | None = None, cfg: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """Add ``num_bat``: chars 5-8 of the label, or, for the positional
    resources, the code that ``code_map`` (resource, ordinal, num_bat) gives.

    Only the rows of the positional resources go through the join; the others
    pass it by. Rows of resources that the analysis does not know are left out."""
    positional = [r for r in cfg.resources if code_map is not None and r in cfg.positional_code_resources]
    plain = rows_of(meters, [r for r in cfg.resources if r not in positional]).withColumn("num_bat", meter_building_code("batiment"))
    if not positional:
        return plain
    codes = rows_of(code_map, positional).select("resource", "ordinal", "num_bat")
    mapped = rows_of(meters, positional).join(codes, ["resource", "ordinal"], "left")
    return plain.unionByName(mapped)


def latest_years(meters: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(resource, year): the latest year of each configured resource."""
    return meters.filter(F.col("resource").isin(list(cfg.resources))).groupBy("resource").agg(F.max("year").alias("year"))


def latest_year_of(years: DataFrame) -> Column:
    """map<resource, latest year> as a scalar subquery of the plan: no job runs
    while a query is built (at most one entry per configured resource)."""
    return years.agg(F.map_from_entries(F.collect_list(F.struct("resource", "year")))).scalar()


def latest_predicate(years: dict[str, int]) -> Column:
    """``resource = r AND year = y_r`` for every resource, as one predicate
    that Catalyst can push towards the scan."""
    terms = [f"(resource = {sql_str(r)} AND year = {int(y)})" for r, y in sorted(years.items())]
    return F.expr(" OR ".join(terms) if terms else "false")


def latest_readings(meters_coded: DataFrame, years: dict[str, int] | Column) -> DataFrame:
    """Per-meter latest reading ``derniere_conso`` (one row per meter).

    ``years`` holds the latest year of each resource: literals from the sheet
    headers, or the scalar map of ``latest_year_of``. The contract of the long
    table (one row per meter and sheet year) makes this the sheet's latest
    column; a meter whose cell is empty has a row with NULL.
    """
    keep = latest_predicate(years) if isinstance(years, dict) else F.col("year") == years[F.col("resource")]
    keys = [c for c in ("resource", "ordinal", "batiment", "num_bat") if c in meters_coded.columns]
    return meters_coded.filter(keep).select(*keys, F.col("conso").alias("derniere_conso"))


def wide_readings(
    meters_coded: DataFrame, years: dict[str, list[int]], cfg: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """The long readings as sheets hold them: one row per meter, one
    'YYYY_conso' column per header year and ``derniere_conso`` = the latest
    year of the resource's sheet. One aggregation over the known years."""
    yr, d = F.col("year"), F.col("conso")
    keys = [c for c in ("resource", "ordinal", "batiment", "num_bat") if c in meters_coded.columns]
    wide = meters_coded.groupBy(*keys).agg(
        *[F.max(F.when(yr == y, d)).alias(f"{y}_conso") for y in sorted({y for ys in years.values() for y in ys})]
    )
    latest = F.lit(None).cast("double")
    for r, ys in sorted(years.items()):
        if ys:
            latest = F.when(F.col("resource") == F.lit(r), F.col(f"{max(ys)}_conso")).otherwise(latest)
    return wide.withColumn("derniere_conso", latest)


def export_rows(
    wide: DataFrame,
    held: dict[str, list[str]],
    cfg: AnalysisConfig = AnalysisConfig(),
    code_map: DataFrame | None = None,
    coded: bool = True,
) -> DataFrame:
    """Meter rows as the joins see them: the pre-aggregated resources collapse to
    one row per building (every numeric column summed, NULL and NaN skipped), the
    others stay per meter. Each resource takes its own way, so only the rows that are
    summed are shuffled for it; with ``coded`` off the rows get their building codes
    on that way as well.

    ``held`` lists the columns that each resource's sheet holds; a column that
    the sheet lacks stays NULL instead of becoming the sum of nothing.
    """
    keys = ("resource", "ordinal", "batiment", "num_bat")
    cols = [c for c in wide.columns if c not in keys]

    def with_codes(resources) -> DataFrame:
        rows = rows_of(wide, resources)
        return rows if coded else assign_building_codes(rows, code_map, replace(cfg, resources=tuple(resources)))

    def value(c: str) -> Column:
        having = [r for r in cfg.pre_aggregate if c in held.get(r, cols)]
        return F.when(F.col("resource").isin(having), sum_na_rm(F.col(sql_name(c)))).alias(c)

    order = [*keys, *cols]
    select = lambda df: df.select(*[F.col(sql_name(c)) for c in order])
    summed = [r for r in cfg.resources if r in cfg.pre_aggregate]
    kept = [r for r in cfg.resources if r not in cfg.pre_aggregate]
    parts = []
    if kept:
        parts.append(select(with_codes(kept)))
    if summed:
        rows = with_codes(summed).groupBy("resource", "num_bat").agg(F.min("ordinal").alias("ordinal"), *[value(c) for c in cols])
        parts.append(select(rows.withColumn("batiment", F.lit(None).cast(wide.schema["batiment"].dataType))))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def exclusion_predicate(cfg: AnalysisConfig = AnalysisConfig()) -> Column:
    """Rows to keep after the per-resource building exclusions (NULL kept)."""
    hits = [
        f"(resource = {sql_str(r)} AND coalesce(num_bat IN ({', '.join(sql_str(c) for c in codes)}), false))"
        for r, codes in sorted(cfg.excluded_buildings.items())
        if codes
    ]
    return F.expr(f"NOT ({' OR '.join(hits)})" if hits else "true")


def drop_excluded(df: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    return df.filter(exclusion_predicate(cfg))


def pre_aggregated(latest: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """``export_rows`` of the latest readings alone."""
    return export_rows(latest, {}, cfg)


def building_stats(latest: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Per (resource, num_bat): what the reports need about the latest readings.

    n_rows, n_null, n_pos, n_neg, n_zero_nan : counts that rebuild IEEE sums
    d_sum        : NULL-skipping, NaN-propagating sum
    d_first      : reading of the first meter by ordinal (NULL kept)
    For the pre-aggregated resources the building is a single row whose value
    is the NULL- and NaN-skipping sum, as in the reference.
    """
    raw = latest.groupBy("resource", "num_bat").agg(
        F.expr("count(1)").alias("n_rows"),
        *sign_class_counts("derniere_conso"),
        F.expr("sum(derniere_conso)").alias("d_sum"),
        sum_na_rm("derniere_conso").alias("d_sum_na_rm"),
        F.expr("min_by(derniere_conso, ordinal)").alias("d_first"),
    )
    pre = f"resource IN ({', '.join(sql_str(r) for r in cfg.pre_aggregate)})" if cfg.pre_aggregate else "false"
    v = "d_sum_na_rm"

    def pick(a: str, b: str, name: str) -> str:
        return f"CASE WHEN {pre} THEN {a} ELSE {b} END AS {name}"

    return raw.selectExpr(
        "resource",
        "num_bat",
        pick("1L", "n_rows", "n_rows"),
        pick("0L", "n_null", "n_null"),
        pick(f"CAST(NOT isnan({v}) AND {v} > 0 AS BIGINT)", "n_pos", "n_pos"),
        pick(f"CAST(NOT isnan({v}) AND {v} < 0 AS BIGINT)", "n_neg", "n_neg"),
        pick(f"CAST(isnan({v}) OR {v} = 0 AS BIGINT)", "n_zero_nan", "n_zero_nan"),
        pick(v, "d_sum", "d_sum"),
        pick(v, "d_first", "d_first"),
    )


def sum_of_shares(mu: str, mb: str) -> Column:
    """Sum over a building's meters of ``derniere_conso * mu / mb`` rebuilt
    from ``building_stats`` columns, with the IEEE result of the row-wise sum:

    any NULL reading, or NULL mu/mb             -> NULL
    mb == 0: each term is +-Inf, or NaN for a zero/NaN product, and the sum
             is NaN when a NaN or both signs occur, else the common Inf
    otherwise                                    -> d_sum * mu / mb
    """
    mu, mb = sql_name(mu), sql_name(mb)
    inf, nan = "double('Infinity')", "double('NaN')"
    zero_div = (
        f"CASE WHEN {mu} = 0 OR isnan({mu}) OR n_zero_nan > 0 OR (n_pos > 0 AND n_neg > 0) THEN {nan} "
        f"WHEN n_pos > 0 THEN CASE WHEN {mu} > 0 THEN {inf} ELSE -{inf} END "
        f"ELSE CASE WHEN {mu} > 0 THEN -{inf} ELSE {inf} END END"
    )
    return F.expr(
        f"CASE WHEN {mu} IS NULL OR {mb} IS NULL OR n_null > 0 THEN CAST(NULL AS DOUBLE) "
        f"WHEN {mb} = 0 THEN {zero_div} "
        f"ELSE try_divide(d_sum * {mu}, {mb}) END"
    )


def sum_all_numeric(wide: DataFrame, key: str = "num_bat") -> DataFrame:
    """Per key, NULL/NaN-skipping sum of every numeric column (the reference's
    electricity roll-up); non-numeric columns are dropped."""
    nums = [f.name for f in wide.schema.fields if isinstance(f.dataType, NumericType) and f.name != key]
    return wide.groupBy(key).agg(*[sum_na_rm(F.col(f"`{c}`")).alias(c) for c in nums])


def keep_not_in(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is not in ``values``; NULL rows stay."""
    return df.filter(not_in_null_safe(column, values))
