"""Registered queries: one per operator of the inventory, each with its SQL
oracle over the driver's tables.

Every Spark query reads the whole driver tables through the bindings; its
double columns are rounded to 4 decimals (snap to 1e-9, then
round(x * 1e4) / 1e4) so two engines that add the same numbers in another
order compare equal, and a column tells each double's kind (null, nan, inf,
-inf, num). The SQL side does the same.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fluxsite import config as C
from fluxsite.functions.nulls import ieee_div, sum_na_rm
from fluxsite.functions.text import (
    canonical_unit,
    headcount_estimate,
    lenient_double,
    member_count,
    meter_building_code,
    separator_count,
    years_in,
)
from fluxsite.operators import allocation as A
from fluxsite.operators import meters as M
from fluxsite.operators import occupancy as O
from fluxsite.operators import positions as X
from fluxsite.plans.analysis import Analysis
from fluxsite.session import scratch_folder
from fluxsite.sinks.publish import latest_run, publish_run
from fluxsite.sources import bindings as B
from fluxsite.sources import sql as S
from fluxsite.sources.headers import standardise_headers, unpivot_years
from fluxsite.sources.sheets import apply_na_tokens, named, read_sheet

FLAGSHIP = "by_unit"


def _to_whole(x: Column) -> Column:
    """``round(x, 0)``, half away from zero. Spark's goes over the decimal text of each
    number, which took most of the time of the queries with many rows."""
    near = F.rint(x)  # half to even; the distance to it is exact
    return F.when(F.abs(x - near) == 0.5, x + F.signum(x) * 0.5).otherwise(near) + F.lit(0.0)  # no -0.0


def round4(df: DataFrame) -> DataFrame:
    """Round every double column to 4 decimals, half away from zero.

    The value is first snapped to a 1e-9 grid, so two sums of the same
    numbers in another order (a few ulps apart) land on the same grid point
    and an exact tie such as 0.61875 rounds the same way in both engines.
    NaN is not equal to itself, so a cell's kind (null, nan, inf, -inf, num)
    is a column of its own and NaN is shown as NULL beside it."""
    cols, kinds = [], []
    for f in df.schema.fields:
        if f.name.startswith((AS_SHOWN, AS_KIND)):
            continue
        c = named(f.name)
        if isinstance(f.dataType, DoubleType):
            ready = AS_SHOWN + f.name in df.columns
            # a row without match in a left join has no kind
            kinds.append((F.coalesce(named(AS_KIND + f.name), F.lit("null")) if ready else _kind(c)).alias(S.kind_column(f.name)))
            c = named(AS_SHOWN + f.name) if ready else _shown(c)
        cols.append(c.alias(f.name))
    return df.select(*cols, *kinds)


def _kind(c: Column) -> Column:
    return (
        F.when(c.isNull(), "null").when(F.isnan(c), "nan").when(c == float("inf"), "inf")
        .when(c == float("-inf"), "-inf").otherwise("num")
    )


def _shown(c: Column) -> Column:
    snapped = _to_whole(F.nanvl(c, F.lit(None).cast("double")) * F.lit(1e9)) / F.lit(1e9)
    return _to_whole(snapped * F.lit(10000.0)) / F.lit(10000.0)


AS_SHOWN, AS_KIND = "_shown_", "_kind_"


def with_shown(df: DataFrame) -> DataFrame:
    """``df`` with what ``round4`` makes of its double columns beside them. Rows that a
    join multiplies are rounded before it, once each; and the code of the rounding of all
    columns of a wide table in one projection would be too long for the JVM to compile."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    return df.select("*", *[_shown(named(c)).alias(AS_SHOWN + c) for c in doubles], *[_kind(named(c)).alias(AS_KIND + c) for c in doubles])


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return Analysis(B.inputs(spark, sf_dir))


def sheet_analysis(spark: SparkSession, sf_dir: str, workdir: str | None = None, beside: Callable | None = None) -> Analysis:
    """The analysis over wide sheets, as the workbooks give them: each sheet has its
    own year and variation columns."""
    sheets = _sheets(spark, sf_dir)
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("resource", F.lit(r)) for r, df in sheets.items()])
    held = {r: [c for c in df.columns if c not in ("ordinal", "batiment")] for r, df in sheets.items()}
    return Analysis(replace(B.inputs(spark, sf_dir), wide=wide, held=held), workdir=workdir, beside=beside)


def _sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five standardised sheets."""
    meters = B.meters(spark, sf_dir)
    raw = {r: raw_wide_sheet(meters, r, B.sheet_years(r), r not in B.SHEETS_WITHOUT_VARIATION) for r in C.SHEET_ORDER}
    return {r: standardise_headers(df) for r, df in raw.items()}


# --------------------------------------------------------------------------
# Wide sheets derived from the meter readings (one column per year), used by
# the header, unpivot and roll-up operators.
# --------------------------------------------------------------------------
def raw_wide_sheet(meters: DataFrame, resource: str, years: list[int], variation: bool = True) -> DataFrame:
    """The resource's sheet with free-text headers, as a workbook holds it. Readings
    of years before the sheet's first count into that."""
    m = M.rows_of(meters, [resource]).withColumn("year", F.greatest("year", F.lit(years[0])))
    wide = m.groupBy("ordinal", "batiment").pivot("year", years).agg(F.sum("conso"))
    y1, y2 = years[-2], years[-1]
    c1, c2 = F.col(f"`{y1}`"), F.col(f"`{y2}`")
    changes = [(c2 - c1).alias(f"Différence {y1} et {y2}"), (ieee_div(c2 - c1, c1) * F.lit(100.0)).alias(f"Evol {y1}/{y2} en %")]
    return wide.select(
        F.col("batiment").alias("Bâtiment"),
        *[F.col(f"`{y}`").alias(f"Conso {y} (kWh)") for y in years],
        *(changes if variation else []),
        F.lit("relevé").alias("Commentaire"),
        F.lit(None).cast("double").alias(f"Surface {y2}"),
        "ordinal",
    )


# ---------------------------- Spark queries -------------------------------
def q_scan_na_tokens(spark, d):
    m = B.meters(spark, d)
    cell = (
        F.when(F.col("conso").isNull(), F.lit("ND"))
        .when((F.col("ordinal") % 17 == 0) & (F.col("year") == 2015), F.lit("NA"))
        .otherwise(F.col("conso").cast("string"))
    )
    sheet = m.select("resource", "ordinal", "year", cell.alias("cell"))
    read = apply_na_tokens(sheet)
    return read.select("resource", "ordinal", "year", lenient_double("cell").alias("conso"))


def q_scan_sheet(spark, d):
    """A whole sheet through the reader: trimmed cells, NA tokens, file order."""
    sheet = read_sheet(spark, f"{d}/customer.parquet", "parquet", na_tokens=("BUILDING", "MACHINERY"))
    return sheet.select("ordinal", "c_custkey", "c_name", "c_mktsegment")


def q_scan_csv_breaks(spark, d):
    """A sheet of line items as CSV, line breaks and quotes in its cells, read by many tasks a file."""
    note = F.concat("l_returnflag", F.lit(' "'), "l_linestatus", F.lit('"\n'), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(", "), F.col("l_partkey").cast("string"))
    sheet = B._read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", note.alias("note"), "l_quantity")
    path = scratch_folder(spark, "sheet")
    sheet.write.options(header=True, quote='"', escape='"').csv(path)
    back = read_sheet(spark, path, split=True)
    numbers = [lenient_double(c).cast("long").alias(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey")]
    return back.select(*numbers, "note", lenient_double("l_quantity").alias("l_quantity"))


def q_standardise_headers(spark, d):
    return sheet_analysis(spark, d).inputs.wide


def q_extract_years(spark, d):
    m = B.meters(spark, d)
    header = F.concat(
        F.lit("Différence "), (F.col("year") - 1).cast("string"), F.lit(" et "), F.col("year").cast("string"),
        F.lit(" "), F.col("batiment"),
    )
    return m.select("resource", "ordinal", "year", F.array_join(years_in(header), ",").alias("years"))


def q_latest_year(spark, d):
    a = analysis(spark, d)
    return a.latest


def q_unpivot_years(spark, d):
    long = [unpivot_years(df.withColumn("resource", F.lit(r)), ["resource", "ordinal", "batiment"]) for r, df in _sheets(spark, d).items()]
    return reduce(DataFrame.unionByName, long)


def q_sum_all_numeric(spark, d):
    inp = B.inputs(spark, d)
    std = standardise_headers(raw_wide_sheet(inp.meters, "elec", B.sheet_years("elec")))
    coded = std.withColumn("num_bat", meter_building_code("batiment")).drop("ordinal")
    return M.sum_all_numeric(coded, "num_bat")


def q_filter_soft_delete(spark, d):
    return O.filter_soft_delete(B.rooms(spark, d)).select(
        "Site", "num_bat", "Local", "Unite", "Surface_sol", "Surface_ajus", "Nom_occupants"
    )


def q_text_separator_count(spark, d):
    r = B.rooms(spark, d)
    return r.select("Local", "Nom_occupants", separator_count("Nom_occupants").cast("long").alias("n_sep"))


def q_headcount_estimate(spark, d):
    r = B.rooms(spark, d)
    return r.select("Local", "Nom_occupants", headcount_estimate("Nom_occupants").alias("count_pers0"))


def q_canonical_unit(spark, d):
    r = B.rooms(spark, d)
    return r.select("Local", "Unite", canonical_unit("Unite").alias("unit_canon"))


def q_member_count(spark, d):
    r = B.rooms(spark, d)
    return r.select("Local", "Unite", member_count("Unite").alias("countU"))


def _units_raw(spark, d):
    return O.occupancy_by_unit_raw(O.clean_rooms(B.rooms(spark, d)))


def q_occupancy_by_building(spark, d):
    return O.occupancy_by_building(O.clean_rooms(B.rooms(spark, d)))


def q_occupancy_by_unit_raw(spark, d):
    return _units_raw(spark, d)


def q_occupancy_with_building_total(spark, d):
    return O.occupancy_with_building_total(_units_raw(spark, d))


def _canon(spark, d):
    df = O.occupancy_with_building_total(_units_raw(spark, d))
    return df.withColumn("Unite", canonical_unit("Unite"))


def q_filter_not_in_null_safe(spark, d):
    return M.keep_not_in(_canon(spark, d), "Unite", C.EXCLUDED_UNITS)


def q_filter_contains(spark, d):
    df = M.keep_not_in(_canon(spark, d), "Unite", C.EXCLUDED_UNITS)
    return df.filter(F.col("Site").contains(C.SITE_PATTERN))


def q_drop_incomplete(spark, d):
    return O.research_units(O.occupancy_with_building_total(_units_raw(spark, d)))


def q_staff_count(spark, d):
    return O.staff_count(B.staff(spark, d))


def q_occupancy_staff(spark, d):
    return analysis(spark, d).occupancy


def q_surface_by_unit(spark, d):
    return analysis(spark, d).surface_by_unit


def q_distinct_units(spark, d):
    return analysis(spark, d).occupancy.select("Unite").distinct()


def q_extract_building_code(spark, d):
    m = B.meters(spark, d)
    return m.select("resource", "ordinal", "batiment", meter_building_code("batiment").alias("code")).distinct()


def q_map_building_codes(spark, d):
    return analysis(spark, d).meters.select("resource", "ordinal", "num_bat").distinct()


def _rows(a: Analysis):
    return M.drop_excluded(M.pre_aggregated(a.latest, a.cfg), a.cfg)


def q_positional_codes(spark, d):
    """The i-th row of a sheet takes the i-th code of a list as long as the sheet."""
    sheet = read_sheet(spark, f"{d}/supplier.parquet", "parquet")
    codes = B.code_map(spark, d).select(F.col("ordinal").alias("position"), "num_bat")
    return X.positional_code_map(sheet, "fod", codes).filter(X.as_many_rows(sheet, "fod", codes))


def q_conso_state(spark, d):
    a = analysis(spark, d)
    return A.conso_state(_rows(a), a.inputs.state)


def q_conso_occupancy(spark, d):
    a = analysis(spark, d)
    return A.conso_occupancy(A.conso_state(_rows(a), a.inputs.state), a.occupancy)


def q_allocate_area(spark, d):
    e = analysis(spark, d).enriched
    return e.select(
        "resource", "ordinal", "num_bat", "Unite", "metrage_unite_ajus", "metrage_batiment", "derniere_conso",
        "ratio_metre", "conso",
    )


def q_allocate_cost(spark, d):
    e = analysis(spark, d).enriched
    return e.select("resource", "ordinal", "num_bat", "Unite", "count_pers", "cout", "cout_par_m2", "cout_par_pers")


def q_export_enriched(spark, d):
    e = sheet_analysis(spark, d, beside=with_shown).enriched_wide
    own = [c for c in e.columns if c.startswith("Evol_") or c.endswith("_conso") and c[:4].isdigit()]
    return e.select("resource", "ordinal", "num_bat", "Unite", "metrage_unite", *own, "derniere_conso", "cout", *[c for c in e.columns if c.startswith((AS_SHOWN, AS_KIND))])


def q_enriched_elec(spark, d):
    return sheet_analysis(spark, d, beside=with_shown).enriched_table("elec")


def q_enriched_gaz(spark, d):
    return sheet_analysis(spark, d, beside=with_shown).enriched_table("gaz")


def q_enriched_eau(spark, d):
    return sheet_analysis(spark, d, beside=with_shown).enriched_table("eau")


def q_enriched_fod(spark, d):
    return sheet_analysis(spark, d, beside=with_shown).enriched_table("fod")


def q_enriched_reseau(spark, d):
    return sheet_analysis(spark, d, beside=with_shown).enriched_table("reseau")


def q_published_run(spark, d):
    """All eight tables written and published as one run, read back through its
    manifest: their rows, the consumption and cost that they hold."""
    path = scratch_folder(spark, "published")
    a = sheet_analysis(spark, d, scratch_folder(spark, "work"))
    publish_run(a, path, dt.date(2025, 1, 31))
    tables = latest_run(spark, path).tables(spark)
    rows = []
    for name, df in tables.items():
        values = [c for c in df.columns if c.startswith("conso_") or c.startswith("cout_")]
        sums = [sum_na_rm(F.when(F.abs(named(c)) < float("inf"), named(c))).alias(c) for c in values]
        sums = df.agg(F.count(F.lit(1)).alias("n_rows"), *sums)
        rows.append(sums.select(F.lit(name).alias("table"), "n_rows", F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.col, values)))).alias("column", "total")))
    return reduce(DataFrame.unionByName, rows)


def q_first_per_building(spark, d):
    return analysis(spark, d).stats.select("resource", "num_bat", F.col("d_first").alias("derniere_conso"))


def q_building_intensity(spark, d):
    a = analysis(spark, d)
    return A.building_intensity(a.stats, a.occupancy, a.inputs.state).select(
        "resource", "num_bat", "derniere_conso", "metrage_batiment", "etat_energie", "conso_m2", "cout_m2"
    )


def q_global_cost(spark, d):
    return analysis(spark, d).global_cost


def q_global_cost_total(spark, d):
    a = analysis(spark, d)
    return A.global_cost(a.stats_all, a.cfg, with_total=True)


def q_by_building(spark, d):
    return analysis(spark, d).by_building


def q_by_unit(spark, d):
    return analysis(spark, d).by_unit


def q_by_building_unit(spark, d):
    return analysis(spark, d).by_building_unit


def q_redistribute_unit_contains(spark, d):
    return analysis(spark, d).redistribute_by_unit("contains")


def q_redistribute_unit_token(spark, d):
    return analysis(spark, d).redistribute_by_unit("token")


def q_redistribute_building_unit(spark, d):  # labels hold codes of other buildings
    return analysis(spark, d).redistribute_by_building_unit("contains")


def q_series_by_year(spark, d):
    return analysis(spark, d).series_by_year


def q_series_by_year_raw(spark, d):
    return analysis(spark, d).series_by_year_raw


def q_series_by_building(spark, d):
    return analysis(spark, d).series_by_building


def q_series_by_unit(spark, d):
    return analysis(spark, d).series_by_unit


def q_year_over_year(spark, d):
    return analysis(spark, d).year_over_year


# ------------------------------ SQL oracles --------------------------------
# FIXED VALUES below (patterns, aliases, prices, shares): stated a second time
# on purpose, so that the oracle does not depend on config.py.
HEADCOUNT_SQL = """CASE WHEN Nom_occupants IS NULL THEN NULL
            WHEN contains(Nom_occupants, '4 personnes') THEN 4.0
            WHEN regexp_matches(Nom_occupants, 'Locaux|véhicules|\\?|COMMUN|Salle|salle') THEN 0.0
            ELSE CAST(len(regexp_extract_all(Nom_occupants, ',|/| et | - |\\+|;')) + 1 AS DOUBLE) END"""

CANON_SQL = "CASE WHEN upper(Unite) = 'SDAR MUTUALISÉ' THEN 'SDAR' ELSE upper(Unite) END"

OCC_COLS = ["metrage_unite", "metrage_unite_ajus", "pers_unite", "metrage_batiment"]

YEARS = list(range(2015, 2022))

UNIT_SQL = "CASE {r} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.UNIT_LABELS.items()) + " END"


FIRST_YEARS = {"elec": 2015, "eau": 2016, "gaz": 2015, "reseau": 2017, "fod": 2019}
WITHOUT_VARIATION = ("reseau",)


def _std_sql(resources=tuple(FIRST_YEARS)) -> str:
    """The standardised sheets: one row per meter, the years and variations of its
    sheet, NULL in the columns that the sheet lacks."""
    y1, y2 = YEARS[-2], YEARS[-1]
    parts = []
    for r in resources:
        first = FIRST_YEARS[r]
        sums = ", ".join(f'sum(CASE WHEN greatest(year, {first}) = {y} THEN conso END) AS "{y}_conso"' for y in YEARS)
        ycols = ", ".join(f'"{y}_conso"' for y in YEARS)
        d = f'("{y2}_conso" - "{y1}_conso")'
        pct = f'(CASE WHEN "{y1}_conso" = 0 THEN {d} * \'inf\'::DOUBLE ELSE {d} / "{y1}_conso" END) * 100.0'
        if r in WITHOUT_VARIATION:
            d = pct = "CAST(NULL AS DOUBLE)"
        parts.append(
            f'SELECT resource, batiment, {ycols}, {d} AS "Evol_{y1}-{y2}", {pct} AS "Evol_{y1}-{y2}_p", "{y2}_conso" AS derniere_conso, ordinal '
            f"FROM (SELECT resource, batiment, ordinal, {sums} FROM v_meters WHERE resource = '{r}' GROUP BY resource, ordinal, batiment) w"
        )
    return " UNION ALL ".join(parts)


STD_DOUBLES = [f'"{y}_conso"' for y in YEARS] + ['"Evol_2020-2021"', '"Evol_2020-2021_p"', "derniere_conso"]


def _redistribute_sql(source: str, join: str, key: str) -> str:
    sums = ", ".join(
        f"CASE WHEN count(r.{v}) = count(*) THEN sum(r.{v} / r.countU) END AS {v}b" for v in S.VALUES
    )
    return f"SELECT {key}, {sums} FROM {source} {join} GROUP BY {key}"


BY_UNIT_SQL = f"""SELECT *, {S.members('Unite')} AS countU, {S.row_sum(S.COSTS)} AS cout_global_unite FROM by_unit"""
BY_BU_SQL = f"""SELECT *, {S.members('Unite')} AS countU, coalesce(num_bat, 'NA') || '-' || Unite AS batu,
       {S.row_sum(S.COSTS)} AS cout_global_batunite FROM by_building_unit"""

YEAR_ROWS_SQL = """
  SELECT resource, num_bat, year, conso FROM meters WHERE resource <> 'elec'
  UNION ALL
  SELECT resource, num_bat, year, coalesce(sum(CASE WHEN isnan(conso) THEN NULL ELSE conso END), 0.0)
  FROM meters WHERE resource = 'elec' GROUP BY resource, num_bat, year"""

def _export_sql(select: str) -> str:
    """``select`` over the wide meter rows ``k`` joined with state ``s``, occupancy
    ``o`` and prices ``p``: electricity summed per building, the others as read."""
    sums = ", ".join(f"coalesce(sum(CASE WHEN isnan({c}) THEN NULL ELSE {c} END), 0.0) AS {c}" for c in STD_DOUBLES)
    return f"""WITH coded AS (
  SELECT w.*, CASE WHEN w.resource = 'fod' THEN c.num_bat ELSE substring(w.batiment, 5, 4) END AS num_bat
  FROM ({_std_sql()}) w LEFT JOIN v_code_map c ON w.resource = c.resource AND w.ordinal = c.ordinal),
wide AS (
  SELECT resource, ordinal, batiment, num_bat, {", ".join(STD_DOUBLES)} FROM coded WHERE resource <> 'elec'
  UNION ALL
  SELECT resource, min(ordinal), NULL, num_bat, {sums} FROM coded WHERE resource = 'elec' GROUP BY resource, num_bat),
k AS (
  SELECT * FROM wide
  WHERE NOT ((resource = 'elec' AND coalesce(num_bat IN ('irag'), false))
          OR (resource = 'eau' AND coalesce(num_bat IN ('sage'), false)))),
x AS (
  SELECT k.*, s.Site AS Site_etat, s.nom_bat, s.etat_energie, o.Site AS Site_occup, o.Unite, o.metrage_unite,
         o.metrage_unite_ajus, o.pers_unite, o.metrage_batiment, o.count_pers, p.price, p.coef,
         CASE WHEN o.metrage_batiment = 0 THEN o.metrage_unite_ajus * 'inf'::DOUBLE
              ELSE o.metrage_unite_ajus / o.metrage_batiment END AS ratio_metre
  FROM k
  LEFT JOIN v_state s ON k.num_bat IS NOT DISTINCT FROM s.num_bat
  LEFT JOIN occupancy o ON k.num_bat IS NOT DISTINCT FROM o.num_bat
  JOIN prices p ON p.resource = k.resource),
e AS (SELECT *, derniere_conso * ratio_metre AS conso, derniere_conso * ratio_metre * price * coef AS cout FROM x)
SELECT {select} FROM e"""


def _sheet_doubles(r: str) -> list[str]:
    """The number columns that a resource's sheet holds."""
    gone = [f'"{y}_conso"' for y in YEARS if y < FIRST_YEARS[r]] + (['"Evol_2020-2021"', '"Evol_2020-2021_p"'] if r in WITHOUT_VARIATION else [])
    return [c for c in STD_DOUBLES if c not in gone]


def _enriched_sql(r: str) -> str:
    label = "" if r in C.PRE_AGGREGATE else "batiment, "
    return _export_sql(
        f"""{label}num_bat, {", ".join(_sheet_doubles(r))}, Site_etat, nom_bat, etat_energie, Site_occup, Unite,
       metrage_unite, metrage_unite_ajus, pers_unite, metrage_batiment, count_pers, ratio_metre,
       conso AS conso_{r}, cout AS cout_{r},
       CASE WHEN metrage_unite_ajus = 0 THEN cout * 'inf'::DOUBLE ELSE cout / metrage_unite_ajus END AS cout_par_m2,
       CASE WHEN count_pers = 0 THEN cout * 'inf'::DOUBLE ELSE cout / count_pers END AS cout_par_pers"""
    ) + f" WHERE resource = '{r}'"


def _enriched_doubles(r: str) -> list[str]:
    return [*_sheet_doubles(r), *OCC_COLS, "ratio_metre", f"conso_{r}", f"cout_{r}", "cout_par_m2", "cout_par_pers"]


REPORT_DOUBLES = [x for pair in zip(S.VALUES, S.COSTS) for x in pair]


def _series_sql(key: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{r}' AS resource, {key}, {C.VALUE_COLUMNS[r]} AS value FROM ({BY_BU_SQL}) b" for r in C.REPORT_ORDER
    )
    return (
        f"SELECT resource, {key}, coalesce(sum(CASE WHEN isnan(value) THEN NULL ELSE value END), 0.0) AS total_conso "
        f"FROM ({parts}) u GROUP BY resource, {key}"
    )


def _published_sql() -> str:
    """Rows, consumption and cost of the eight tables, each summed on its own."""
    tables = {f"enriched_{r}": (_enriched_sql(r), [f"conso_{r}", f"cout_{r}", "cout_par_m2", "cout_par_pers"]) for r in C.REPORT_ORDER}
    tables["by_building"] = (f"SELECT *, {S.row_sum(S.COSTS)} AS cout_global_bat FROM by_building", [*REPORT_DOUBLES, "cout_global_bat"])
    tables["by_unit"] = (BY_UNIT_SQL, [*REPORT_DOUBLES, "cout_global_unite"])
    tables["by_building_unit"] = (BY_BU_SQL, [*REPORT_DOUBLES, "cout_global_batunite"])
    parts = []
    for name, (sql, columns) in tables.items():
        for c in columns:
            parts.append(
                f"""SELECT '{name}' AS "table", count(*) AS n_rows, '{c}' AS "column",
  coalesce(sum(CASE WHEN isnan({c}) OR abs({c}) = 'inf'::DOUBLE THEN NULL ELSE {c} END), 0.0) AS total FROM ({sql}) t"""
            )
    return " UNION ALL ".join(parts)


SQL: dict[str, tuple[str, list[str]]] = {
    "scan_sheet": (
        """SELECT c_custkey AS ordinal, c_custkey, trim(c_name) AS c_name,
       CASE WHEN trim(c_mktsegment) IN ('BUILDING', 'MACHINERY', '') THEN NULL ELSE trim(c_mktsegment) END AS c_mktsegment
FROM customer""",
        [],
    ),
    "scan_csv_breaks": (
        """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_suppkey AS BIGINT) AS l_suppkey,
       l_returnflag || ' "' || l_linestatus || '"' || chr(10) || strftime(l_shipdate, '%Y-%m-%d') || ', ' || CAST(l_partkey AS VARCHAR) AS note,
       CAST(l_quantity AS DOUBLE) AS l_quantity
FROM lineitem""",
        ["l_quantity"],
    ),
    "scan_na_tokens": (
        """SELECT resource, ordinal, year,
       CASE WHEN conso IS NULL OR (ordinal % 17 = 0 AND year = 2015) THEN NULL ELSE conso END AS conso
FROM v_meters""",
        ["conso"],
    ),
    "standardise_headers": (_std_sql(), STD_DOUBLES),
    "extract_years": (
        """SELECT resource, ordinal, year,
       array_to_string(regexp_extract_all('Différence ' || CAST(year - 1 AS VARCHAR) || ' et ' || CAST(year AS VARCHAR)
                                          || ' ' || batiment, '20[0-9]{2}'), ',') AS years
FROM v_meters""",
        [],
    ),
    "latest_year": ("SELECT * FROM latest", ["derniere_conso"]),
    "unpivot_years": (
        f"""SELECT k.resource, k.ordinal, k.batiment, y.year, sum(m.conso) AS conso
FROM (SELECT DISTINCT resource, ordinal, batiment FROM v_meters) k
JOIN (SELECT resource, unnest(range(first, {YEARS[-1] + 1}))::INTEGER AS year, first
      FROM (VALUES {", ".join(f"('{r}', {y})" for r, y in FIRST_YEARS.items())}) AS f(resource, first)) y ON y.resource = k.resource
LEFT JOIN v_meters m ON m.resource = k.resource AND m.ordinal = k.ordinal AND m.batiment = k.batiment
  AND greatest(m.year, y.first) = y.year
GROUP BY k.resource, k.ordinal, k.batiment, y.year""",
        ["conso"],
    ),
    "sum_all_numeric": (
        "SELECT substring(batiment, 5, 4) AS num_bat, "
        + ", ".join(
            f"coalesce(sum(CASE WHEN isnan({c}) THEN NULL ELSE {c} END), 0.0) AS {c}" for c in STD_DOUBLES
        )
        + f" FROM ({_std_sql(("elec",))}) s GROUP BY 1",
        STD_DOUBLES,
    ),
    "filter_soft_delete": (
        "SELECT Site, num_bat, Local, Unite, Surface_sol, Surface_ajus, Nom_occupants FROM v_rooms WHERE a_supprimer = 'NON'",
        ["Surface_sol", "Surface_ajus"],
    ),
    "text_separator_count": (
        "SELECT Local, Nom_occupants, CAST(len(regexp_extract_all(Nom_occupants, ',|/| et | - |\\+|;')) AS BIGINT) AS n_sep FROM v_rooms",
        [],
    ),
    "headcount_estimate": (f"SELECT Local, Nom_occupants, {HEADCOUNT_SQL} AS count_pers0 FROM v_rooms", ["count_pers0"]),
    "canonical_unit": (f"SELECT Local, Unite, {CANON_SQL} AS unit_canon FROM v_rooms", []),
    "member_count": (f"SELECT Local, Unite, {S.members('Unite')} AS countU FROM v_rooms", ["countU"]),
    "occupancy_by_building": ("SELECT * FROM occ_bld", ["metrage_batiment"]),
    "occupancy_by_unit_raw": ("SELECT * FROM occ_unit", OCC_COLS[:3]),
    "occupancy_with_building_total": ("SELECT * FROM occ_total", OCC_COLS),
    "filter_not_in_null_safe": ("SELECT * FROM occ_not_in", OCC_COLS),
    "filter_contains": ("SELECT * FROM occ_site", OCC_COLS),
    "drop_incomplete": ("SELECT * FROM occ_complete", OCC_COLS),
    "staff_count": ("SELECT * FROM staff_count", []),
    "occupancy_staff": ("SELECT * FROM occupancy", OCC_COLS),
    "surface_by_unit": (
        """SELECT CASE WHEN upper(Unite) = 'SDAR MUTUALISÉ' THEN 'SDAR' WHEN upper(Unite) = 'LEPSE/IPSIM' THEN 'LEPSE/IPSiM'
            ELSE upper(Unite) END AS Unite2,
       CASE WHEN count(metrage_unite) = count(*) THEN sum(metrage_unite) END AS sum_metrage,
       CASE WHEN count(metrage_unite_ajus) = count(*) THEN sum(metrage_unite_ajus) END AS sum_metrage_ajus
FROM occupancy GROUP BY 1""",
        ["sum_metrage", "sum_metrage_ajus"],
    ),
    "distinct_units": ("SELECT DISTINCT Unite FROM occupancy", []),
    "extract_building_code": (
        "SELECT DISTINCT resource, ordinal, batiment, substring(batiment, 5, 4) AS code FROM v_meters",
        [],
    ),
    "map_building_codes": ("SELECT DISTINCT resource, ordinal, num_bat FROM meters", []),
    "positional_codes": (
        """SELECT 'fod' AS resource, row_number() OVER (ORDER BY s_suppkey) - 1 AS ordinal, lpad(CAST(s_suppkey % 40 AS VARCHAR), 4, '0') AS num_bat
FROM supplier""",
        [],
    ),
    "conso_state": ("SELECT * FROM conso_state", ["derniere_conso"]),
    "conso_occupancy": ("SELECT * FROM joined", ["derniere_conso"] + OCC_COLS),
    "allocate_area": (
        """SELECT resource, ordinal, num_bat, Unite, metrage_unite_ajus, metrage_batiment, derniere_conso, ratio_metre, conso
FROM allocated""",
        ["metrage_unite_ajus", "metrage_batiment", "derniere_conso", "ratio_metre", "conso"],
    ),
    "allocate_cost": (
        "SELECT resource, ordinal, num_bat, Unite, count_pers, cout, cout_par_m2, cout_par_pers FROM allocated",
        ["cout", "cout_par_m2", "cout_par_pers"],
    ),
    "export_enriched": (
        _export_sql(f'resource, ordinal, num_bat, Unite, metrage_unite, {", ".join(STD_DOUBLES)}, cout'),
        ["metrage_unite", *STD_DOUBLES, "cout"],
    ),
    **{f"enriched_{r}": (_enriched_sql(r), _enriched_doubles(r)) for r in C.REPORT_ORDER},
    "published_run": (_published_sql(), ["total"]),
    "first_per_building": ("SELECT resource, num_bat, derniere_conso FROM first_rows", ["derniere_conso"]),
    "building_intensity": (
        "SELECT * FROM intensity",
        ["derniere_conso", "metrage_batiment", "conso_m2", "cout_m2"],
    ),
    "global_cost": (
        """SELECT resource, CASE WHEN count(x) = count(*) THEN sum(x) END AS total,
       (CASE WHEN count(x) = count(*) THEN sum(x) END) * 0.6::DOUBLE AS share
FROM (SELECT r.resource, r.derniere_conso * p.price * p.coef AS x FROM conso_rows r JOIN prices p ON p.resource = r.resource) c
GROUP BY resource""",
        ["total", "share"],
    ),
    "global_cost_total": (
        """SELECT resource, CAST(grouping(resource) AS INTEGER) AS is_total, CASE WHEN count(x) = count(*) THEN sum(x) END AS total,
       (CASE WHEN count(x) = count(*) THEN sum(x) END) * 0.6::DOUBLE AS share
FROM (SELECT r.resource, r.derniere_conso * p.price * p.coef AS x FROM conso_rows r JOIN prices p ON p.resource = r.resource) c
GROUP BY GROUPING SETS ((resource), ())""",
        ["total", "share"],
    ),
    "by_building": (
        f"SELECT *, {S.row_sum(S.COSTS)} AS cout_global_bat FROM by_building",
        ["metrage_batiment"] + REPORT_DOUBLES + ["cout_global_bat"],
    ),
    "by_unit": (BY_UNIT_SQL, REPORT_DOUBLES + ["countU", "cout_global_unite"]),
    "by_building_unit": (BY_BU_SQL, REPORT_DOUBLES + ["countU", "cout_global_batunite"]),
    "redistribute_unit_contains": (
        _redistribute_sql(
            f"(SELECT DISTINCT Unite AS unit FROM by_unit WHERE Unite IS NOT NULL AND NOT contains(Unite, '/')) u",
            f"JOIN ({BY_UNIT_SQL}) r ON r.Unite IS NOT NULL AND contains(r.Unite, u.unit)",
            "u.unit AS Unite",
        ).replace("GROUP BY u.unit AS Unite", "GROUP BY u.unit"),
        [v + "b" for v in S.VALUES],
    ),
    "redistribute_unit_token": (
        _redistribute_sql(
            f"(SELECT DISTINCT Unite AS unit FROM by_unit WHERE Unite IS NOT NULL AND NOT contains(Unite, '/')) u",
            f"JOIN ({BY_UNIT_SQL}) r ON r.Unite IS NOT NULL AND list_contains(string_split(r.Unite, '/'), u.unit)",
            "u.unit AS Unite",
        ).replace("GROUP BY u.unit AS Unite", "GROUP BY u.unit"),
        [v + "b" for v in S.VALUES],
    ),
    "redistribute_building_unit": (
        _redistribute_sql(
            f"(SELECT DISTINCT num_bat, Unite, batu FROM ({BY_BU_SQL}) x WHERE NOT contains(batu, '/')) k",
            f"JOIN ({BY_BU_SQL}) r ON contains(r.batu, k.Unite) AND contains(r.batu, coalesce(k.num_bat, 'NA'))",
            "k.batu",
        ),
        [v + "b" for v in S.VALUES],
    ),
    "series_by_year": (
        f"""SELECT y.resource, y.year, coalesce(sum(CASE WHEN isnan(y.conso) THEN NULL ELSE y.conso END), 0.0) AS total
FROM (SELECT * FROM ({YEAR_ROWS_SQL}) a
      WHERE NOT ((resource = 'elec' AND coalesce(num_bat IN ('irag'), false))
              OR (resource = 'eau' AND coalesce(num_bat IN ('sage'), false)))) y
LEFT JOIN v_state s ON y.num_bat IS NOT DISTINCT FROM s.num_bat
LEFT JOIN occupancy o ON y.num_bat IS NOT DISTINCT FROM o.num_bat
GROUP BY y.resource, y.year""".replace(
            "SELECT y.resource, y.year,", f"SELECT y.resource, y.year, {UNIT_SQL.format(r='y.resource')} AS unit,"
        ),
        ["total"],
    ),
    "series_by_year_raw": (
        f"""SELECT resource, year, coalesce(sum(CASE WHEN isnan(conso) THEN NULL ELSE conso END), 0.0) AS total,
       {UNIT_SQL.format(r='resource')} AS unit
FROM meters GROUP BY resource, year""",
        ["total"],
    ),
    "series_by_building": (_series_sql("num_bat"), ["total_conso"]),
    "series_by_unit": (_series_sql("Unite"), ["total_conso"]),
    "year_over_year": (
        """SELECT resource, num_bat, year, conso, conso_prev, evol,
       (CASE WHEN conso_prev = 0 THEN evol * 'inf'::DOUBLE ELSE evol / conso_prev END) * 100.0 AS evol_pct
FROM (SELECT y.*, p.conso AS conso_prev, y.conso - p.conso AS evol
      FROM (SELECT resource, num_bat, year, coalesce(sum(CASE WHEN isnan(conso) THEN NULL ELSE conso END), 0.0) AS conso
            FROM meters GROUP BY resource, num_bat, year) y
      LEFT JOIN (SELECT resource, num_bat, year, coalesce(sum(CASE WHEN isnan(conso) THEN NULL ELSE conso END), 0.0) AS conso
                 FROM meters GROUP BY resource, num_bat, year) p
        ON p.resource = y.resource AND p.num_bat IS NOT DISTINCT FROM y.num_bat AND p.year = y.year - 1)""",
        ["conso", "conso_prev", "evol", "evol_pct"],
    ),
}

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        return lambda spark, sf_dir: round4(fn(spark, sf_dir))

    return {name: wrap(fn) for name, fn in SPARK.items()}


def oracle_sql() -> dict[str, str]:
    return {name: S.rounded(final, doubles) for name, (final, doubles) in SQL.items() if name in SPARK}
