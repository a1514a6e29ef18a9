"""Test-data bindings: the driver's parquet tables seen as the campus inputs.

The analysis inputs are spreadsheets that do not ship with the reference, so
the driver tables stand in for them. Every row of the source tables is used;
the rules below only map values (modulo maps give the building and unit
vocabulary), they never filter. ``sql.py`` holds the same views in SQL.

rooms   <- part      one room per part
meters  <- lineitem  one reading per (supplier, line number -> resource, ship year)
state   <- supplier  one building state per supplier code
staff   <- customer  one staff member per customer
code_map<- supplier  positional building codes of the fuel-oil sheet
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxsite import config as C
from fluxsite.plans.analysis import Inputs

N_BUILDINGS = 40
GAILLARDE_BUILDINGS = 32
NULL_YEAR = 2021
NULL_RESOURCE = "gaz"


# Header years of the stand-in sheets (line items are shipped 20 years earlier).
SHEET_YEARS = tuple(range(2015, 2022))
YEAR_SHIFT = 20
# Each sheet has columns of its own: years from a first one on (older readings count into
# it), and not all have the variation columns.
FIRST_SHEET_YEAR = {"elec": 2015, "eau": 2016, "gaz": 2015, "reseau": 2017, "fod": 2019}
SHEETS_WITHOUT_VARIATION = ("reseau",)


class _Opened:
    """The tables of one set of inputs, each opened (listed, schema read) once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def table(self, path: str) -> DataFrame:
        if path not in self.tables:
            self.tables[path] = self.spark.read.parquet(path)
        return self.tables[path]


def _read(source: SparkSession | _Opened, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return source.table(path) if isinstance(source, _Opened) else source.read.parquet(path)


def _code(x) -> F.Column:
    return F.lpad((x % N_BUILDINGS).cast("string"), 4, "0")


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    unite = (
        F.when(k % 23 == 0, F.lit(None).cast("string"))
        .when(k % 19 == 0, F.lit("IA"))
        # shared premises whose label holds the code of some building
        .when(k % 29 == 0, F.concat(F.col("p_brand"), F.lit("/B"), _code(k * 7)))
        .when(k % 13 == 0, F.concat(F.col("p_brand"), F.lit("/Brand#"), (F.col("p_size") % 25 + 1).cast("string")))
        .when(k % 7 == 0, F.lower("p_brand"))
        .otherwise(F.col("p_brand"))
    )
    m9 = k % 9
    occupants = (
        F.when(m9 == 0, F.lit(None).cast("string"))
        .when(m9 == 1, F.concat(F.lit("Locaux "), name))
        .when(m9 == 2, F.replace(name, F.lit(" "), F.lit(", ")))
        .when(m9 == 3, F.replace(name, F.lit(" "), F.lit(" et ")))
        .when(m9 == 4, F.concat(F.lit("Salle "), name))
        .when(m9 == 5, F.lit("4 personnes"))
        .when(m9 == 6, F.replace(name, F.lit(" "), F.lit(" - ")))
        .when(m9 == 7, F.concat(name, F.lit(" ?")))
        .otherwise(name)
    )
    flag = F.when(k % 11 == 0, F.lit("OUI")).when(k % 11 == 1, F.lit(None).cast("string")).otherwise(F.lit("NON"))
    return p.select(
        F.when(k % N_BUILDINGS < GAILLARDE_BUILDINGS, F.lit("La Gaillarde")).otherwise(F.lit("Lavalette")).alias("Site"),
        _code(k).alias("num_bat"),
        k.cast("string").alias("Local"),
        F.col("p_type").alias("Nom_usuel_local"),
        F.col("p_size").cast("double").alias("Surface_sol"),
        unite.alias("Unite"),
        occupants.alias("Nom_occupants"),
        F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("p_size").cast("double") * F.lit(0.75)).alias("Surface_ajus"),
        flag.alias(C.SOFT_DELETE_COLUMN),
    )


def meters(spark: SparkSession, sf_dir: str, since: DataFrame | None = None) -> DataFrame:
    """Readings summed per (supplier, resource, year) on integer keys; the
    label, a function of the supplier, is built once per reading, not once
    per line item. ``since`` (one row: year) bounds the scan by date."""
    li = _read(spark, sf_dir, "lineitem")
    if since is not None:
        zero, one = F.lit(0), F.lit(1)
        start = F.make_timestamp_ntz(F.col("year") - YEAR_SHIFT, one, one, zero, zero, zero)
        li = li.filter(F.col("l_shipdate") >= since.select(start).scalar())
    year = F.year("l_shipdate") + YEAR_SHIFT
    # buildings that read 2018 together with 2017: a year is missing there
    year = F.when((F.col("l_suppkey") % 8 == 3) & (year == 2018), 2017).otherwise(year)
    g = li.groupBy(
        ((F.col("l_linenumber") - 1) % 5 + 1).cast("int").alias("res_idx"),
        F.col("l_suppkey").alias("ordinal"),
        year.cast("int").alias("year"),
    ).agg(F.sum("l_quantity").alias("conso"))
    s = F.col("ordinal")
    res = F.element_at(F.array(*[F.lit(r) for r in C.SHEET_ORDER]), F.col("res_idx"))
    code = F.when(s % 41 == 7, F.lit("irag")).when(s % 43 == 5, F.lit("sage")).otherwise(_code(s))
    label = F.concat(F.lit("MTP-"), code, F.lit(" compteur "), s.cast("string"))
    missing = (res == F.lit(NULL_RESOURCE)) & (s % 97 == 3) & (F.col("year") == NULL_YEAR)
    return g.select(
        res.alias("resource"),
        "ordinal",
        label.alias("batiment"),
        "year",
        F.when(missing, F.lit(None).cast("double")).otherwise(F.col("conso")).alias("conso"),
    )


def sheet_years(resource: str) -> list[int]:
    """Header years of a resource's sheet."""
    return [y for y in SHEET_YEARS if y >= FIRST_SHEET_YEAR[resource]]


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A building state per supplier; every seventh building has a second row
    (an annex in another state)."""
    s = _read(spark, sf_dir, "supplier")
    bal, annex = F.col("s_acctbal"), F.col("annex")
    etat = F.when(bal < 0, F.lit("Mauvais")).when(bal < 5000, F.lit("Moyen")).otherwise(F.lit("Bon"))
    copies = F.when(F.col("s_suppkey") % 7 == 3, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return s.withColumn("annex", F.explode(copies)).select(
        F.lit("La Gaillarde").alias("Site"),
        F.format_string("%04d", F.col("s_suppkey")).alias("num_bat"),
        F.when(annex, F.concat("s_name", F.lit(" annexe"))).otherwise(F.col("s_name")).alias("nom_bat"),
        F.when(annex, F.lit("Annexe")).otherwise(etat).alias("etat_energie"),
        (F.col("s_suppkey") + F.when(annex, F.lit(1_000_000_000_000)).otherwise(F.lit(0))).alias("ordinal"),
    )


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    unite = F.when(k % 31 == 0, F.lit(C.STAFF_RECODE_UNIT)).otherwise(F.concat(F.lit("BRAND#"), (k % 25 + 1).cast("string")))
    return c.select(unite.alias("Unite"), F.concat(F.lit("B"), _code(k)).alias("Bat"))


def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    return s.select(F.lit("fod").alias("resource"), F.col("s_suppkey").alias("ordinal"), _code(F.col("s_suppkey")).alias("num_bat"))


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """The five input views of a test-data folder (lazy plans, no job beyond
    opening each file once)."""
    tables = _Opened(spark)
    return Inputs(
        state=state(tables, sf_dir),
        rooms=rooms(tables, sf_dir),
        staff=staff(tables, sf_dir),
        meters=meters(tables, sf_dir),
        code_map=code_map(tables, sf_dir),
        sheet_years={r: list(SHEET_YEARS) for r in C.SHEET_ORDER},
        since=lambda year: meters(tables, sf_dir, year),
    )
