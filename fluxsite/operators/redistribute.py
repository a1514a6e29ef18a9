"""Redistribution of shared premises ('A/B' labels) to their member units.

For every standalone unit u (a label without '/'), each report row j whose
label contains u gives ``value_j / countU_j``; a missing value poisons the
sum. The reference tests every (unit, row) pair in an interpreted loop. Here
an automaton over the unit names finds all units of a label in one pass
(``matching``), and the shares are summed per unit in one aggregation; a unit
is kept when a row of the report is that unit itself. No pair of rows is ever
enumerated.

The building and unit form tests both the unit and the building code against
the whole label 'num_bat-Unite', as the reference does: a code inside the label
of another building counts.

``method="token"`` matches whole '/'-separated members instead; it equals
the contained form when no unit name is a proper substring of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxsite.config import AnalysisConfig
from fluxsite.functions.nulls import strict_sum
from fluxsite.functions.text import label_tokens, member_count
from fluxsite.operators.matching import NAMES, names_in_labels

METHODS = ("contains", "token")


def redistributed_names(cfg: AnalysisConfig = AnalysisConfig()) -> dict[str, str]:
    return {r: cfg.value_columns[r] + "b" for r in cfg.resources}


def building_label(num_bat: Column) -> Column:
    """A building code as the labels show it: NULL is written 'NA'."""
    return F.coalesce(num_bat, F.lit("NA"))


def _rows(report: DataFrame, keys, method: str, cfg: AnalysisConfig) -> DataFrame:
    """The report's rows with a unit: keys, unit and each value's share of one member."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    k = member_count("Unite")
    vals = [cfg.value_columns[r] for r in cfg.resources]
    return report.filter(F.col("Unite").isNotNull()).select(*keys, "Unite", *[(F.col(v) / k).alias(v) for v in vals])


def standalone(names: DataFrame, column: str = "Unite") -> DataFrame:
    """(name): the labels without '/'."""
    return names.filter(~F.col(column).contains("/")).select(F.col(column).alias("name"))


def _strict_shares(cfg: AnalysisConfig):
    names = redistributed_names(cfg)
    return [strict_sum(F.col(cfg.value_columns[r])).alias(names[r]) for r in cfg.resources]


def redistribute_by_unit(
    report: DataFrame, method: str = "contains", cfg: AnalysisConfig = AnalysisConfig(), names: DataFrame | None = None, most: int = NAMES
) -> DataFrame:
    """Per standalone unit of ``report`` (the per-unit report): the sum of the
    shares of every row whose label contains it (consumption only). ``names``
    (column ``Unite``) holds at least the report's units and spares reading the
    report a second time for them.

    One aggregation keyed by the unit found: it is output when one of its rows
    is the standalone unit itself, so the report is read once and joined with
    nothing. Partial aggregation combines frequent units before the shuffle."""
    rows = _rows(report, [], method, cfg)
    if method == "contains":
        found = names_in_labels(rows, "Unite", standalone(report if names is None else names), most)
        p = found.select("*", F.explode("names").alias("piece"))
    else:
        p = rows.select("*", F.explode(label_tokens("Unite")).alias("piece"))
    g = p.groupBy("piece").agg(F.max(F.col("Unite") == F.col("piece")).alias("_unit"), *_strict_shares(cfg))
    g = g.filter(F.col("_unit") & ~F.col("piece").contains("/"))
    return g.drop("_unit").withColumnRenamed("piece", "Unite")


def redistribute_by_building_unit(
    report: DataFrame,
    method: str = "contains",
    cfg: AnalysisConfig = AnalysisConfig(),
    names: DataFrame | None = None,
    codes: DataFrame | None = None,
    most: int = NAMES,
) -> DataFrame:
    """Per standalone (building, unit) key of ``report`` (the per building and unit
    report): the shares of every row whose label 'num_bat-Unite' contains both the
    unit and the building code (``token``: whose building it is and of whose members
    the unit is one). The key's own label must hold no '/'. ``names`` (``Unite``) and
    ``codes`` (``num_bat``) hold at least the units and buildings of the report."""
    rows = _rows(report, ["num_bat"], method, cfg).withColumn("_code", building_label(F.col("num_bat")))
    rows = rows.withColumn("_label", F.concat("_code", F.lit("-"), F.col("Unite")))
    if method == "contains":
        units = standalone(report if names is None else names)
        known = (report if codes is None else codes).select(building_label(F.col("num_bat")).alias("num_bat"))
        # each unit and each code of a label meet in one pair of parts
        found = names_in_labels(rows, "_label", units, most).withColumnRenamed("names", "units").filter(F.size("units") > 0)
        found = names_in_labels(found, "_label", standalone(known, "num_bat"), most)
        pairs = found.withColumn("unit", F.explode("units")).withColumn("code", F.explode("names"))
    else:
        pairs = rows.withColumn("unit", F.explode(label_tokens("Unite"))).withColumn("code", F.col("_code"))
    own = (F.col("Unite") == F.col("unit")) & (F.col("_code") == F.col("code")) & ~F.col("_label").contains("/")
    g = pairs.groupBy("code", "unit").agg(F.max(own).alias("_key"), *_strict_shares(cfg))
    out = redistributed_names(cfg)
    return g.filter(F.col("_key")).select(F.concat_ws("-", "code", "unit").alias("batu"), *[out[r] for r in cfg.resources])
