"""Enrichment, area-ratio allocation, pricing and per-building intensity.

State and occupancy are attached to the meter rows in two left joins on the
building code. The state, a row or two a building, comes first. The occupancy
multiplies the rows, by the units of a building, so the work lies behind that
join and not in what it reads: AQE, which goes by bytes read, would leave all of
it to a few tasks. The rows are therefore spread by meter over a given number of
tasks before it (``spread``). Catalyst broadcasts the occupancy when its estimated
size is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE: when its measured size
is), and each task then multiplies its own meters. Beyond that size the join is a
sort-merge join whose two inputs are fresh exchanges with nothing above that needs
a building's rows together, so AQE splits the partition of a hot building.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxsite.config import AnalysisConfig
from fluxsite.functions.nulls import ieee_div

STATE_PREFIX_SITE = "Site_etat"
OCCUP_PREFIX_SITE = "Site_occup"


def price_factor(cfg: AnalysisConfig = AnalysisConfig()) -> tuple[Column, Column]:
    """(price, coefficient) of the row's resource as constant CASE expressions
    (folded by Catalyst; no rates table to join)."""
    price = coef = None
    for r in cfg.resources:
        cond = F.col("resource") == F.lit(r)
        price = (F.when(cond, F.lit(cfg.price(r))) if price is None else price.when(cond, F.lit(cfg.price(r))))
        coef = (F.when(cond, F.lit(cfg.coef(r))) if coef is None else coef.when(cond, F.lit(cfg.coef(r))))
    return price, coef


def priced(x: Column, cfg: AnalysisConfig = AnalysisConfig()) -> Column:
    """x * price * coefficient, in the reference's evaluation order."""
    price, coef = price_factor(cfg)
    return x * price * coef


def null_safe_left_join(left: DataFrame, right: DataFrame, key: str = "num_bat") -> DataFrame:
    """Left join on one key where NULL matches NULL (the reference's join rule)."""
    r = right.withColumnRenamed(key, "_rk")
    return left.join(r, left[key].eqNullSafe(r["_rk"]), "left").drop("_rk")


def state_dimension(state: DataFrame) -> DataFrame:
    """Building state with its site renamed (both inputs carry a Site); its
    file-order key is not carried into the meter rows."""
    return state.drop("ordinal").withColumnRenamed("Site", STATE_PREFIX_SITE)


def occupancy_dimension(occ: DataFrame) -> DataFrame:
    return occ.withColumnRenamed("Site", OCCUP_PREFIX_SITE)


def conso_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Meter rows x building state (left, null-safe on num_bat)."""
    return null_safe_left_join(rows, state_dimension(state))


def spread(rows: DataFrame) -> DataFrame:
    """Meter rows dealt evenly over as many tasks as shuffles have partitions; AQE
    keeps a number of partitions that is asked for."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "resource", "ordinal")


def conso_occupancy(rows: DataFrame, occ: DataFrame) -> DataFrame:
    """Meter rows x occupying units (left, many-to-many on num_bat)."""
    return null_safe_left_join(spread(rows), occupancy_dimension(occ))


def with_dimensions(rows: DataFrame, state: DataFrame, occ: DataFrame) -> DataFrame:
    """Meter rows x state x occupancy (a building's rows meet every combination)."""
    return conso_occupancy(conso_state(rows, state), occ)


def allocate(enriched: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Share of each meter's latest reading for each occupying unit, its cost,
    cost per adjusted m2 and per staff member (IEEE division throughout)."""
    mu, mb = F.col("metrage_unite_ajus"), F.col("metrage_batiment")
    ratio = ieee_div(mu, mb)
    conso = F.col("derniere_conso") * ratio
    cout = priced(conso, cfg)
    return enriched.withColumns(
        {
            "ratio_metre": ratio,
            "conso": conso,
            "cout": cout,
            "cout_par_m2": ieee_div(cout, mu),
            "cout_par_pers": ieee_div(cout, F.col("count_pers")),
        }
    )


def first_rows(rows: DataFrame, order: str) -> DataFrame:
    """The first row of each building. Spark keeps one row per building and task before
    the shuffle (a window group limit), and no aggregate has to carry strings."""
    first = Window.partitionBy("num_bat").orderBy(F.col(order).asc_nulls_last())
    return rows.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") == 1).drop("_first")


def building_occupancy(occ: DataFrame) -> DataFrame:
    """Floor area of each building as the first occupancy row (by site) gives it."""
    return first_rows(occ, "Site").select("num_bat", "metrage_batiment")


def first_state(state: DataFrame, order: str = "ordinal") -> DataFrame:
    """First state row per building (file order)."""
    return first_rows(state, order).select("num_bat", "etat_energie")


def building_intensity(stats: DataFrame, occ: DataFrame, state: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Per (resource, num_bat): first meter's latest reading per m2 of the
    building and its cost per m2, with the building's state."""
    b = stats.select("resource", "num_bat", F.col("d_first").alias("derniere_conso"))
    b = null_safe_left_join(b, building_occupancy(occ))
    b = null_safe_left_join(b, first_state(state))
    conso_m2 = ieee_div(F.col("derniere_conso"), F.col("metrage_batiment"))
    return b.withColumn("conso_m2", conso_m2).withColumn("cout_m2", priced(F.col("conso_m2"), cfg))


def global_cost(stats: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), with_total: bool = False) -> DataFrame:
    """Per resource: priced total of all latest readings (any NULL reading
    makes it NULL) and the research-unit share of it.

    ``with_total`` adds the all-resource total (``resource`` NULL, ``is_total`` 1) as a
    second grouping set of the same aggregation; a NULL resource total poisons it."""
    building_total = F.when(F.col("n_null") == 0, priced(F.col("d_sum"), cfg))
    per_res = stats.select("resource", building_total.alias("t"))
    total = F.when(F.count("t") == F.count(F.lit(1)), F.sum("t"))
    share = F.col("total") * F.lit(cfg.global_share)
    if not with_total:
        return per_res.groupBy("resource").agg(total.alias("total")).withColumn("share", share)
    sets = per_res.groupingSets([["resource"], []], "resource")
    return sets.agg(F.grouping("resource").cast("int").alias("is_total"), total.alias("total")).withColumn("share", share)
