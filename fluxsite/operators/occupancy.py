"""Occupancy: clean the room survey, aggregate it per building and per unit,
attach the building total and the staff head count.

Rooms are the large input; every aggregate here combines map-side before the
shuffle, so a building holding a third of all rooms still ships one partial
row per task and unit. The building total is a window over the already
aggregated unit rows (small), not a second pass over the rooms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxsite.config import AnalysisConfig
from fluxsite.functions.nulls import not_in_null_safe, strict_sum, sum_na_rm
from fluxsite.functions.text import canonical_unit, headcount_estimate, staff_building_code

OCCUPANCY_COLUMNS = [
    "Site",
    "num_bat",
    "Unite",
    "metrage_unite",
    "metrage_unite_ajus",
    "pers_unite",
    "metrage_batiment",
    "count_pers",
]


def filter_soft_delete(rooms: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Keep rows whose soft-delete flag equals the keep value (NULL flags go)."""
    return rooms.filter(F.col(f"`{cfg.soft_delete_column}`") == F.lit(cfg.soft_delete_keep))


def clean_rooms(rooms: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Soft-delete filter plus the estimated head count ``count_pers0``."""
    df = filter_soft_delete(rooms, cfg).withColumn("count_pers0", headcount_estimate("Nom_occupants"))
    if cfg.canonicalise_first:
        df = df.withColumn("Unite", canonical_unit("Unite", cfg.unit_aliases))
    return df


def occupancy_by_building(rooms_clean: DataFrame) -> DataFrame:
    """Floor area per (Site, num_bat), all units included (NULL/NaN skipped)."""
    return rooms_clean.groupBy("Site", "num_bat").agg(sum_na_rm("Surface_sol").alias("metrage_batiment"))


def occupancy_by_unit_raw(rooms_clean: DataFrame) -> DataFrame:
    """Area, adjusted area and head count per (Site, num_bat, raw unit spelling)."""
    return rooms_clean.groupBy("Site", "num_bat", "Unite").agg(
        sum_na_rm("Surface_sol").alias("metrage_unite"),
        sum_na_rm("Surface_ajus").alias("metrage_unite_ajus"),
        sum_na_rm("count_pers0").alias("pers_unite"),
    )


def occupancy_with_building_total(units_raw: DataFrame) -> DataFrame:
    """Attach the building floor area to every unit row of the building.

    Equal to joining ``occupancy_by_building`` back on (Site, num_bat): each
    unit sum already skips missing values, so their total is the building's.
    """
    w = Window.partitionBy("Site", "num_bat")
    return units_raw.withColumn("metrage_batiment", F.sum("metrage_unite").over(w))


def staff_count(staff: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Staff per (num_bat, Unite); the building code comes from 'Bat', one unit
    is recoded to a fixed building before grouping."""
    unit = F.col("Unite")
    code = (
        F.when(unit.isNull(), F.lit(None).cast("string"))
        .when(unit == F.lit(cfg.staff_recode_unit), F.lit(cfg.staff_recode_building))
        .otherwise(staff_building_code("Bat"))
    )
    return staff.select(code.alias("num_bat"), unit).groupBy("num_bat", "Unite").agg(F.count(F.lit(1)).alias("count_pers"))


def research_units(units_with_total: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Canonical unit names, non-research units out (NULL kept until the
    complete-case filter), site filter, complete cases only."""
    df = units_with_total.withColumn("Unite", canonical_unit("Unite", cfg.unit_aliases))
    df = df.filter(not_in_null_safe("Unite", cfg.excluded_units))
    df = df.filter(F.col("Site").contains(cfg.site_pattern))
    return df.dropna(how="any", subset=OCCUPANCY_COLUMNS[:-1])


def occupancy(rooms: DataFrame, staff: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """The cleaned occupancy of the site, one row per (Site, num_bat, unit
    spelling) with areas, head counts and the staff count (NULL if none)."""
    units = research_units(occupancy_with_building_total(occupancy_by_unit_raw(clean_rooms(rooms, cfg))), cfg)
    return units.join(staff_count(staff, cfg), ["num_bat", "Unite"], "left").select(*OCCUPANCY_COLUMNS)


def surface_by_unit(occ: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Occupied area per unit (strict sums), the reference's diagnostic table."""
    up = F.upper("Unite")
    unit2 = up
    for raw, canon in cfg.surface_summary_aliases.items():
        unit2 = F.when(up == F.lit(raw), F.lit(canon)).otherwise(unit2)
    return (
        occ.withColumn("Unite2", unit2)
        .groupBy("Unite2")
        .agg(strict_sum("metrage_unite").alias("sum_metrage"), strict_sum("metrage_unite_ajus").alias("sum_metrage_ajus"))
    )
