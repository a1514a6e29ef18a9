"""Export of one analysis run.

The reference writes two workbooks: the five enriched resource tables and
the three statistics tables, in a file named after the run date. Here a run
folder named after the date holds one dataset per table; the enriched rows
are a single dataset partitioned by ``resource`` (one folder per former
sheet), so a reader of one resource prunes the others.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxsite.config import AnalysisConfig
from fluxsite.plans.analysis import Analysis

# FIXED VALUES: names of the exported tables (sheet names of the reference's
# two workbooks) and the prefix of the run name.
ENRICHED_SHEETS = {"elec": "Elect", "gaz": "Gaz", "eau": "Eau", "fod": "FOD", "reseau": "Reseau"}
STATS_SHEETS = {"by_building": "Par Batiments", "by_unit": "Par Unites", "by_building_unit": "Par batiment et unites"}
RUN_PREFIX = "Analyse_fluides_"


def run_folder(base: str, day: _dt.date | None = None) -> str:
    """The dated folder of a run: ``<base>/Analyse_fluides_<YYYY-MM-DD>``."""
    day = day or _dt.date.today()
    return f"{base.rstrip('/')}/{RUN_PREFIX}{day.isoformat()}"


def slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def enriched_for_export(enriched: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """The enriched rows with the sheet name of their resource."""
    sheet = F.create_map(*[x for r, s in ENRICHED_SHEETS.items() for x in (F.lit(r), F.lit(s))])
    return enriched.withColumn("sheet", sheet[F.col("resource")])


def write_outputs(
    analysis: Analysis,
    out_dir: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    with_years: bool = True,
) -> dict[str, str]:
    """Write the enriched table and the three reports; return their paths.

    ``with_years`` keeps every yearly reading as a 'YYYY_conso' column (the
    reference's export); without it only the latest reading is kept.
    Writes are idempotent (overwrite), so a failed job can simply be rerun;
    Spark retries lost tasks, and the output committer publishes a dataset
    only when every task of it succeeded.
    """
    paths = {"enriched": f"{out_dir}/aggregation"}
    enriched = analysis.enriched_wide if with_years else analysis.enriched
    (
        enriched_for_export(enriched, analysis.cfg)
        .write.mode(mode)
        .partitionBy("resource")
        .format(fmt)
        .option("header", True)
        .save(paths["enriched"])
    )
    reports = {"by_building": analysis.by_building, "by_unit": analysis.by_unit, "by_building_unit": analysis.by_building_unit}
    for key, df in reports.items():
        paths[key] = f"{out_dir}/stats/{slug(STATS_SHEETS[key])}"
        df.write.mode(mode).format(fmt).option("header", True).save(paths[key])
    return paths
