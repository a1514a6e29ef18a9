"""Load the three workbooks (one CSV or Parquet path per sheet) as Inputs.

building state   : 1 sheet, positional names
room survey      : rooms sheet (positional names, soft-delete flag kept by
                   name) and staff sheet (two positions dropped)
consumption      : five sheets (elec, eau, gaz, reseau, fod), free headers,
                   standardised; kept wide for the export and turned long for
                   the yearly series. The fuel-oil sheet takes its building
                   codes by row position
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxsite import config as C
from fluxsite.config import AnalysisConfig
from fluxsite.operators.positions import positional_code_map  # noqa: F401  (the map of one sheet)
from fluxsite.plans.analysis import Inputs
from fluxsite.sources.headers import latest_year_column, standardise_headers, unpivot_years, year_columns
from fluxsite.sources.sheets import apply_schema, cast_columns, drop_positions, named, number, read_sheet, require_columns


class Sheets:
    """How the sheets are to be read: format, tokens, decimal mark and the like."""

    def __init__(self, spark: SparkSession, fmt: str = "csv", cfg: AnalysisConfig = AnalysisConfig(), decimal: str = ".",
                 unparsable: str = "fail", **scan):
        self.spark, self.fmt, self.cfg, self.decimal, self.unparsable, self.scan = spark, fmt, cfg, decimal, unparsable, scan

    def read(self, path: str) -> DataFrame:
        return read_sheet(self.spark, path, self.fmt, self.cfg.na_tokens, **self.scan)

    def state(self, path: str) -> DataFrame:
        return apply_schema(self.read(path), C.STATE_COLUMNS, keep=("ordinal",))

    def rooms(self, path: str) -> DataFrame:
        """Room survey: first 13 columns by position, soft-delete flag by name."""
        raw, flag = self.read(path), self.cfg.soft_delete_column
        require_columns(raw, [flag], "room survey")
        body = [c for c in raw.columns if c != "ordinal"]
        gone = {body[p - 1] for p in C.ROOM_DROPPED_POSITIONS if p <= len(body)} | {flag}
        kept = [c for c in body if c not in gone]
        if len(kept) != len(C.ROOM_COLUMNS):
            raise ValueError(f"room survey has {len(kept)} data columns, expected {len(C.ROOM_COLUMNS)}: {kept}")
        table = raw.select(*[named(c).alias(n) for c, n in zip(kept, C.ROOM_COLUMNS)], named(flag), "ordinal")
        return cast_columns(table, ("Surface_sol", "Surface_ajus"), self.decimal, self.unparsable)

    def staff(self, path: str) -> DataFrame:
        raw = drop_positions(self.read(path), C.STAFF_DROPPED_POSITIONS, keep=("ordinal",))
        df = raw.withColumnRenamed(raw.columns[0], C.STAFF_FIRST_COLUMN)
        require_columns(df, ["Unite", "Bat"], "staff sheet")
        return df

    def meters(self, path: str) -> DataFrame:
        """A standardised consumption sheet, as wide as it is. The latest reading
        must be a number; older years and variations are read leniently."""
        std = standardise_headers(self.read(path))
        latest_year_column(std)
        kinds = {"derniere_conso": self.unparsable}
        cells = [c for c in std.columns if c not in ("ordinal", "batiment")]
        return std.select("ordinal", "batiment", *[number(named(c), self.decimal, kinds.get(c, "null")).alias(c) for c in cells])


def load_inputs(
    spark: SparkSession,
    state_path: str,
    rooms_path: str,
    staff_path: str,
    conso_paths: dict[str, str],
    fmt: str = "csv",
    positional_codes: dict | None = None,
    cfg: AnalysisConfig = AnalysisConfig(),
    **sheets,
) -> Inputs:
    """All inputs of one analysis run; every sheet is read lazily. ``sheets``
    takes what ``Sheets`` does: decimal, unparsable, sep, encoding, multiline."""
    for r in conso_paths:
        C.known_resource(r)
    missing = [r for r in C.SHEET_ORDER if r not in conso_paths]
    if missing:
        raise ValueError(f"missing consumption sheet(s): {missing}")
    positional_codes = cfg.positional_codes if positional_codes is None else positional_codes
    read = Sheets(spark, fmt, cfg, **sheets)
    std = {r: read.meters(conso_paths[r]) for r in C.SHEET_ORDER}
    tagged = [df.withColumn("resource", F.lit(r)) for r, df in std.items()]
    long = [unpivot_years(df, ["resource", "ordinal", "batiment"]) for df in tagged]
    return Inputs(
        state=read.state(state_path),
        rooms=read.rooms(rooms_path),
        staff=read.staff(staff_path),
        meters=reduce(DataFrame.unionByName, long).select("resource", "ordinal", "batiment", "year", "conso"),
        code_lists=dict(positional_codes),
        latest_years={r: int(latest_year_column(df)[:4]) for r, df in std.items()},
        sheet_years={r: sorted(int(c[:4]) for c in year_columns(df)) for r, df in std.items()},
        # schema drift: each sheet has its own years and variation columns
        wide=reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged),
        held={r: [c for c in df.columns if c not in ("ordinal", "batiment")] for r, df in std.items()},
    )
