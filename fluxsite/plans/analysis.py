"""End-to-end analysis: inputs in, lazy DataFrames out.

``run_analysis`` mirrors the reference's single entry point: building state,
room survey, staff list and the five consumption sheets in; the enriched
allocation table and the three reports out (plus the unreturned side tables
the reference computes). Building a table starts no job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fluxsite.config import AnalysisConfig
from fluxsite.functions.nulls import sql_name
from fluxsite.functions.text import canonical_unit
from fluxsite.operators import allocation as A
from fluxsite.operators import meters as M
from fluxsite.operators import occupancy as O
from fluxsite.operators import positions as X
from fluxsite.operators import redistribute as R
from fluxsite.operators import reports as P
from fluxsite.operators import series as S
from fluxsite.session import shared_folder


@dataclass(frozen=True)
class Inputs:
    """The analysis inputs as DataFrames.

    state  : Site, num_bat, nom_bat, ..., etat_energie, ordinal
    rooms  : Site, num_bat, Unite, Surface_sol, Surface_ajus, Nom_occupants,
             the soft-delete column, ...
    staff  : Unite, Bat, ...
    meters : long readings (resource, ordinal, batiment, year, conso)
    code_map : optional (resource, ordinal, num_bat) for positional sheets
    code_lists : optional {resource: codes by row position, or by label} of such sheets,
             from which the map is made where ``code_map`` is not given
    latest_years : optional {resource: year} read from the sheet headers
    sheet_years : optional {resource: [years]} read from the sheet headers
    wide : optional standardised sheets (resource, ordinal, batiment, YYYY_conso...,
             Evol_*..., derniere_conso), a row per meter
    held : optional {resource: [columns of ``wide`` that its sheet holds]}
    since : optional function from a one-row table (year) to the readings of that
             year or later, for sources that can skip the older ones at the scan
    """

    state: DataFrame
    rooms: DataFrame
    staff: DataFrame
    meters: DataFrame
    code_map: DataFrame | None = None
    latest_years: dict | None = None
    sheet_years: dict | None = None
    wide: DataFrame | None = None
    held: dict | None = None
    since: Callable[[DataFrame], DataFrame] | None = None
    code_lists: dict | None = None


class Analysis:
    """Lazy views of one analysis run; each property is a DataFrame plan."""

    def __init__(
        self,
        inputs: Inputs,
        cfg: AnalysisConfig = AnalysisConfig(),
        years: dict | None = None,
        workdir: str | None = None,
        beside: Callable[[DataFrame], DataFrame] | None = None,
    ):
        """``workdir``: a shared folder (e.g. ``spark.checkpoint.dir``) where what
        several tables need is written once, in a folder of this run's own that
        ``cleanup`` deletes: the sheets' rows by resource, the building state, the
        occupancy and the building statistics. The eight tables then read each input file
        once (the allocated rows, by far the most, are each of one table only), a lost executor does not replay the room and meter
        aggregations, and Catalyst knows the real sizes.
        ``beside``: adds columns, each a function of its row, to the meter rows and to the
        occupancy of the enriched tables before their join multiplies them."""
        self.inputs = inputs
        self.cfg = cfg
        self._years = years
        self._beside = beside or (lambda df: df)
        self.workdir = f"{shared_folder(inputs.state.sparkSession, workdir)}/run-{uuid.uuid4().hex}" if workdir else None

    def _materialize(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        if not self.workdir:
            return df
        path = f"{self.workdir}/{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        columns = [f for f in df.schema.fields if f.name != by] + [f for f in df.schema.fields if f.name == by]
        return df.sparkSession.read.schema(StructType(columns)).parquet(path).select(*[F.col(sql_name(c)) for c in df.columns])

    def cleanup(self) -> None:
        """Delete the run's work tables (tables that read them end too)."""
        if self.workdir:
            spark = self.inputs.state.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(self.workdir)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    # -- inputs as the joins see them ------------------------------------
    @cached_property
    def state(self) -> DataFrame:
        return self._materialize("state", self.inputs.state)

    @cached_property
    def sheet_rows(self) -> DataFrame | None:
        """The standardised sheets, a row per meter, read from the files once; None
        where the inputs come as long readings without header years."""
        if self.inputs.wide is not None:
            return self._materialize("sheets", self.inputs.wide, "resource")
        if self.inputs.sheet_years is None:
            return None
        return self._materialize("sheets", M.wide_readings(self.inputs.meters, self.sheet_years, self.cfg), "resource")

    def _coded_sheets(self) -> dict:
        """{resource: codes} of the sheets whose rows take their codes from a list."""
        lists = self.inputs.code_lists or {}
        return {r: codes for r, codes in lists.items() if self.inputs.code_map is None and r in self.cfg.resources}

    @cached_property
    def code_map(self) -> DataFrame | None:
        maps = [X.positional_code_map(M.rows_of(self.sheet_rows, [r]), r, codes) for r, codes in self._coded_sheets().items()]
        return reduce(DataFrame.unionByName, maps) if maps else self.inputs.code_map

    def _checked(self, rows: DataFrame) -> DataFrame:
        """``rows``, unless a sheet has more or fewer rows than its list has codes."""
        for r, codes in self._coded_sheets().items():
            rows = rows.filter(X.as_many_rows(M.rows_of(self.sheet_rows, [r]), r, codes))
        return rows

    def _coded(self, meters: DataFrame) -> DataFrame:
        return self._checked(M.assign_building_codes(meters, self.code_map, self.cfg))

    @cached_property
    def meters(self) -> DataFrame:
        return self._coded(self.inputs.meters)

    @cached_property
    def years(self) -> dict[str, int]:
        """Latest year per resource, from the headers; without them, reading
        this property runs one small aggregate (no table needs it)."""
        known = self._years if self._years is not None else self.inputs.latest_years
        if known is not None:
            return dict(known)
        latest = M.latest_year_of(M.latest_years(self.inputs.meters, self.cfg))
        return dict(self.inputs.meters.sparkSession.range(1).select(latest.alias("y")).first()["y"] or {})

    @cached_property
    def _latest_rows(self) -> DataFrame:
        """The latest reading of each meter, before the building codes."""
        known = self._years if self._years is not None else self.inputs.latest_years
        if self._years is None and (self.inputs.wide is not None or self.workdir and self.sheet_rows is not None):
            return self.sheet_rows.select("resource", "ordinal", "batiment", "derniere_conso")
        if known is not None:
            return M.latest_readings(self.inputs.meters, dict(known))
        per = M.latest_years(self.inputs.meters, self.cfg)
        meters = self.inputs.meters if self.inputs.since is None else self.inputs.since(per.agg(F.min("year").alias("year")))
        return M.latest_readings(meters, M.latest_year_of(per))

    @cached_property
    def latest(self) -> DataFrame:
        coded = self._coded(self._latest_rows)
        return coded.select("resource", "ordinal", "batiment", "num_bat", "derniere_conso")

    @cached_property
    def occupancy(self) -> DataFrame:
        return self._materialize("occupancy", O.occupancy(self.inputs.rooms, self.inputs.staff, self.cfg))

    @cached_property
    def stats_all(self) -> DataFrame:
        """Building statistics before the exclusions (global cost)."""
        return self._materialize("building_stats", M.building_stats(self.latest, self.cfg))

    @cached_property
    def stats(self) -> DataFrame:
        return M.drop_excluded(self.stats_all, self.cfg)

    # -- the eight returned tables ----------------------------------------
    @cached_property
    def enriched(self) -> DataFrame:
        """Allocation table of all resources (long; latest reading only)."""
        return self._allocated(self._latest_rows, {})

    def _allocated(self, rows: DataFrame, held: dict[str, list[str]]) -> DataFrame:
        rows = self._checked(M.export_rows(rows, held, self.cfg, self.code_map, coded=False))
        rows = M.drop_excluded(rows, self.cfg)
        return A.allocate(A.with_dimensions(self._beside(rows), self.state, self._beside(self.occupancy)), self.cfg)

    @cached_property
    def sheet_years(self) -> dict[str, list[int]]:
        if self.inputs.sheet_years is None:
            raise ValueError("the yearly columns need the sheets' header years (Inputs.sheet_years)")
        return dict(self.inputs.sheet_years)

    @cached_property
    def held(self) -> dict[str, list[str]]:
        """The year and variation columns of each resource's sheet."""
        if self.inputs.held is not None:
            return self.inputs.held
        return {r: [*[f"{y}_conso" for y in ys], "derniere_conso"] for r, ys in self.sheet_years.items()}

    @cached_property
    def enriched_wide(self) -> DataFrame:
        """The enriched table with every column of the sheets, as the reference
        exports it: the sheets' rows, then the fan-out join. Each resource's table takes
        its own rows through that join, so none is written or sorted before its table is."""
        if self.sheet_rows is None:
            raise ValueError("the yearly columns need the sheets' header years (Inputs.sheet_years)")
        return self._allocated(self.sheet_rows, self.held)

    def enriched_table(self, resource: str) -> DataFrame:
        """The resource's table as the reference returns it: its own year and
        variation columns, ``conso_<resource>`` and ``cout_<resource>``."""
        if resource not in self.cfg.resources:
            raise ValueError(f"unknown resource {resource!r}; configured: {', '.join(self.cfg.resources)}")
        own = self.held[resource]
        others = {c for cols in self.held.values() for c in cols} - set(own)
        gone = others | {"resource", "ordinal"} | ({"batiment"} if resource in self.cfg.pre_aggregate else set())
        df = self.enriched_wide.filter(F.col("resource") == F.lit(resource))
        df = df.select(*[F.col(sql_name(c)) for c in df.columns if c not in gone])
        return df.withColumnsRenamed({"conso": f"conso_{resource}", "cout": f"cout_{resource}"})

    @cached_property
    def by_building(self) -> DataFrame:
        return P.by_building(self.stats, self.occupancy, self.state, self.cfg)

    @cached_property
    def by_unit(self) -> DataFrame:
        return P.by_unit(self.stats, self.occupancy, self.cfg, self.state)

    @cached_property
    def by_building_unit(self) -> DataFrame:
        return P.by_building_unit(self.stats, self.occupancy, self.cfg, self.state)

    # -- side tables --------------------------------------------------------
    @cached_property
    def global_cost(self) -> DataFrame:
        return A.global_cost(self.stats_all, self.cfg)

    @cached_property
    def staff_count(self) -> DataFrame:
        return O.staff_count(self.inputs.staff, self.cfg)

    @cached_property
    def surface_by_unit(self) -> DataFrame:
        return O.surface_by_unit(self.occupancy, self.cfg)

    @property
    def _unit_names(self) -> DataFrame:
        """Unit spellings of the survey: every unit of the reports is one of them."""
        return self.inputs.rooms.select(canonical_unit("Unite", self.cfg.unit_aliases).alias("Unite"))

    def redistribute_by_unit(self, method: str = "contains") -> DataFrame:
        return R.redistribute_by_unit(self.by_unit, method, self.cfg, self._unit_names)

    def redistribute_by_building_unit(self, method: str = "contains") -> DataFrame:
        # units only come with buildings of the survey
        return R.redistribute_by_building_unit(self.by_building_unit, method, self.cfg, self._unit_names, self.inputs.rooms)

    @cached_property
    def series_by_year(self) -> DataFrame:
        return S.series_by_year(self.meters, self.occupancy, self.state, self.cfg)

    @cached_property
    def series_by_year_raw(self) -> DataFrame:
        return S.series_by_year_raw(self.meters, self.cfg)

    @cached_property
    def series_by_building(self) -> DataFrame:
        return S.series_by_building(self.by_building_unit, self.cfg)

    @cached_property
    def series_by_unit(self) -> DataFrame:
        return S.series_by_unit(self.by_building_unit, self.cfg)

    @cached_property
    def year_over_year(self) -> DataFrame:
        return S.year_over_year(self.meters, self.cfg)

    def tables(self) -> dict[str, DataFrame]:
        """The eight tables of the reference: five per-resource enriched
        tables and the three reports."""
        out = {f"enriched_{r}": self.enriched_table(r) for r in self.cfg.resources}
        out.update(by_building=self.by_building, by_unit=self.by_unit, by_building_unit=self.by_building_unit)
        return out


def run_analysis(
    inputs: Inputs, cfg: AnalysisConfig = AnalysisConfig(), workdir: str | None = None
) -> dict[str, DataFrame]:
    """The eight tables of one run (lazy), as the reference's entry point."""
    return Analysis(inputs, cfg, workdir=workdir).tables()
