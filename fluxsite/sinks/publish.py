"""A run published as a whole: all eight tables, or nothing that a reader sees.

``publish_run`` writes every table of a run into a folder of its own (an attempt).
Only when all have been written does it list them in a manifest, and the manifest, put
in place by one atomic create, is what makes the attempt a run. Readers go by the
manifests alone: an attempt that failed half-way is invisible, the runs before it
stay as they were, and two runs of one day stand side by side, numbered.

Layout: ``<base>/<prefix><day>/run-<number>/_manifest.json`` and
``<base>/<prefix><day>/attempt-<id>/<table>``.
"""

from __future__ import annotations

import datetime as _dt
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fluxsite.plans.analysis import Analysis
from fluxsite.sinks.export import ENRICHED_SHEETS, RUN_PREFIX, STATS_SHEETS, run_folder, slug

MANIFEST = "_manifest.json"
_NUMBERED = re.compile(r"run-(\d{6})")


@dataclass(frozen=True)
class Run:
    """A published run: its folder and what its manifest says."""

    path: str
    manifest: dict

    @property
    def day(self) -> _dt.date:
        return _dt.date.fromisoformat(self.manifest["day"])

    @property
    def number(self) -> int:
        return self.manifest["number"]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table of the run, with the schema it was written with."""
        entry = self.manifest["tables"][name]
        folder = f"{self.path.rsplit('/', 1)[0]}/{self.manifest['attempt']}/{entry['path']}"
        reader = spark.read.schema(StructType.fromJson(entry["schema"])).format(self.manifest["format"])
        return reader.option("header", True).load(folder)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {name: self.table(spark, name) for name in self.manifest["tables"]}


class _Files:
    """The few calls of the Hadoop file system that publishing needs."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark._jvm
        self.fs = self.path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, file: str) -> str | None:
        p = self.path(file)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, file: str, text: str) -> bool:
        """Put a whole file in place, unless one is there: written aside, then renamed
        (a rename never replaces a file)."""
        target, aside = self.path(file), self.path(f"{file}.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        done = not self.fs.exists(target) and self.fs.rename(aside, target)
        if not done:
            self.fs.delete(aside, False)
        return done

    def claim(self, folder: str) -> bool:
        """Make a folder that was not there; of several who try, one succeeds."""
        p = self.path(folder)
        return not self.fs.exists(p) and self.fs.mkdirs(p)

    def delete(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)


def table_paths() -> dict[str, str]:
    """Folder of each of the eight tables inside a run, named as the sheets are."""
    paths = {f"enriched_{r}": f"aggregation/{slug(s)}" for r, s in ENRICHED_SHEETS.items()}
    return paths | {name: f"stats/{slug(s)}" for name, s in STATS_SHEETS.items()}


def publish_run(analysis: Analysis, base: str, day: _dt.date | None = None, fmt: str = "parquet") -> Run:
    """Write the eight tables of ``analysis`` and publish them as one run of the day.

    When a table fails, the attempt's files are deleted and the error goes on to the
    caller; whatever was published before is untouched."""
    spark = analysis.inputs.state.sparkSession
    day = day or _dt.date.today()
    folder, files = run_folder(base, day), _Files(spark, base)
    attempt = f"attempt-{uuid.uuid4().hex}"
    paths, entries = table_paths(), {}
    try:
        for name, df in analysis.tables().items():
            df.write.format(fmt).option("header", True).save(f"{folder}/{attempt}/{paths[name]}")
            entries[name] = {"path": paths[name], "schema": json.loads(df.schema.json())}
    except BaseException:
        files.delete(f"{folder}/{attempt}")
        raise
    manifest = {"day": day.isoformat(), "attempt": attempt, "format": fmt, "tables": entries}
    while True:
        taken = [int(m[1]) for n in files.names(folder) if (m := _NUMBERED.fullmatch(n))]
        number = max(taken, default=0) + 1
        run = f"{folder}/run-{number:06d}"
        if files.claim(run) and files.create(f"{run}/{MANIFEST}", json.dumps(manifest | {"number": number}, indent=1)):
            return Run(run, manifest | {"number": number})


def published_runs(spark: SparkSession, base: str) -> list[Run]:
    """The published runs below ``base``, oldest first."""
    files, runs = _Files(spark, base), []
    for day in files.names(base):
        if not day.startswith(RUN_PREFIX):
            continue
        for name in files.names(f"{base.rstrip('/')}/{day}"):
            path = f"{base.rstrip('/')}/{day}/{name}"
            if _NUMBERED.fullmatch(name) and (text := files.read(f"{path}/{MANIFEST}")):
                runs.append(Run(path, json.loads(text)))
    return sorted(runs, key=lambda r: (r.day, r.number))


def latest_run(spark: SparkSession, base: str, day: _dt.date | None = None) -> Run:
    """The last run published (on ``day``)."""
    runs = [r for r in published_runs(spark, base) if day in (None, r.day)]
    if not runs:
        raise ValueError(f"no published run in {base}" + (f" on {day.isoformat()}" if day else ""))
    return runs[-1]


def delete_abandoned(spark: SparkSession, base: str) -> list[str]:
    """Delete attempts that no manifest names (of runs whose driver was lost). Not to be
    called while a run is being written."""
    files, kept, gone = _Files(spark, base), {r.manifest["attempt"] for r in published_runs(spark, base)}, []
    for day in files.names(base):
        if day.startswith(RUN_PREFIX):
            for name in files.names(f"{base.rstrip('/')}/{day}"):
                if name.startswith("attempt-") and name not in kept:
                    files.delete(f"{base.rstrip('/')}/{day}/{name}")
                    gone.append(name)
    return gone
