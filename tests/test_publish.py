"""Runs published as a whole, and one reading of each sheet for all tables."""

import datetime as dt
import glob
import json
import os
import re
import subprocess
import sys

import pytest

from fluxsite.plans import cli
from fluxsite.plans.analysis import Analysis
from fluxsite.sinks import publish as P
from fluxsite.sources.workbook import load_inputs
from worked_example import write_workbooks

DAY = dt.date(2025, 1, 31)


@pytest.fixture
def run_of(spark, tmp_path):
    p = write_workbooks(str(tmp_path))
    inputs = load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"])
    return lambda: Analysis(inputs, workdir=str(tmp_path / "work"))


def _rows(df):
    return sorted(tuple("nan" if isinstance(x, float) and x != x else repr(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_all_eight_tables_come_back(spark, tmp_path, run_of, fmt):
    a = run_of()
    run = P.publish_run(a, str(tmp_path / "out"), DAY, fmt)
    assert run.path.endswith("Analyse_fluides_2025-01-31/run-000001") and run.number == 1
    back = P.latest_run(spark, str(tmp_path / "out")).tables(spark)
    tables = a.tables()
    assert list(back) == list(tables) and len(back) == 8
    for name, df in tables.items():
        assert back[name].columns == df.columns and _rows(back[name]) == _rows(df), name
    assert "2022_conso" in back["enriched_gaz"].columns


def test_allocated_rows_are_written_once(spark, tmp_path, run_of):
    """In their tables, not in the work folder before."""
    a = run_of()
    P.publish_run(a, str(tmp_path / "out"), DAY)
    assert {"sheets", "state", "occupancy"} <= set(os.listdir(a.workdir))
    for name in os.listdir(a.workdir):
        assert "ratio_metre" not in spark.read.parquet(f"{a.workdir}/{name}").columns, name


def test_a_failed_run_is_not_seen(spark, tmp_path, run_of, monkeypatch):
    base = str(tmp_path / "out")
    first = P.publish_run(run_of(), base, DAY)
    before = _rows(P.latest_run(spark, base).table(spark, "by_unit"))
    broken, whole = run_of(), Analysis.tables

    def third_fails(self):
        tables = whole(self)
        third = list(tables)[2]
        return tables | {third: tables[third].selectExpr("*", "raise_error('disk full') AS x")}

    monkeypatch.setattr(Analysis, "tables", third_fails)
    with pytest.raises(Exception, match="disk full"):
        P.publish_run(broken, base, DAY)
    monkeypatch.undo()
    assert [r.path for r in P.published_runs(spark, base)] == [first.path]
    assert _rows(P.latest_run(spark, base).table(spark, "by_unit")) == before
    assert len(glob.glob(f"{base}/*/attempt-*")) == 1


def test_runs_of_one_day_and_of_others(spark, tmp_path, run_of):
    base, a = str(tmp_path / "out"), run_of()
    for day in (DAY, dt.date(2025, 2, 1), DAY):
        P.publish_run(a, base, day)
    assert [(r.day, r.number) for r in P.published_runs(spark, base)] == [(DAY, 1), (DAY, 2), (dt.date(2025, 2, 1), 1)]
    assert P.latest_run(spark, base).day == dt.date(2025, 2, 1) and P.latest_run(spark, base, DAY).number == 2
    with pytest.raises(ValueError, match="no published run"):
        P.latest_run(spark, base, dt.date(2020, 1, 1))
    # an attempt whose driver was lost, and a number that was claimed but never filled
    os.makedirs(f"{base}/Analyse_fluides_2025-01-31/attempt-lost/x")
    os.makedirs(f"{base}/Analyse_fluides_2025-01-31/run-000009")
    assert P.latest_run(spark, base, DAY).number == 2
    assert P.delete_abandoned(spark, base) == ["attempt-lost"]
    assert P.publish_run(a, base, DAY).number == 10 and len(P.published_runs(spark, base)) == 4
    assert _rows(P.latest_run(spark, base, DAY).table(spark, "by_unit")) == _rows(a.by_unit)


def test_a_manifest_is_never_replaced(spark, tmp_path):
    files = P._Files(spark, str(tmp_path))
    assert files.create(f"{tmp_path}/m.json", "1") and not files.create(f"{tmp_path}/m.json", "2")
    assert files.read(f"{tmp_path}/m.json") == "1" and os.listdir(tmp_path / "") .count("m.json") == 1
    assert files.claim(f"{tmp_path}/run-1") and not files.claim(f"{tmp_path}/run-1")


def test_cli_publishes(spark, tmp_path):
    p = write_workbooks(str(tmp_path))
    argv = ["--state", p["state"], "--rooms", p["rooms"], "--staff", p["staff"], "--out", str(tmp_path / "res"), "--publish"]
    for r, path in p["conso"].items():
        argv += ["--conso", f"{r}={path}"]
    assert len(cli.main(argv)) == 8
    rows = {r["Unite"]: r for r in P.latest_run(spark, str(tmp_path / "res")).table(spark, "by_unit").collect()}
    assert abs(rows["AGAP"]["cout_elec"] - 110.7) < 1e-9


SCRIPT = """
import sys
sys.path[:0] = [{repo!r}, {tests!r}]
from fluxsite.session import local_session
from fluxsite.plans.analysis import Analysis
from fluxsite.sources.workbook import load_inputs
from worked_example import write_workbooks
spark = local_session(2, 2, extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{log}",
    "spark.sql.maxMetadataStringLength": "4000", "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}})
p = write_workbooks({tmp!r})
inputs = load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"])
a = Analysis(inputs, workdir={tmp!r} + "/work")
spark.sparkContext.setJobDescription("tables")
for name, df in a.tables().items():
    df.write.format("noop").mode("overwrite").save()
spark.stop()
"""


def test_all_tables_read_each_sheet_once(tmp_path):
    """From Spark's event log: over a run of all eight tables each input file is scanned
    by one stage set only (the fuel-oil sheet's codes come from the rows written once)."""
    here = os.path.dirname(os.path.abspath(__file__))
    (tmp_path / "log").mkdir()
    script = SCRIPT.format(repo=os.path.dirname(here), tests=here, log=tmp_path / "log", tmp=str(tmp_path))
    subprocess.run([sys.executable, "-c", script], check=True, capture_output=True, timeout=600)
    (log,) = glob.glob(str(tmp_path / "log" / "*"))
    scans: dict[str, set] = {}
    for line in open(log):
        event = json.loads(line)
        if event["Event"].endswith(("SparkListenerSQLExecutionStart", "SparkListenerSQLAdaptiveExecutionUpdate")):
            todo = [event["sparkPlanInfo"]]
            while todo:
                node = todo.pop()
                todo += node["children"]
                for place in re.findall(r"file:(/[^,\]]+[.]csv)", node.get("metadata", {}).get("Location", "")):
                    scans.setdefault(os.path.basename(place), set()).add((event["executionId"], node["metadata"]["ReadSchema"]))
    runs = {name: {e for e, schema in found if len(schema) > len("struct<value:string>")} for name, found in scans.items()}
    assert len(runs) == 8 and all(len(e) == 1 for e in runs.values()), runs
