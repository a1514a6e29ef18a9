"""Export round trip, materialised run == lazy run, CLI."""

import datetime as dt
import os

from fluxsite.plans import cli
from fluxsite.config import AnalysisConfig
from fluxsite.plans.analysis import Analysis, run_analysis
from fluxsite.sinks.export import run_folder, write_outputs
from fluxsite.sources.workbook import load_inputs
from worked_example import write_workbooks


def _cell(x):
    if isinstance(x, float) and x != x:
        return "nan"
    return repr(x)


def _rows(df):
    return sorted(tuple(_cell(x) for x in r) for r in df.collect())


def test_export_round_trip_and_materialized_run(spark, tmp_path):
    p = write_workbooks(str(tmp_path))
    inputs = load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"])
    lazy = Analysis(inputs)
    mat = Analysis(inputs, workdir=str(tmp_path / "work"))
    for name in ["by_unit", "by_building", "by_building_unit", "global_cost"]:
        assert _rows(getattr(lazy, name)) == _rows(getattr(mat, name)), name
    assert os.path.isdir(os.path.join(mat.workdir, "occupancy")) and mat.workdir.startswith(str(tmp_path / "work"))
    other = Analysis(inputs, AnalysisConfig(site_pattern="Lavalette"), workdir=str(tmp_path / "work"))
    assert _rows(other.by_unit) != _rows(mat.by_unit) == _rows(lazy.by_unit)  # runs side by side
    other.cleanup()
    assert not os.path.exists(other.workdir) and os.path.isdir(mat.workdir)

    out = run_folder(str(tmp_path / "out"), dt.date(2025, 1, 31))
    assert out.endswith("Analyse_fluides_2025-01-31")
    paths = write_outputs(mat, out)
    enriched = spark.read.parquet(paths["enriched"])
    assert enriched.count() == 28
    assert sorted(r["resource"] for r in enriched.select("resource").distinct().collect()) == sorted(
        ["elec", "gaz", "eau", "fod", "reseau"]
    )
    assert os.path.isdir(os.path.join(paths["enriched"], "resource=elec"))
    assert spark.read.parquet(paths["by_unit"]).count() == 6
    assert spark.read.parquet(paths["by_building"]).count() == 5
    assert spark.read.parquet(paths["by_building_unit"]).count() == 7


def test_cli(spark, tmp_path):
    p = write_workbooks(str(tmp_path))
    argv = ["--state", p["state"], "--rooms", p["rooms"], "--staff", p["staff"], "--out", str(tmp_path / "res")]
    for r, path in p["conso"].items():
        argv += ["--conso", f"{r}={path}"]
    paths = cli.main(argv + ["--price", "elec=0.18"])
    rows = {r["Unite"]: r for r in spark.read.parquet(paths["by_unit"]).collect()}
    assert abs(rows["AGAP"]["cout_elec"] - 221.4) < 1e-9


def test_shuffled_join_equals_broadcast(spark, tmp_path):
    p = write_workbooks(str(tmp_path))
    inputs = load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"])
    expected = _rows(Analysis(inputs).enriched)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _rows(Analysis(inputs, workdir=str(tmp_path / "w")).enriched) == expected
        assert _rows(Analysis(inputs).enriched) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_eight_tables_as_returned(spark, tmp_path):
    """Year and variation columns, consumption and cost named by the resource."""
    p = write_workbooks(str(tmp_path))
    tables = run_analysis(load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"]))
    assert sorted(tables) == sorted([f"enriched_{r}" for r in ("elec", "gaz", "eau", "fod", "reseau")] + ["by_building", "by_unit", "by_building_unit"])
    sheet = ["2022_conso", "2023_conso", "2024_conso", "Evol_2023-2024", "Evol_2023-2024_p", "derniere_conso"]
    joined = ["Site_etat", "nom_bat", "Clos/couvert", "securite", "fonctionnement", "etat_energie", "confort d'usage adéquat aux besoins",
              "Site_occup", "Unite", "metrage_unite", "metrage_unite_ajus", "pers_unite", "metrage_batiment", "count_pers"]
    tail = ["cout_par_m2", "cout_par_pers"]
    assert tables["enriched_gaz"].columns == ["batiment", "num_bat", *sheet, *joined, "ratio_metre", "conso_gaz", "cout_gaz", *tail]
    assert tables["enriched_elec"].columns == ["num_bat", *sheet, *joined, "ratio_metre", "conso_elec", "cout_elec", *tail]
    agap = tables["enriched_elec"].filter("num_bat = '0010' AND Unite = 'AGAP'").first()
    assert (agap["2022_conso"], agap["2023_conso"], agap["conso_elec"]) == (1000.0, 110.0, 400.0)


def test_a_second_state_row_counts_twice(spark, tmp_path, monkeypatch):
    import worked_example as W

    monkeypatch.setattr(W, "STATE", [*W.STATE, ["La Gaillarde", "0010", "Bat 10 b", "ok", "ok", "ok", "Moyen", "oui"]])
    p = write_workbooks(str(tmp_path))
    run = Analysis(load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"]))
    assert run.enriched.filter("resource = 'elec' AND Unite = 'AGAP'").agg({"conso": "sum"}).first()[0] == 1220.0
    assert run.by_unit.filter("Unite = 'AGAP'").first()["conso_elec_m2_kWh"] == 1220.0
    assert run.by_building_unit.filter("Unite = 'AGAP' AND num_bat = '0010'").first()["conso_elec_m2_kWh"] == 800.0
    shared = {r["Unite"]: r for r in run.redistribute_by_unit().collect()}
    assert shared["AGAP"]["conso_elec_m2_kWhb"] == 1220.0 + 200.0 / 2
    assert run.by_building.filter("num_bat = '0010'").first()["etat_energie"] == "Bon"


def test_csv_export(spark, tmp_path):
    p = write_workbooks(str(tmp_path))
    a = Analysis(load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"]))
    paths = write_outputs(a, str(tmp_path / "csv"), fmt="csv")
    back = spark.read.option("header", True).csv(paths["by_unit"])
    assert back.count() == 6 and "cout_global_unite" in back.columns
    assert spark.read.option("header", True).csv(paths["enriched"]).count() == 28


def test_custom_vocabulary(spark, tmp_path):
    """Another estate: other site, other excluded units, other prices."""
    from fluxsite.config import Rates

    p = write_workbooks(str(tmp_path))
    inputs = load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"])
    other_site = Analysis(inputs, AnalysisConfig(site_pattern="Lavalette")).occupancy.collect()
    assert [(r["Site"], r["num_bat"], r["Unite"], r["metrage_unite"]) for r in other_site] == [
        ("Lavalette", "0400", "AGAP", 70.0)
    ]
    units = {r["Unite"] for r in Analysis(inputs, AnalysisConfig(excluded_units=("LEPSE",))).occupancy.collect()}
    assert "LEPSE" not in units and "IA" in units
    cfg2 = AnalysisConfig(rates=Rates(eau=1.0))
    rows = {r["Unite"]: r for r in Analysis(inputs, cfg2).by_unit.collect()}
    assert abs(rows["AGAP"]["cout_eau"] - 14.2) < 1e-9
