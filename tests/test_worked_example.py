"""Golden test: the worked example of FIXTURES.md, end to end from CSV sheets."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import assert_row, same
from fluxsite.plans.analysis import Analysis
from fluxsite.sources.workbook import load_inputs
from worked_example import write_workbooks

INF = math.inf


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("workbooks"))
    p = write_workbooks(folder)
    inputs = load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"])
    return Analysis(inputs)


def by(rows, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}


def test_latest_year(run):
    assert run.years == {r: 2024 for r in ["elec", "gaz", "eau", "reseau", "fod"]}


def test_positional_codes(run):
    rows = run.meters.filter(F.col("resource") == "fod").select("batiment", "num_bat").distinct().collect()
    assert {r["batiment"]: r["num_bat"] for r in rows} == {"Cuve A": "0290", "Cuve B": "0310", "Cuve C": "0030"}


def test_occupancy(run):
    rows = run.occupancy.collect()
    assert len(rows) == 8
    got = sorted(
        (r["num_bat"], r["Unite"], r["metrage_unite"], r["metrage_unite_ajus"], r["pers_unite"], r["metrage_batiment"], r["count_pers"])
        for r in rows
    )
    expected = sorted([
        ("0010", "AGAP", 100.0, 80.0, 2.0, 240.0, 2),
        ("0010", "AGAP/LEPSE", 30.0, 20.0, 0.0, 240.0, None),
        ("0010", "LEPSE", 50.0, 40.0, 3.0, 240.0, 1),
        ("0010", "LEPSE", 40.0, 30.0, 1.0, 240.0, 1),
        ("0020", "SDAR", 40.0, 0.0, 0.0, 100.0, None),
        ("0020", "AGAP", 60.0, 60.0, 4.0, 100.0, 1),
        ("0030", "LEPSE/IPSIM", 25.0, 25.0, 0.0, 25.0, 1),
        ("0290", "MISTEA", 0.0, 0.0, 2.0, 0.0, 1),
    ], key=lambda t: tuple("" if x is None else str(x) for x in t))
    got = sorted(got, key=lambda t: tuple("" if x is None else str(x) for x in t))
    assert got == expected


def test_staff_count(run):
    rows = {(r["num_bat"], r["Unite"]): r["count_pers"] for r in run.staff_count.collect()}
    assert rows == {
        ("0010", "AGAP"): 2, ("0010", "LEPSE"): 1, ("0070", "Associé BAP"): 1,
        ("0020", "AGAP"): 1, ("0290", "MISTEA"): 1, ("0030", "LEPSE/IPSIM"): 1,
    }


def test_allocation_rows(run):
    e = run.enriched.collect()
    counts = {}
    for r in e:
        counts[r["resource"]] = counts.get(r["resource"], 0) + 1
    assert counts == {"elec": 7, "gaz": 5, "eau": 10, "reseau": 3, "fod": 3}
    elec = [r for r in e if r["resource"] == "elec"]
    agap = [r for r in elec if r["num_bat"] == "0010" and r["Unite"] == "AGAP"][0]
    assert_row(agap, {"ratio_metre": 1 / 3, "conso": 400.0, "cout": 54.0, "cout_par_m2": 0.675, "cout_par_pers": 27.0})
    shared = [r for r in elec if r["Unite"] == "AGAP/LEPSE"][0]
    assert_row(shared, {"ratio_metre": 1 / 12, "conso": 100.0, "cout": 13.5, "cout_par_m2": 0.675, "cout_par_pers": None})
    lepse = sorted([r for r in elec if r["Unite"] == "LEPSE"], key=lambda r: r["metrage_unite_ajus"])
    assert_row(lepse[0], {"ratio_metre": 0.125, "conso": 150.0, "cout": 20.25, "cout_par_m2": 0.675, "cout_par_pers": 20.25})
    assert_row(lepse[1], {"ratio_metre": 1 / 6, "conso": 200.0, "cout": 27.0, "cout_par_m2": 0.675, "cout_par_pers": 27.0})
    sdar = [r for r in elec if r["Unite"] == "SDAR"][0]
    assert_row(sdar, {"ratio_metre": 0.0, "conso": 0.0, "cout": 0.0, "cout_par_m2": math.nan, "cout_par_pers": None})
    agap20 = [r for r in elec if r["num_bat"] == "0020" and r["Unite"] == "AGAP"][0]
    assert_row(agap20, {"ratio_metre": 0.6, "conso": 420.0, "cout": 56.7, "cout_par_m2": 0.945, "cout_par_pers": 56.7})
    mistea = [r for r in elec if r["Unite"] == "MISTEA"][0]
    assert_row(mistea, {"ratio_metre": math.nan, "conso": math.nan, "cout": math.nan, "cout_par_m2": math.nan, "cout_par_pers": math.nan})
    gaz = [r for r in e if r["resource"] == "gaz" and r["num_bat"] == "0030"][0]
    assert_row(gaz, {"ratio_metre": 1.0, "conso": None, "cout": None, "cout_par_m2": None, "cout_par_pers": None})
    eau = [r for r in e if r["resource"] == "eau" and r["num_bat"] == "0010" and r["Unite"] == "AGAP" and r["derniere_conso"] == 10.0][0]
    assert_row(eau, {"ratio_metre": 1 / 3, "conso": 10 / 3, "cout": 35 / 3, "cout_par_m2": 35 / 240, "cout_par_pers": 35 / 6})
    res = [r for r in e if r["resource"] == "reseau" and r["num_bat"] == "0310"][0]
    assert_row(res, {"Unite": None, "ratio_metre": None, "conso": None, "cout": None})
    fod = [r for r in e if r["resource"] == "fod" and r["num_bat"] == "0030"][0]
    assert_row(fod, {"ratio_metre": 1.0, "conso": 33.0, "cout": 15.84, "cout_par_m2": 0.6336, "cout_par_pers": 15.84})


def test_global_cost(run):
    rows = by(run.global_cost.collect(), "resource")
    assert_row(rows["elec"], {"total": 270.0, "share": 162.0})
    assert_row(rows["gaz"], {"total": None, "share": None})
    assert_row(rows["eau"], {"total": 147.0, "share": 88.2})
    assert_row(rows["reseau"], {"total": 35.7, "share": 21.42})
    assert_row(rows["fod"], {"total": 31.68, "share": 19.008})


def test_by_building(run):
    rows = by(run.by_building.collect(), "num_bat")
    assert set(rows) == {"0010", "0020", "0290", "0030", "0310"}
    assert_row(rows["0010"], {
        "etat_energie": "Bon", "metrage_batiment": 240.0,
        "conso_elec_m2_kWh": 5.0, "cout_elec": 0.675, "conso_gaz_m2_kWh": 200 / 240, "cout_gaz": 0.0875,
        "conso_eau_m2": 10 / 240, "cout_eau": 35 / 240, "conso_fod_m2_kWh": None, "cout_reseau": None,
        "cout_global_bat": 0.675 + 0.0875 + 35 / 240,
    })
    assert_row(rows["0020"], {
        "etat_energie": "Moyen", "metrage_batiment": 100.0, "conso_elec_m2_kWh": 7.0, "cout_elec": 0.945,
        "conso_gaz_m2_kWh": None, "conso_eau_m2": 0.07, "cout_eau": 0.245, "conso_reseau_m2": 3.0,
        "cout_reseau": 0.315, "cout_global_bat": 1.505,
    })
    assert_row(rows["0290"], {
        "etat_energie": None, "metrage_batiment": 0.0, "conso_elec_m2_kWh": INF, "cout_elec": INF,
        "conso_fod_m2_kWh": INF, "cout_fod": INF, "cout_global_bat": INF,
    })
    assert_row(rows["0030"], {
        "etat_energie": None, "metrage_batiment": None, "conso_fod_m2_kWh": 1.32, "cout_fod": 0.6336,
        "cout_global_bat": 0.6336,
    })
    assert_row(rows["0310"], {"conso_fod_m2_kWh": None, "conso_reseau_m2": None, "cout_global_bat": 0.0})


def test_by_unit(run):
    rows = by(run.by_unit.collect(), "Unite")
    assert set(rows) == {"AGAP", "AGAP/LEPSE", "LEPSE", "SDAR", "LEPSE/IPSIM", None}
    assert_row(rows["AGAP"], {
        "conso_elec_m2_kWh": 820.0, "cout_elec": 110.7, "conso_gaz_m2_kWh": 200 / 3, "cout_gaz": 7.0,
        "conso_eau_m2": 14.2, "cout_eau": 49.7, "conso_fod_m2_kWh": None, "cout_fod": None,
        "conso_reseau_m2": 180.0, "cout_reseau": 18.9, "countU": 1.0, "cout_global_unite": 186.3,
    })
    assert_row(rows["AGAP/LEPSE"], {
        "conso_elec_m2_kWh": 100.0, "cout_elec": 13.5, "conso_gaz_m2_kWh": 50 / 3, "cout_gaz": 1.75,
        "conso_eau_m2": 2.5, "cout_eau": 8.75, "conso_reseau_m2": None, "countU": 2.0, "cout_global_unite": 24.0,
    })
    assert_row(rows["LEPSE"], {
        "conso_elec_m2_kWh": 350.0, "cout_elec": 47.25, "conso_gaz_m2_kWh": 175 / 3, "cout_gaz": 6.125,
        "conso_eau_m2": 8.75, "cout_eau": 30.625, "countU": 1.0, "cout_global_unite": 84.0,
    })
    assert_row(rows["SDAR"], {
        "conso_elec_m2_kWh": 0.0, "cout_elec": 0.0, "conso_gaz_m2_kWh": None, "conso_eau_m2": 0.0,
        "conso_reseau_m2": 0.0, "cout_reseau": 0.0, "countU": 1.0, "cout_global_unite": 0.0,
    })
    assert_row(rows["LEPSE/IPSIM"], {
        "conso_elec_m2_kWh": None, "conso_gaz_m2_kWh": None, "conso_fod_m2_kWh": 33.0, "cout_fod": 15.84,
        "countU": 2.0, "cout_global_unite": 15.84,
    })
    assert_row(rows[None], {"conso_reseau_m2": None, "cout_reseau": None, "countU": None, "cout_global_unite": 0.0})


def test_by_building_unit(run):
    rows = by(run.by_building_unit.collect(), "num_bat", "Unite")
    assert set(rows) == {
        ("0010", "AGAP"), ("0010", "AGAP/LEPSE"), ("0010", "LEPSE"), ("0020", "AGAP"), ("0020", "SDAR"),
        ("0290", "MISTEA"), ("0030", "LEPSE/IPSIM"),
    }
    assert_row(rows[("0010", "AGAP")], {
        "conso_elec_m2_kWh": 400.0, "cout_elec": 54.0, "conso_gaz_m2_kWh": 200 / 3, "cout_gaz": 7.0,
        "conso_eau_m2": 10.0, "cout_eau": 35.0, "cout_global_batunite": 96.0, "batu": "0010-AGAP",
    })
    assert_row(rows[("0010", "LEPSE")], {"conso_elec_m2_kWh": 350.0, "cout_elec": 47.25, "cout_global_batunite": 84.0})
    assert_row(rows[("0020", "AGAP")], {
        "conso_elec_m2_kWh": 420.0, "conso_eau_m2": 4.2, "conso_reseau_m2": 180.0, "cout_global_batunite": 90.3,
    })
    assert_row(rows[("0020", "SDAR")], {"conso_elec_m2_kWh": 0.0, "conso_gaz_m2_kWh": None, "conso_fod_m2_kWh": None, "cout_global_batunite": 0.0})
    assert_row(rows[("0290", "MISTEA")], {
        "conso_elec_m2_kWh": math.nan, "cout_elec": math.nan, "conso_fod_m2_kWh": math.nan, "cout_global_batunite": 0.0,
    })
    assert_row(rows[("0030", "LEPSE/IPSIM")], {"conso_gaz_m2_kWh": None, "conso_fod_m2_kWh": 33.0, "cout_global_batunite": 15.84})


def _vals(r):
    return [r["conso_elec_m2_kWhb"], r["conso_gaz_m2_kWhb"], r["conso_eau_m2b"], r["conso_fod_m2_kWhb"], r["conso_reseau_m2b"]]


@pytest.mark.parametrize("method", ["contains", "token"])
def test_redistribute_by_unit(run, method):
    rows = by(run.redistribute_by_unit(method).collect(), "Unite")
    assert set(rows) == {"AGAP", "LEPSE", "SDAR"}
    for got, exp in zip(_vals(rows["AGAP"]), [870.0, 75.0, 15.45, None, None]):
        assert same(got, exp)
    assert _vals(rows["LEPSE"]) == [None] * 5
    for got, exp in zip(_vals(rows["SDAR"]), [0.0, None, 0.0, None, 0.0]):
        assert same(got, exp)


def test_redistribute_by_building_unit(run):
    rows = by(run.redistribute_by_building_unit().collect(), "batu")
    expected = {
        "0010-AGAP": [450.0, 75.0, 11.25, None, None],
        "0010-LEPSE": [400.0, 200 / 3, 10.0, None, None],
        "0020-AGAP": [420.0, None, 4.2, None, 180.0],
        "0020-SDAR": [0.0, None, 0.0, None, 0.0],
        "0290-MISTEA": [math.nan, None, None, math.nan, None],
    }
    assert set(rows) == set(expected)
    for k, exp in expected.items():
        for got, e in zip(_vals(rows[k]), exp):
            assert same(got, e), (k, _vals(rows[k]), exp)


def test_series_by_year(run):
    joined = {(r["resource"], r["year"]): r["total"] for r in run.series_by_year.collect()}
    exp = {"elec": [5050, 1700, 6270], "gaz": [840, 870, 800], "eau": [124, 124, 134], "fod": [60, 63, 66], "reseau": [598, 619, 640]}
    for res, vals in exp.items():
        for y, v in zip([2022, 2023, 2024], vals):
            assert same(joined[(res, y)], float(v)), (res, y, joined[(res, y)], v)
    raw = {(r["resource"], r["year"]): r["total"] for r in run.series_by_year_raw.collect()}
    exp = {"elec": [1560, 790, 2000], "gaz": [270, 285, 200], "eau": [39, 39, 42], "fod": [60, 63, 66], "reseau": [318, 329, 340]}
    for res, vals in exp.items():
        for y, v in zip([2022, 2023, 2024], vals):
            assert same(raw[(res, y)], float(v)), (res, y)


def test_series_by_building_and_unit(run):
    b = {r["num_bat"]: r["total_conso"] for r in run.series_by_building.filter(F.col("resource") == "elec").collect()}
    assert b == {"0010": 850.0, "0020": 420.0, "0290": 0.0, "0030": 0.0}
    u = {r["Unite"]: r["total_conso"] for r in run.series_by_unit.filter(F.col("resource") == "elec").collect()}
    assert u == {"AGAP": 820.0, "AGAP/LEPSE": 100.0, "LEPSE": 350.0, "SDAR": 0.0, "MISTEA": 0.0, "LEPSE/IPSIM": 0.0}


def test_year_over_year(run):
    rows = {(r["resource"], r["num_bat"], r["year"]): r for r in run.year_over_year.collect()}
    r = rows[("elec", "0020", 2023)]
    assert_row(r, {"conso": 600.0, "conso_prev": 500.0, "evol": 100.0, "evol_pct": 20.0})
    assert rows[("elec", "0020", 2022)]["conso_prev"] is None


def test_canonicalise_first_merges_spellings(spark, tmp_path):
    from fluxsite.config import AnalysisConfig
    p = write_workbooks(str(tmp_path))
    inputs = load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"])
    rows = Analysis(inputs, AnalysisConfig(canonicalise_first=True)).occupancy.collect()
    lepse = [r for r in rows if r["num_bat"] == "0010" and r["Unite"] == "LEPSE"]
    assert len(rows) == 7 and len(lepse) == 1
    assert_row(lepse[0], {"metrage_unite": 90.0, "metrage_unite_ajus": 70.0, "pers_unite": 4.0, "count_pers": 1})


def test_enriched_with_years(run):
    rows = run.enriched_wide.collect()
    assert len(rows) == 28
    elec = [r for r in rows if r["resource"] == "elec" and r["num_bat"] == "0010" and r["Unite"] == "AGAP"][0]
    assert_row(elec, {"2022_conso": 1000.0, "2023_conso": 110.0, "2024_conso": 1200.0, "derniere_conso": 1200.0,
                      "conso": 400.0, "cout": 54.0, "batiment": None})
    gaz = [r for r in rows if r["resource"] == "gaz" and r["num_bat"] == "0030"][0]
    assert_row(gaz, {"2022_conso": 80.0, "2023_conso": 90.0, "2024_conso": None, "derniere_conso": None})
    eau = sorted([r for r in rows if r["resource"] == "eau" and r["Unite"] == "AGAP" and r["num_bat"] == "0010"],
                 key=lambda r: r["2024_conso"])
    assert [r["2024_conso"] for r in eau] == [10.0, 20.0]
    assert {r["batiment"] for r in eau} == {"MTP-0010 a", "MTP-0010 b"}
    lazy = {(r["resource"], r["ordinal"], r["Unite"], r["metrage_unite"]): r["cout"] for r in run.enriched.collect()}
    wide = {(r["resource"], r["ordinal"], r["Unite"], r["metrage_unite"]): r["cout"] for r in rows}
    assert set(lazy) == set(wide)
    for k in lazy:
        assert same(lazy[k], wide[k])


def test_global_cost_rollup(run):
    from fluxsite.operators.allocation import global_cost

    rows = by(global_cost(run.stats_all, run.cfg, with_total=True).collect(), "resource")
    assert rows[None]["total"] is None  # gaz is NULL, so the grand total is
    no_gaz = global_cost(run.stats_all.filter("resource <> 'gaz'"), run.cfg, with_total=True)
    total = by(no_gaz.collect(), "resource")[None]
    assert same(total["total"], 270.0 + 147.0 + 35.7 + 31.68)


def test_series_unit_labels(run):
    units = {r["resource"]: r["unit"] for r in run.series_by_year_raw.collect()}
    assert units == {"elec": "kWh", "gaz": "kWh", "eau": "m3", "fod": "kWh", "reseau": ""}
