"""Input guards (A13) and positional layouts (A2, A3)."""

import csv

import pytest

from fluxsite.sources.headers import latest_year_column, standardise_headers
from fluxsite.sources.sheets import apply_schema, drop_positions, read_sheet, require_columns
from fluxsite.plans.analysis import Analysis
from fluxsite.sources.workbook import load_inputs
from worked_example import write_workbooks


def test_missing_sheet_is_named(spark, tmp_path):
    p = write_workbooks(str(tmp_path))
    conso = dict(p["conso"])
    conso.pop("gaz")
    with pytest.raises(ValueError, match="gaz"):
        load_inputs(spark, p["state"], p["rooms"], p["staff"], conso)


def test_sheet_without_year_column(spark, tmp_path):
    path = tmp_path / "s.csv"
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([["Bat", "Note"], ["MTP-0010", "x"]])
    std = standardise_headers(read_sheet(spark, str(path)))
    assert std.columns == ["batiment", "ordinal"]
    with pytest.raises(ValueError, match="no 'YYYY_conso'"):
        latest_year_column(std)


def test_positional_schema(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert apply_schema(df, ["x", "y", "z"]).columns == ["x", "y", "z"]
    with pytest.raises(ValueError):
        apply_schema(df, ["x", "y"])
    assert drop_positions(df, [2]).columns == ["a", "c"]
    with pytest.raises(ValueError, match="lacks"):
        require_columns(df, ["q"])


def write_csv(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(rows)


@pytest.mark.parametrize("multiline", [True, False])
def test_ordinals_follow_files_blocks_and_rows(spark, tmp_path, multiline):
    """A sheet of a short and a long file, cut into many splits."""
    (tmp_path / "sheet").mkdir()
    write_csv(tmp_path / "sheet" / "a.csv", [["k"], [0], [1], [2]])
    write_csv(tmp_path / "sheet" / "b.csv", [["k"], *[[i] for i in range(3, 5000)]])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_sheet(spark, str(tmp_path / "sheet"), multiline=multiline).select("k", "ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [int(r["k"]) for r in sorted(rows, key=lambda r: r["ordinal"])] == list(range(5000))
    assert len({r["ordinal"] for r in rows}) == 5000


@pytest.mark.parametrize("rows,good", [(2, False), (3, True), (4, False)])
def test_positional_codes_need_as_many_rows(spark, tmp_path, monkeypatch, rows, good):
    import worked_example as W

    monkeypatch.setitem(W.CONSO, "fod", [W.CONSO_HEADER, *[[f"Cuve {k}", "1", "2", "3", "", "", ""] for k in range(rows)]])
    p = write_workbooks(str(tmp_path))
    run = Analysis(load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"]))
    got = run.latest.filter("resource = 'fod'").select("batiment", "num_bat")
    if good:
        assert sorted(tuple(r) for r in got.collect()) == [("Cuve 0", "0290"), ("Cuve 1", "0310"), ("Cuve 2", "0030")]
    else:
        with pytest.raises(Exception, match="exactly 3 rows"):
            got.collect()


def test_codes_by_label(spark, tmp_path, monkeypatch):
    import worked_example as W

    monkeypatch.setitem(W.CONSO, "fod", [*W.CONSO["fod"], ["Cuve D", "1", "2", "500", "", "", ""]])
    p = write_workbooks(str(tmp_path))
    codes = {"fod": {"Cuve A": "0290", "Cuve B": "0310", "Cuve C": "0030", "Cuve D": "0010"}}
    run = Analysis(load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"], positional_codes=codes))
    rows = run.latest.filter("resource = 'fod'").collect()
    assert {r["batiment"]: (r["num_bat"], r["derniere_conso"]) for r in rows}["Cuve D"] == ("0010", 500.0)


def test_no_room_is_lost_in_reading(spark, tmp_path, monkeypatch):
    """Quoted line breaks, padded cells and tokens, and decimal commas."""
    import worked_example as W

    rooms = [list(r) for r in W.ROOMS]
    rooms[1][9] = "Dupont,\nMartin ""x"""  # L1 of 0010, AGAP
    rooms[1][6] = "100,0"
    rooms[4][7] = "IA "
    rooms[2][14], rooms[3][11] = "NON ", "  "
    rooms[6][11] = " ND"
    monkeypatch.setattr(W, "ROOMS", rooms)
    p = write_workbooks(str(tmp_path))
    args = (spark, p["state"], p["rooms"], p["staff"], p["conso"])
    run = Analysis(load_inputs(*args, decimal=","))
    assert run.inputs.rooms.count() == len(rooms) - 1
    occ = {(r["num_bat"], r["Unite"], r["metrage_unite"]): r for r in run.occupancy.collect()}
    assert ("0010", "AGAP", 100.0) in occ and ("0010", "LEPSE", 50.0) in occ and not any(u == "IA " for _, u, _ in occ)
    assert {r["metrage_batiment"] for (b, _, _), r in occ.items() if b == "0010"} == {240.0}
    with pytest.raises(Exception, match="not a number: 100,0"):
        Analysis(load_inputs(*args)).occupancy.collect()
    lenient = Analysis(load_inputs(*args, unparsable="null")).inputs.rooms
    assert lenient.filter("Surface_sol IS NULL").count() == 1


def test_ragged_records_fail(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_sheet(spark, str(path)).select("a").collect()


def test_odd_headers_and_separators(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_bytes("B`at.x;Conso 2024 (kWh)\n MTP-0010 ;7\n".encode("latin-1"))
    std = standardise_headers(read_sheet(spark, str(path), sep=";", encoding="iso-8859-1"))
    assert std.select("batiment", "2024_conso", "derniere_conso").first() == ("MTP-0010", "7", "7")


def test_null_label_keeps_its_variation(spark, tmp_path, monkeypatch):
    import worked_example as W

    monkeypatch.setitem(W.CONSO, "elec", [W.CONSO_HEADER, ["", "1", "2", "3", "10", "", ""], *W.CONSO["elec"][1:]])
    p = write_workbooks(str(tmp_path))
    rows = Analysis(load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"])).enriched_wide.filter("resource = 'elec' AND num_bat IS NULL").collect()
    assert [(r["2023_conso"], r["Evol_2023-2024"]) for r in rows] == [(2.0, 10.0)]


def test_unknown_resources_are_named(spark, tmp_path):
    from fluxsite.config import AnalysisConfig, Rates
    from fluxsite.plans import cli

    with pytest.raises(ValueError, match="'wood'"):
        Rates.of({"wood": 1.0})
    with pytest.raises(ValueError, match="'wood'"):
        AnalysisConfig(resources=("elec", "wood"))
    p = write_workbooks(str(tmp_path))
    with pytest.raises(ValueError, match="'wood'"):
        cli.main(["--state", p["state"], "--rooms", p["rooms"], "--staff", p["staff"], "--conso", "wood=x", "--out", "y"])
    run = Analysis(load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"]))
    with pytest.raises(ValueError, match="'wood'"):
        run.enriched_table("wood")


def test_work_folder_must_be_shared(spark):
    from fluxsite.session import shared_folder

    class Session:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {"spark.checkpoint.dir": "file:///shared/x"}

    assert shared_folder(Session, "file:/shared/x/y") and shared_folder(Session, "hdfs://a/b") == "hdfs://a/b"
    with pytest.raises(ValueError, match="local to one machine"):
        shared_folder(Session, "file:///tmp/y")


def test_schema_drift_of_variation_columns(spark, tmp_path, monkeypatch):
    """Sheets carry different 'Evol_*' columns (A12): they are unioned by name
    and reach the export; electricity sums them per building (Q7)."""
    import worked_example as W
    conso = dict(W.CONSO)
    conso["gaz"] = [W.CONSO_HEADER[:4] + ["Evol 2023/2024 en %"]] + [row[:4] + ["5"] for row in W.CONSO["gaz"][1:]]
    conso["elec"] = [W.CONSO_HEADER] + [row[:4] + ["10", "1", "c"] for row in W.CONSO["elec"][1:]]
    monkeypatch.setattr(W, "CONSO", conso)
    p = W.write_workbooks(str(tmp_path))
    a = Analysis(load_inputs(spark, p["state"], p["rooms"], p["staff"], p["conso"]))
    rows = {r["resource"]: r for r in a.enriched_wide.filter("Unite = 'AGAP' and num_bat = '0010'").collect()}
    assert rows["gaz"]["Evol_2023-2024"] is None and rows["gaz"]["Evol_2023-2024_p"] == 5.0
    assert rows["elec"]["Evol_2023-2024"] == 20.0 and rows["elec"]["Evol_2023-2024_p"] == 2.0
