"""CSV files read by many tasks: records with line breaks, cut at true record ends."""

import csv
import random
from contextlib import contextmanager

import pytest

from fluxsite.sources.records import csv_records
from fluxsite.sources.sheets import read_sheet


@contextmanager
def splits_of(spark, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


PIECES = ["a", "é", '"', ",", "\n", "\r\n", " x", ";", '""', '",', "\n\n", "0290"]


def random_rows(seed, n, width=3):
    r = random.Random(seed)
    cell = lambda: "".join(r.choice(PIECES) for _ in range(r.choice([0, 1, 2, 3, 12])))
    return [[f"k{k}", *[cell() for _ in range(width - 1)]] for k in range(n)]


def write_csv(path, rows, encoding="utf-8", **kind):
    with open(path, "w", newline="", encoding=encoding) as f:
        csv.writer(f, **kind).writerows(rows)


def cells(df):
    """Rows in file order, cells as written but for what every sheet loses (outer white space)."""
    rows = df.collect()
    names = [c for c in df.columns if c != "ordinal"]
    return [[r[c] or "" for c in names] for r in sorted(rows, key=lambda r: r["ordinal"])]


def trimmed(rows):
    return [[c.strip(" \t\r\n\xa0") for c in row] for row in rows]


@pytest.mark.parametrize("seed,size,line", [(1, 64, "\r\n"), (2, 200, "\n"), (3, 1000, "\r\n"), (4, 1 << 20, "\n")])
def test_records_equal_a_csv_reader(spark, tmp_path, seed, size, line):
    """From splits shorter than a record to one for all."""
    header, rows = ["name", "b", "c"], random_rows(seed, 150)
    write_csv(tmp_path / "s.csv", [header, *rows], lineterminator=line)
    with splits_of(spark, size):
        sheet = read_sheet(spark, str(tmp_path / "s.csv"), na_tokens=(), split=True)
        assert cells(sheet) == trimmed(rows)
        assert len({r["ordinal"] for r in sheet.select("ordinal").collect()}) == len(rows)


def test_line_breaks_inside_cells_are_kept(spark, tmp_path):
    rows = [["1", "a\r\nb"], ["2", "a\nb\n\nc"], ["3", 'say "x\ny"']]
    write_csv(tmp_path / "s.csv", [["k", "v"], *rows], lineterminator="\r\n")
    with splits_of(spark, 8):
        assert cells(read_sheet(spark, str(tmp_path / "s.csv"), split=True)) == rows


def test_a_cell_longer_than_many_splits(spark, tmp_path):
    long = "line, with comma\n" * 400 + "end"
    rows = [["1", "x"], ["2", long], ["3", "y"], ["4", long]]
    write_csv(tmp_path / "s.csv", [["k", "v"], *rows])
    with splits_of(spark, 256):
        path = str(tmp_path / "s.csv")
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        assert cells(read_sheet(spark, path, split=True)) == rows


def test_whole_records_of_many_lines_are_put_together_in_arrow():
    """No Python object for each line of a record that a batch holds whole."""
    import pyarrow as pa

    from fluxsite.sources import records

    lines = ['"a', 'b"', "c", '"d', "", 'e"', '"f'] + ['g"', '"h'] * 1000 + ['i"']
    batch = pa.RecordBatch.from_pydict({"line": lines, "_file": [7] * len(lines), "_block": [0] * len(lines), "_open": [False] * len(lines)})
    found = list(records._cut('"')(iter([batch.slice(0, 5), batch.slice(5)])))
    rows = sorted(r for b in found for r in zip(b.column("_at").to_pylist(), b.column("record").to_pylist(), b.column("_kind").to_pylist()))
    assert [r[1] for r in rows[:4]] == ['"a\nb"', "c", '"d\n\ne"', '"f\ng"'] and len(rows) == 1004
    assert rows[-1] == (2006, '"h\ni"', records.WHOLE) and {r[2] for r in rows} == {records.WHOLE}
    assert max(len(b) for b in found) > 900  # together, as they were cut


def test_files_follow_each_other(spark, tmp_path):
    (tmp_path / "sheet").mkdir()
    parts = [random_rows(s, 40) for s in (5, 6, 7)]
    for name, rows in zip(("a.csv", "b.csv", "c d.csv"), parts, strict=True):
        write_csv(tmp_path / "sheet" / name, [["name", "b", "c"], *rows])
    with splits_of(spark, 300):
        assert cells(read_sheet(spark, str(tmp_path / "sheet"), na_tokens=(), split=True)) == trimmed(sum(parts, []))


def test_other_encodings_and_separators(spark, tmp_path):
    rows = [["é\nà", "1"], ["ÿ;", "2"]]
    write_csv(tmp_path / "s.csv", [["Bâtiment", "n"], *rows], encoding="latin-1", delimiter=";")
    with splits_of(spark, 10):
        sheet = read_sheet(spark, str(tmp_path / "s.csv"), sep=";", encoding="ISO-8859-1", split=True)
        assert sheet.columns[0] == "Bâtiment" and cells(sheet) == rows
    write_csv(tmp_path / "bom.csv", [["k", "k", ""], ["1", "2", "3"]], encoding="utf-8-sig")
    sheet = read_sheet(spark, str(tmp_path / "bom.csv"), split=True)
    assert cells(sheet) == [["1", "2", "3"]] and len(set(sheet.columns)) == 4


def test_damaged_files_fail(spark, tmp_path):
    (tmp_path / "odd.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(Exception, match="odd number of quotes"):
        csv_records(spark, str(tmp_path / "odd.csv")).collect()
    (tmp_path / "ragged.csv").write_text("a,b,c\n1,2,3\n4,5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_sheet(spark, str(tmp_path / "ragged.csv"), split=True).select("a").collect()
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "many" / "b.csv").write_text("a,c\n1,2\n")
    with pytest.raises(Exception, match="not the header"):
        read_sheet(spark, str(tmp_path / "many"), split=True).collect()


def test_blank_lines_and_sheets_without_rows(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b\n\n1,2\n   \n\n3,4\n\n")
    assert cells(read_sheet(spark, str(tmp_path / "s.csv"), split=True)) == [["1", "2"], ["3", "4"]]
    (tmp_path / "t.csv").write_text("a,b\n")
    assert read_sheet(spark, str(tmp_path / "t.csv"), split=True).count() == 0


def test_large_files_are_split_by_themselves(spark, tmp_path):
    rows = [[str(k), f"v\n{k}"] for k in range(3000)]
    write_csv(tmp_path / "s.csv", [["k", "v"], *rows])
    plan = lambda: read_sheet(spark, str(tmp_path / "s.csv"))._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" not in plan()
    with splits_of(spark, 4096):
        assert "MapInArrow" in plan()
        sheet = read_sheet(spark, str(tmp_path / "s.csv"))
        assert cells(sheet) == rows


def test_too_many_files_for_the_row_keys(spark, monkeypatch):
    from fluxsite.sources import sheets

    monkeypatch.setattr(sheets, "MOST_FILES", 1)

    class Files:
        sparkSession = spark

        def inputFiles(self):
            return ["a", "b"]

    with pytest.raises(ValueError, match="2 files"):
        sheets._file_numbers(Files())
