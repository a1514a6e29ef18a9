"""Scalar cases and NULL/NaN rules (FIXTURES.md section 4, SURVEY N1-N11)."""

import math

from pyspark.sql import functions as F

from conftest import same
from fluxsite.functions import nulls as N
from fluxsite.functions import text as T
from fluxsite.sources.headers import classify_header, header_mapping
from fluxsite.sources.sheets import apply_na_tokens


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_separator_count(spark):
    got = one(spark, T.separator_count("s"), [("A, B et C",), ("A - B/C;D+E",), ("Pierre-Yves",), (None,)], "s string")
    assert got == [2, 4, 0, None]


def test_headcount(spark):
    data = [("A, B et C",), ("Locaux, x",), ("?",), ("Salle 4 personnes",), (None,), ("Parc véhicules",), ("COMMUN",)]
    got = one(spark, T.headcount_estimate("s"), data, "s string")
    assert got == [3.0, 0.0, 0.0, 4.0, None, 0.0, 0.0]


def test_code_extraction(spark):
    got = one(spark, T.extract_code("s", 5, 4), [("ABCD0110x",), ("abc",)], "s string")
    assert got == ["0110", ""]
    assert one(spark, T.staff_building_code("s"), [("B0010",)], "s string") == ["0010"]


def test_ieee_div(spark):
    data = [(1.0, 0.0), (0.0, 0.0), (-2.0, 0.0), (3.0, 2.0), (None, 0.0), (1.0, None)]
    got = one(spark, N.ieee_div("a", "b"), data, "a double, b double")
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] == -math.inf
    assert got[3] == 1.5 and got[4] is None and got[5] is None


def test_years():
    from fluxsite.functions.text import extract_years

    assert extract_years("Différence 2022 et 2023") == ["2022", "2023"]
    assert extract_years("code 120245") == ["2024"]


def test_years_column(spark):
    got = one(spark, F.array_join(T.years_in("s"), ","), [("Différence 2022 et 2023",), ("x",)], "s string")
    assert got == ["2022,2023", ""]


def test_lenient_cast(spark):
    got = one(spark, T.lenient_double("s"), [("ND",), ("1,5",), (" 12 ",)], "s string")
    assert got == [None, None, 12.0]


def test_canonical_unit(spark):
    got = one(spark, T.canonical_unit("s"), [("sdar mutualisé",), ("LEPSE/IPSiM",), (None,), ("agap",)], "s string")
    assert got == ["SDAR", "LEPSE/IPSIM", None, "AGAP"]


def test_member_count(spark):
    assert one(spark, T.member_count("s"), [("A/B/C",), ("A",), (None,)], "s string") == [3.0, 1.0, None]


def test_sum_na_rm_and_strict(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("a", float("nan")), ("b", None), ("c", 2.0), ("c", 3.0)], "k string, x double"
    )
    r = {row["k"]: row for row in df.groupBy("k").agg(N.sum_na_rm("x").alias("s"), N.strict_sum("x").alias("t")).collect()}
    assert r["a"]["s"] == 1.0 and r["a"]["t"] is None
    assert r["b"]["s"] == 0.0 and r["b"]["t"] is None
    assert r["c"]["s"] == 5.0 and r["c"]["t"] == 5.0
    nan = spark.createDataFrame([("d", 1.0), ("d", float("nan"))], "k string, x double")
    assert math.isnan(nan.groupBy("k").agg(N.strict_sum("x").alias("t")).collect()[0]["t"])


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("IA",), ("AGAP",), (None,)], "u string")
    assert sorted(df.filter(N.not_in_null_safe("u", ["IA"])).collect(), key=str) == sorted([("AGAP",), (None,)], key=str)


def test_row_sum(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(N.row_sum_na_rm(["a", "b", "c"])).collect()] == [1.0, 0.0]


def test_dropna_treats_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "x double")
    assert df.dropna(how="any").count() == 2


def test_na_tokens(spark):
    df = spark.createDataFrame([("ND", "1"), ("NA", "x"), ("ok", None)], "a string, b string")
    assert [tuple(r) for r in apply_na_tokens(df).collect()] == [(None, "1"), (None, "x"), ("ok", None)]


def test_header_classification():
    assert classify_header("Conso 2023 (kWh)") == "2023_conso"
    assert classify_header("CONSO 2023") == "2023_conso"
    assert classify_header("Différence 2022 et 2023") == "Evol_2022-2023"
    assert classify_header("Conso 2022-2023") == "Evol_2022-2023"
    assert classify_header("Evol 2023/2024 en %") == "Evol_2023-2024_p"
    for dropped in ["Commentaire", "Surface 2023", "2021 2022 2023"]:
        assert classify_header(dropped) is None


def test_header_mapping_last_wins_first_position():
    m = header_mapping(["Bat", "Conso 2023 a", "Conso 2022", "conso 2023 b", "Note"])
    assert list(m) == ["batiment", "2023_conso", "2022_conso", "derniere_conso"]
    assert m["2023_conso"] == "conso 2023 b" and m["derniere_conso"] == "conso 2023 b"


def test_header_mapping_without_years():
    assert list(header_mapping(["Bat", "Note"])) == ["batiment"]


def test_same_helper():
    assert same(float("nan"), float("nan")) and same(None, None) and not same(None, 0.0)


def _headcount_rule(s):
    """The head-count rule in plain Python: later rules override earlier ones."""
    import re

    if s is None:
        return None
    n = len(re.findall(r",|/| et | - |\+|;", s)) + 1.0
    if "Locaux" in s:
        n = 0.0
    if re.search(r"véhicules|\?|COMMUN", s):
        n = 0.0
    if re.search(r"Salle|salle", s):
        n = 0.0
    if "4 personnes" in s:
        n = 4.0
    return n


def test_headcount_matches_the_rule_on_random_text(spark):
    import random

    pieces = ["Dupont", ", ", "/", " et ", " - ", "+", ";", "Locaux", "?", "COMMUN", "véhicules", "Salle", "salle",
              "4 personnes", " ", "-", "et", "x"]
    rng = random.Random(7)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(400)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(T.headcount_estimate("s")).collect()]
    assert got == [_headcount_rule(t) for t in texts]
