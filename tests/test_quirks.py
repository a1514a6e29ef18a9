"""Small cases for rules the worked example does not reach."""

from pyspark.sql import functions as F

from conftest import same
from fluxsite.config import AnalysisConfig
from fluxsite.functions.text import substrings_without_slash
from fluxsite.operators import meters as M
from fluxsite.operators import occupancy as O
from fluxsite.operators import reports as P
from fluxsite.operators.redistribute import redistribute_by_unit

CFG = AnalysisConfig()


def test_n8_staff_recode_keeps_null(spark):
    staff = spark.createDataFrame([(None, "B0010"), ("Associé BAP", "B0020"), ("AGAP", "B0010")], "Unite string, Bat string")
    rows = {(r["num_bat"], r["Unite"]): r["count_pers"] for r in O.staff_count(staff).collect()}
    assert rows == {(None, None): 1, ("0070", "Associé BAP"): 1, ("0010", "AGAP"): 1}


def test_n9_null_building_label(spark):
    latest = spark.createDataFrame(
        [("elec", 1, None, None, 10.0)], "resource string, ordinal long, batiment string, num_bat string, derniere_conso double"
    )
    occ = spark.createDataFrame(
        [("S", None, "AGAP", 5.0, 10.0)],
        "Site string, num_bat string, Unite string, metrage_unite_ajus double, metrage_batiment double",
    )
    rows = P.by_building_unit(M.building_stats(latest, CFG), occ, CFG).collect()
    assert [(r["num_bat"], r["Unite"], r["batu"]) for r in rows] == [(None, "AGAP", "NA-AGAP")]
    assert same(rows[0]["conso_elec_m2_kWh"], 5.0)


def test_q3_no_shared_labels(spark):
    vals = list(CFG.value_columns.values())
    schema = "Unite string, " + ", ".join(f"{c} double" for c in vals)
    rep = spark.createDataFrame([("A", *[1.0] * 5), ("B", *[2.0] * 5), (None, *[3.0] * 5)], schema)
    rows = {r["Unite"]: r["conso_elec_m2_kWhb"] for r in redistribute_by_unit(rep, "contains", CFG).collect()}
    assert rows == {"A": 1.0, "B": 2.0}


def test_long_labels_give_few_pieces(spark):
    """Only substrings as long as a real name are made of a label."""
    vals = list(CFG.value_columns.values())
    schema = "Unite string, " + ", ".join(f"{c} double" for c in vals)
    label = "/".join(["AGAP", "x" * 400, "LEPSE"])
    rep = spark.createDataFrame([("AGAP", *[1.0] * 5), ("LEPSE", *[2.0] * 5), (label, *[3.0] * 5)], schema)
    rows = {r["Unite"]: r["conso_elec_m2_kWhb"] for r in redistribute_by_unit(rep, "contains", CFG).collect()}
    assert rows == {"AGAP": 2.0, "LEPSE": 3.0}
    lengths = F.array(F.lit(4), F.lit(5))
    assert rep.select(F.size(substrings_without_slash("Unite", lengths)).alias("n")).filter("n > 10").count() == 0
