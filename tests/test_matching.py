"""Names inside labels: the automaton against plain containment tests."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import same
from fluxsite.config import AnalysisConfig
from fluxsite.operators.matching import names_in_labels
from fluxsite.operators.redistribute import redistribute_by_building_unit, redistribute_by_unit

CFG = AnalysisConfig()
VALUES = ", ".join(f"{c} double" for c in CFG.value_columns.values())


@pytest.mark.parametrize("most", [1, 3, 100])
def test_every_name_is_found_once(spark, most):
    labels = ["abcab", "xaby", "", None, "0290-AB/é", "éé", "ab"]
    names = ["ab", "a", "abc", "é", "-", "0290", "zz", "ab", None, "éé"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(labels)], "i int, label string")
    got = names_in_labels(rows, "label", spark.createDataFrame([(n,) for n in names], "name string"), most).collect()
    found = [(r.i, n) for r in got for n in r.names]
    want = {(i, n) for i, t in enumerate(labels) for n in names if n is not None and t is not None and n in t}
    assert len(found) == len(set(found)) and set(found) == want


def test_the_empty_name_is_in_every_label(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "label string")
    got = names_in_labels(rows, "label", spark.createDataFrame([("",), ("b",)], "name string")).collect()
    assert {r.label: sorted(r.names) for r in got} == {"a": [""], "b": ["", "b"]}


def brute_force(rows):
    """The reference's loops: every (building, unit) that is a label of its own gets the
    share of every row whose label contains both."""
    labels = [("NA" if b is None else b, u, f"{'NA' if b is None else b}-{u}", v) for b, u, v in rows if u is not None]
    out = {}
    for code in {b for b, *_ in labels}:
        for unit in {u for _, u, *_ in labels if "/" not in u}:
            key = f"{code}-{unit}"
            if "/" in key or key not in {t for _, _, t, _ in labels}:
                continue
            total = 0.0
            for _, u, label, value in labels:
                if unit in label and code in label:
                    total = None if total is None or value is None else total + value / (u.count("/") + 1)
            out[key] = total
    return out


UNITS = ["B1", "B10", "B1/B2", "B2", "B10/0030", "0010", "B1/0010/B2", "A-B1", "10", None]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from(["0010", "0030", "00", "0010B", None]), st.sampled_from(UNITS), st.one_of(st.none(), st.sampled_from([0.0, 1.0, 2.5, 8.0]))),
        min_size=1, max_size=14, unique_by=lambda t: t[:2],
    ),
    st.sampled_from([1, 2, 1000]),
)
def test_building_and_unit_equal_the_loops(spark, rows, most):
    report = spark.createDataFrame([(b, u, *([v] * 5)) for b, u, v in rows], f"num_bat string, Unite string, {VALUES}")
    got = {r["batu"]: r["conso_elec_m2_kWhb"] for r in redistribute_by_building_unit(report, "contains", CFG, most=most).collect()}
    want = brute_force(rows)
    assert set(got) == set(want)
    for key in want:
        assert same(got[key], want[key]), (rows, key)


def test_a_code_inside_another_buildings_label_counts(spark):
    rows = [("0010", "AGAP", 10.0), ("0020", "AGAP/B0010", 4.0), ("0020", "LEPSE", 1.0)]
    report = spark.createDataFrame([(b, u, *([v] * 5)) for b, u, v in rows], f"num_bat string, Unite string, {VALUES}")
    got = {r["batu"]: r["conso_elec_m2_kWhb"] for r in redistribute_by_building_unit(report).collect()}
    assert got == {"0010-AGAP": 10.0 + 4.0 / 2, "0020-LEPSE": 1.0}
    token = {r["batu"]: r["conso_elec_m2_kWhb"] for r in redistribute_by_building_unit(report, "token").collect()}
    assert token == {"0010-AGAP": 10.0, "0020-LEPSE": 1.0}


def test_unit_names_in_parts(spark):
    rows = [("B1", 1.0), ("B10", 10.0), ("B10/B2", 4.0), ("B2", 2.0)]
    report = spark.createDataFrame([(u, *([x] * 5)) for u, x in rows], f"Unite string, {VALUES}")
    for most in (1, 2, 50):
        got = {r["Unite"]: r["conso_elec_m2_kWhb"] for r in redistribute_by_unit(report, "contains", CFG, most=most).collect()}
        assert got == {"B1": 13.0, "B10": 12.0, "B2": 4.0}
    with pytest.raises(ValueError, match="method"):
        redistribute_by_unit(report, "other")
