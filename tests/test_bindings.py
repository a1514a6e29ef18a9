"""The test-data views use every row of the driver tables (no subsets)."""

import os

import pytest
from pyspark.sql import functions as F

from fluxsite.sources import bindings as B

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data absent")


def test_every_row_is_used(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    assert B.rooms(spark, SF).count() == read("part").count()
    own = B.state(spark, SF).filter("NOT nom_bat LIKE '% annexe'")
    assert own.count() == read("supplier").count()
    twice = B.state(spark, SF).groupBy("num_bat").count().filter("count > 1").count()
    assert twice == read("supplier").filter("s_suppkey % 7 = 3").count() > 0
    assert B.staff(spark, SF).count() == read("customer").count()
    li = read("lineitem")
    res_idx = (F.col("l_linenumber") - 1) % 5 + 1
    nulled = (res_idx == 3) & (F.col("l_suppkey") % 97 == 3) & (F.year("l_shipdate") + 20 == 2021)
    expected = li.filter(~nulled).agg(F.sum("l_quantity")).first()[0]
    got = B.meters(spark, SF).agg(F.sum("conso")).first()[0]
    assert abs(got - expected) < 1e-6
    assert B.meters(spark, SF).select("resource").distinct().count() == 5
