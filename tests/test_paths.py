"""Columns over graph paths."""

from helixmill.functions.paths import node_bounds
from helixmill.operators import coverage
from pyspark.sql import functions as F


def test_bounds_of_a_path_are_parsed_once(spark):
    rows = [(">12<3>45",), ("",), (None,), ("x7,y",), (">000001l>9",)]
    frame = spark.createDataFrame(rows, "path string")
    low, high = node_bounds(F.col("path"))
    made = frame.select(low.alias("low"), high.alias("high"))
    assert [tuple(r) for r in made.collect()] == [(3, 45), (-1, -1), (-1, -1), (7, 7), (1, 9)]
    assert "lambda" not in made._jdf.queryExecution().executedPlan().toString()  # two lambdas over one path are never seen as equal


def test_incidence_is_dealt_out_before_equal_rows_are_dropped(spark):
    rows = [("S1", "H0", 0, 1), ("S1", "H0", 1, 2), ("S1", "H0", 2, 1), ("S1", "H1", 0, 1), ("S2", "H0", 0, None)]
    made = coverage.incidence(spark.createDataFrame(rows, "species string, hap_id string, pos int, node_id bigint"))
    assert sorted(map(tuple, made.collect()), key=str) == [("S1", "H0", 1), ("S1", "H0", 2), ("S1", "H1", 1), ("S2", "H0", None)]
    plan = made._jdf.queryExecution().sparkPlan().toString() + made._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan.rpartition("Exchange hashpartitioning")[2]
