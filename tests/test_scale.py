"""What keeps the formula queries whole and quick on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import QUERIES
from quillmesh.operators import formulas, logic


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["run_metrics", "formula_iou", "formula_domain", "clause_truth"])
def test_no_table_that_grows_is_broadcast(spark, sf_dir, name):
    assert "Broadcast" not in planned(QUERIES[name](spark, sf_dir))


def test_run_metrics_joins_no_second_copy_of_the_table(spark, sf_dir):
    plan = planned(QUERIES["run_metrics"](spark, sf_dir))
    assert not re.findall(r"Join \[p_partkey", plan)


def test_line_breaks_in_an_expression(spark):
    text = "G_[[1, 2]] (\\forall x \\in [3, 9] (u(x) - (0.5 \\cdot x +\n -7) < 2))"
    df = spark.createDataFrame([(text,)], "sstl string")
    clause = formulas.read_formula(df, "sstl").select("parsed").first()[0][0]
    assert (clause.slope, clause.intercept, clause.status) == (0.5, -7.0, "ok")


def test_only_levels_that_an_offset_may_meet_are_compared(spark):
    """An equation whose levels lie between the offsets at all times needs no comparison per time."""
    grid = logic.ProfileGrid()
    clause = F.struct(
        F.lit("=").alias("comparison"), F.lit(False).alias("mirrored"), F.lit(10.0).alias("largest"),
        F.expr("array(1.0D, 1.1D, 1.2D)").alias("times"),
        F.expr("array(named_struct('level', 1D, 'target', 3.5D), named_struct('level', 2D, 'target', 4.0D))").alias("levels"),
    )
    near = lambda slope: F.transform(logic._near_levels(clause, F.lit(slope), grid), lambda x: x["level"])
    still, moving = spark.range(1).select(near(0.0), near(10.0)).first()
    assert still == [2.0] and moving == [1.0]


def test_no_filter_makes_masks_or_domains_again(spark, sf_dir):
    """What a filter or a generator asks of a column must not be made a second time below it."""
    filters = re.findall(r"[-+:] Filter (.*)", planned(QUERIES["clause_truth"](spark, sf_dir)))
    assert filters and not [f for f in filters if "aggregate(" in f]


def test_equal_ends_stand_for_all_times(spark):
    """Masks of order comparisons: what their two ends tell is what every time has by itself."""
    grid = logic.ProfileGrid(m_steps=6, b_steps=70)
    clause = F.struct(
        F.col("sign").alias("comparison"), F.col("sign").isin("<", "<=", ">", ">=").alias("ordered"),
        F.lit(False).alias("mirrored"), F.col("sign").isin("<", "<=").alias("true_first"),
        (F.col("sign") == "<=").alias("closed_run"), F.lit(3.0).alias("limit"), F.lit(0.5).alias("level"),
        F.lit(3.0).alias("threshold"), F.lit(10.0).alias("largest"), F.col("times"),
        F.expr("array(named_struct('level', 0.5D, 'target', 35.2D))").alias("levels"),
    )
    rows = [(s, t) for s in ("<", "<=", ">", ">=") for t in ([], [1.0], [0.1 * i for i in range(40)], [3.0 * i for i in range(9)])]
    df = spark.createDataFrame(rows, "sign string, times array<double>")
    over = lambda body: F.transform(F.sequence(F.lit(0), F.lit(grid.planes - 1)), body)
    each = lambda p: F.transform("times", lambda t: logic._ordered_truth(clause, p, logic._slope(clause, p, grid), t, grid))
    made = df.select(over(lambda p: logic.truth_masks(clause, p, grid)).alias("got"), over(each).alias("expected")).collect()
    assert all(r.got == r.expected for r in made) and any(len(set(m)) > 1 for r in made for m in r.got)
