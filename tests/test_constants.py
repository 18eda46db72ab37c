"""One group of all rows, and none: values of a table of one row become constants."""

from starframe.operators import _groups as G
from starframe.operators import stats


def test_stretch_of_all_rows_equals_that_of_one_group(spark):
    rows = [(float(k % 97) ** 1.5,) for k in range(3000)] + [(5.0,)] * 4000 + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "v double").selectExpr("v", "1 AS k")
    one, grouped = stats.auto_stretch(df, "v").collect(), stats.auto_stretch(df, "v", ["k"]).drop("k").collect()
    assert len(one) == 1 and one == grouped
    assert one[0].median != 5.0


def test_no_rows_no_group(spark):
    empty = spark.createDataFrame([], "v double")
    assert G.attach(spark.range(3), empty, []).columns == ["id", "v"]
    assert G.attach(spark.range(3), empty, []).count() == 0
    assert stats.auto_stretch(empty, "v").count() == stats.auto_stretch(empty.selectExpr("v", "1 AS k"), "v", ["k"]).count()


def test_plans_hold_no_cross_join(spark):
    df = spark.range(1000).selectExpr("cast(id % 89 as double) AS v")
    plan = stats.auto_stretch(df, "v")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
