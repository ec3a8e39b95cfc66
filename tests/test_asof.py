"""As-of joins against a plain search: directions, tolerance, ties, missing times, skew, and what the plan moves."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.joins import asof_join

BASE = dt.datetime(2024, 1, 1)


def tables(spark, n, m, seed, names="aab"):
    r = random.Random(seed)
    left = [(r.choice(names), r.choice([None] + [r.randrange(500)] * 9), i, True) for i in range(n)]
    right = [(r.choice("abz"), r.choice([None] + [r.randrange(500)] * 9), i, r.choice([None, 1.5, 2.5]), "x") for i in range(m)]

    def frame(rows, ddl):
        df = spark.createDataFrame(rows, ddl)
        moment = F.lit(BASE).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s"))
        return df.withColumn("ts", F.when(F.col("s").isNotNull(), moment)).drop("s")

    return left, right, frame(left, "k string, s int, i int, __side boolean"), frame(right, "k string, s int, j int, v double, i string")


def nearest(right, key, second, direction, tolerance):
    if second is None:
        return None
    mine = [x for x in right if x[0] == key and x[1] is not None]
    if direction == "backward":
        mine = [x for x in mine if x[1] <= second and (tolerance is None or second - x[1] <= tolerance)]
        return max(mine, key=lambda x: (x[1], x[2]), default=None)
    mine = [x for x in mine if x[1] >= second and (tolerance is None or x[1] - second <= tolerance)]
    return min(mine, key=lambda x: (x[1], x[2]), default=None)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 7])
def test_against_search(spark, direction, tolerance):
    left, right, a, b = tables(spark, 300, 60, 4)
    out = asof_join(a, b, ["k"], ["v", "j"], direction=direction, tolerance_s=tolerance, tie=["j"], matched="at")
    assert out.columns == ["k", "i", "__side", "ts", "v", "j", "at"]
    got = {r.i: (r.v, r.j) for r in out.collect()}
    want = {i: (lambda x: (x[3], x[2]) if x else (None, None))(nearest(right, k, s, direction, tolerance)) for k, s, i, _ in left}
    assert got == want


def test_hot_series_and_empty_sides(spark):
    left, right, a, b = tables(spark, 3000, 5, 9, names="a")
    got = {r.i: r.j for r in asof_join(a, b, ["k"], ["j"], tie=["j"]).collect()}
    assert got == {i: (lambda x: x[2] if x else None)(nearest(right, k, s, "backward", None)) for k, s, i, _ in left}
    assert {r.j for r in asof_join(a, b.limit(0), ["k"], ["j"]).collect()} == {None}
    assert asof_join(a.limit(0), b, ["k"], ["j"]).count() == 0


def test_plan_has_no_join_of_the_sides(spark):
    """Both sides meet in one range split; the joins left are those of the chunks' summaries, at most one row each."""
    _, _, a, b = tables(spark, 200, 50, 1)
    plan = asof_join(a, b, ["k"], ["v"], tie=["j"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "_chunk" in plan.split("Join")[1].split("\n")[0]


def test_names(spark):
    _, _, a, b = tables(spark, 5, 5, 1)
    with pytest.raises(ValueError):
        asof_join(a, b, ["k"], ["i"])
    with pytest.raises(ValueError):
        asof_join(a, b, ["k"], ["v"], direction="nearest")
