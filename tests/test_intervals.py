"""Tables of rules: flattening, the index of equal depth, and crowded times, against a plain search."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals
from strandline.operators.intervals import Rule, flag_by_rules, regime_of

START = dt.datetime(2024, 1, 1)


def at(second: float) -> str:
    return str(START + dt.timedelta(seconds=second))


def rules_of(spark, rows):
    df = spark.createDataFrame(rows, "series string, prio int, a string, b string, code int, note string")
    stamps = {"start": F.col("a").cast("timestamp_ntz"), "end": F.col("b").cast("timestamp_ntz")}
    return df.withColumns(stamps).drop("a", "b")


def points(spark, n, names="xyz", span=1000):
    r = random.Random(n)
    rows = [(i, r.choice(names), at(r.randrange(span))) for i in range(n)] + [(n, "x", None), (n + 1, None, at(5))]
    return rows, spark.createDataFrame(rows, "n int, series string, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))


def first(rows, series, moment):
    found = [
        (prio, code) for s, prio, a, b, code, _ in rows
        if moment and (s is None or s == series) and (a is None or moment > a) and (b is None or moment < b)
    ]
    return min(found)[1] if found else 0


def some_rules(n, seed, named=True):
    r = random.Random(seed)
    out = []
    for k in range(n):
        a = r.randrange(1000)
        b = a + r.choice([0, 1, 3, 50, 400, -5])
        out.append((r.choice(["x", "y", None, "other"]) if named else None, k, r.choice([at(a)] * 6 + [None]), r.choice([at(b)] * 6 + [None]), r.randrange(1, 9), "x"))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(
    "named,few,whole,depth", [(True, 256, 2048, 10), (True, 0, 0, 2), (False, 0, 2048, 10), (False, 0, 0, 2)]
)
def test_every_path_finds_the_first_rule(spark, monkeypatch, named, few, whole, depth):
    """CASE, array in the expression, one bucket, and many buckets of four steps."""
    for name, value in (("FEW", few), ("WHOLE", whole), ("DEPTH", depth)):
        monkeypatch.setattr(intervals, name, value)
    rows = some_rules(60, 3, named)
    asked, df = points(spark, 300)
    given = rules_of(spark, rows) if named else rules_of(spark, rows).drop("series")
    table = flag_by_rules(df, given, series="series" if named else None)
    got = {r.n: r.flag for r in table.collect()}
    assert got == {n: first(rows, s, t) for n, s, t in asked}
    ordered = sorted(rows, key=lambda x: x[1])
    listed = flag_by_rules(df, [Rule(a, b, c, s) for s, _, a, b, c, _ in ordered], series="series" if named else None)
    assert {r.n: r.flag for r in listed.collect()} == got


def test_no_rules(spark):
    _, df = points(spark, 20)
    nothing = rules_of(spark, some_rules(5, 1)).limit(0)
    assert {r.flag for r in flag_by_rules(df, nothing, series="series").collect()} == {0}
    assert {r.flag for r in flag_by_rules(df, []).collect()} == {0}
    assert regime_of(df, nothing, series="series").count() == 0


def test_clashing_series_names(spark):
    """An empty series name is a series of its own, and general rules are not mistaken for it."""
    df = spark.createDataFrame([(1, "", at(5)), (2, "x", at(5))], "n int, series string, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    rows = [("", 0, None, None, 7, "x")]
    assert {r.n: r.flag for r in flag_by_rules(df, rules_of(spark, rows), series="series").collect()} == {1: 7, 2: 0}


def test_crowded_rules_fill_buckets_evenly(spark):
    """Nearly all rules of a year lie in one minute: no bucket holds more than its share, and no time is lost."""
    ticks = spark.range(50_000)
    crowded = ticks.select(
        F.expr("timestamp_ntz'2024-06-01' + make_dt_interval(0, 0, 0, id * 0.001)").alias("start"),
        F.expr("timestamp_ntz'2024-06-01' + make_dt_interval(0, 0, 0, (id + 1) * 0.001)").alias("end"),
        F.col("id").alias("prio"), (F.col("id") % 5 + 1).alias("code"),
    )
    rare = spark.createDataFrame([(60_000 + d, f"2024-{d:02d}-01") for d in range(1, 13)], "prio int, t string").select(
        F.col("t").cast("timestamp_ntz").alias("start"), F.expr("cast(t as timestamp_ntz) + interval 1 day").alias("end"), "prio", F.lit(9).alias("code")
    )
    rules = crowded.select("prio", "start", "end", "code").unionByName(rare)
    plain = rules.select(
        F.lit("").alias("__for"), (intervals.to_micros("start") + 1).alias("__lo"), intervals.to_micros("end").alias("__hi"),
        F.col("prio").cast("int").alias("__prio"), F.col("code").cast("int").alias("__code"),
    )
    steps = intervals._steps_of_table(plain)
    sizes = [r["count"] for r in steps.groupBy(F.shiftright("__n", intervals.DEPTH)).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    df = ticks.select("id", F.expr("timestamp_ntz'2024-06-01' + make_dt_interval(0, 0, 0, id * 0.001 + 0.0005)").alias("ts"))
    out = flag_by_rules(df, rules)
    assert out.where("flag <> id % 5 + 1").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_nested_rules_stay_linear(spark):
    """Ten thousand rules inside each other: every rule is kept at a logarithmic number of nodes, not once for each step."""
    n = 10_000
    rules = spark.range(n).select(
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("start"),
        F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, {3 * n} - id)").alias("end"),
        F.col("id").alias("prio"), F.col("id").cast("int").alias("code"),
    )
    df = spark.range(0, 3 * n, 97).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id + 0.5)").alias("ts"))
    assert flag_by_rules(df, rules, default=-1).where("flag <> 0").count() == 0
    last_first = rules.withColumn("prio", -F.col("prio"))
    got = {r.id: r.flag for r in flag_by_rules(df, last_first, default=-1).collect()}
    assert all(flag == min(i, n - 1, 3 * n - 1 - i) for i, flag in got.items())
