"""Cases the catalog's data cannot show: zones, missing times and keys, long runs, many rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.functions.timefn import floor_time, round_time, shift_time
from strandline.operators.intervals import Rule, flag_by_rules
from strandline.operators.ordered import fill_down
from strandline.operators.resample import time_average
from strandline.operators.runs import expand_runs
from strandline.operators.stats import five_number, impute_group_mean


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def stamps(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))


def test_time_ignores_the_session_zone(new_york):
    df = stamps(new_york, "2024-03-10 02:30:00.123456", "2024-03-10 23:59:59", "2024-03-11 00:00:00", "0999-12-31 05:00:00")
    got = df.select(floor_time("ts", "1 day").alias("d"), round_time("ts", "1 hour").alias("h"), shift_time("ts", -1.5).alias("s")).collect()
    assert [str(r.d) for r in got] == ["2024-03-10 00:00:00"] * 2 + ["2024-03-11 00:00:00", "0999-12-31 00:00:00"]
    assert [str(r.h) for r in got[:2]] == ["2024-03-10 03:00:00", "2024-03-11 00:00:00"]
    assert str(got[0].s) == "2024-03-10 02:29:58.623456"
    days = time_average(df.withColumns({"k": F.lit("a"), "v": F.lit(1.0)}), "1 day", ["k"], cols=["v"])
    assert days.count() == 3


def test_rows_without_a_time_come_last(spark):
    df = spark.createDataFrame([("a", None, 1, 9.0), ("a", "2024-01-01", 2, None), ("a", "2024-01-02", 3, 5.0)], "k string, t string, n int, v double")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r.n: r.v for r in fill_down(df, ["v"], ["k"], ["ts", "n"]).collect()}
    assert got == {1: 9.0, 2: None, 3: 5.0}


def test_missing_key_or_hour_is_a_group(spark):
    rows = [(None, "2024-01-01 01:00", 2.0), (None, "2024-01-02 01:00", None), ("a", None, 4.0), ("a", None, None)]
    df = spark.createDataFrame(rows, "k string, t string, v double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert sorted(r.v for r in impute_group_mean(df, ["v"], ["k"]).collect()) == [2.0, 2.0, 4.0, 4.0]


def test_five_number_without_keys(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"), "id")
    assert five_number(df, "v", [], "id").first().asDict()["median"] == 50.0


def test_long_run_is_expanded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("strandline.operators.runs.BLOCK", 7)
    runs = spark.createDataFrame([("a", 1, 1, 100), ("a", 2, 101, 101), ("b", 1, 5, 7)], "k string, run_no long, idx_start long, idx_end long")
    got = sorted((r.k, r.id, r.idx) for r in expand_runs(runs, ["k"]).collect())
    assert got == [("a", 1, i) for i in range(1, 101)] + [("a", 2, 101)] + [("b", 1, i) for i in (5, 6, 7)]


def rules_table(spark, rows):
    df = spark.createDataFrame(rows, "series string, prio int, a string, b string, code int")
    return df.select("series", "prio", F.col("a").cast("timestamp_ntz").alias("start"), F.col("b").cast("timestamp_ntz").alias("end"), "code")


def test_rules_as_a_table_equal_the_list(spark):
    rows = [
        ("x", 0, "2024-01-02", "2024-01-04", 1), (None, 1, "2024-01-03", None, 2), ("y", 2, None, "2024-01-03 12:00", 3),
        (None, 3, None, None, 4), ("x", 4, "2024-01-05", "2024-01-01", 9), ("z", 5, "2024-01-01", "2024-01-02", 5),
    ]
    hours = spark.range(24 * 8).select(
        F.explode(F.array(*map(F.lit, "xyzw"))).alias("series"),
        F.expr("timestamp_ntz'2023-12-30' + make_interval(0, 0, 0, 0, int(id))").alias("ts"),
    )
    listed = flag_by_rules(hours, [Rule(a, b, c, s) for s, _, a, b, c in rows], "flag", series="series")
    tabled = flag_by_rules(hours, rules_table(spark, rows), "flag", series="series")
    assert sorted(map(str, listed.collect())) == sorted(map(str, tabled.collect()))
    at = {(r.series, str(r.ts)): r.flag for r in listed.collect()}
    assert at["x", "2024-01-03 12:00:00"] == 1 and at["y", "2024-01-03 06:00:00"] == 2 and at["y", "2024-01-02 06:00:00"] == 3
    assert at["w", "2024-01-02 06:00:00"] == 4 and at["z", "2024-01-01 06:00:00"] == 4 and at["x", "2024-01-02 00:00:00"] == 4


def test_many_rules_keep_fine_buckets(spark):
    base = dt.datetime(2024, 1, 1)
    step = dt.timedelta(seconds=10)
    rules = [Rule(str(base + i * step), str(base + (i + 1) * step), i % 7 + 1) for i in range(120_000)]
    df = spark.range(2000).select(F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 617 + 5)").alias("ts"), "id")
    out = flag_by_rules(df, rules)

    def want(second):
        return second // 10 % 7 + 1 if second < 1_200_000 and second % 10 else 0

    assert all(r.flag == want(r.id * 617 + 5) for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_thousand_series_plan_at_once(spark):
    import time

    rules = [Rule(None, "2024-01-02", 1, f"s{i}") for i in range(1000)] + [Rule("2024-01-03", None, 2, f"s{i}") for i in range(1000)]
    df = spark.range(3000).select(F.concat(F.lit("s"), F.col("id")).alias("series"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    start = time.time()
    assert flag_by_rules(df, rules, series="series").where("flag = 1").count() == 1000
    assert time.time() - start < 40
