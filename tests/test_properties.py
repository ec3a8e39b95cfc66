"""Split scans and lookups agree with their plain definitions on random data."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import scalars, timefn
from strandline.operators import ordered, runs
from strandline.operators.intervals import Rule, flag_by_rules, regime_of

KEYS, ORDER = ["series"], ["ts", "n"]
FEW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
ROWS = st.lists(
    st.tuples(
        st.sampled_from(["a", "a", "a", "b"]),
        st.integers(0, 40),
        st.integers(0, 2),
        st.one_of(st.none(), st.integers(-5, 5).map(float)),
    ),
    min_size=1,
    max_size=60,
)


def frame(spark, rows):
    base = dt.datetime(2024, 1, 1)
    data = [(s, base + dt.timedelta(minutes=m), i, c, v) for i, (s, m, c, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "series string, ts timestamp, n int, code int, v double")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def collect(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("n").collect()]


@FEW
@given(ROWS)
def test_split_scans_equal_plain_windows(spark, rows):
    df = frame(spark, rows)
    w = Window.partitionBy("series").orderBy("ts", "n")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    plain = df.withColumns(
        {
            "idx": F.row_number().over(w).cast("bigint"),
            "down": F.last("v", True).over(back),
            "up": F.first("v", True).over(ahead),
            "total": F.sum("v").over(back),
        }
    )
    seq = ordered.sequence(
        df.withColumns({"down": F.col("v"), "up": F.col("v")}), KEYS, ORDER
    )
    out = ordered.row_index(seq, KEYS, ORDER)
    out = ordered.fill_down(out, ["down"], KEYS, ORDER)
    out = ordered.fill_up(out, ["up"], KEYS, ORDER)
    out = ordered.cumulative_sum(out, "v", KEYS, ORDER, "total")
    cols = ["idx", "down", "up", "total"]
    assert collect(out, *cols) == collect(plain, *cols)
    assert collect(ordered.row_index(df, KEYS, ORDER), "idx") == collect(plain, "idx")


@FEW
@given(ROWS)
def test_runs_tile_the_series(spark, rows):
    df = frame(spark, rows)
    by_series = {}
    for s, _, i, code in sorted((s, m, i, c) for i, (s, m, c, _) in enumerate(rows)):
        by_series.setdefault(s, []).append((i, code))
    expected = {}
    for s, items in by_series.items():
        run = event = 0
        last = None
        for i, code in items:
            if code != last:
                run += 1
                event += code != 0
                last = code
            expected[i] = (run, event if code else 0)
    numbered = ordered.run_ids(df, "code", KEYS, ORDER)
    got = {r["n"]: (r["run_no"], r["run_id"]) for r in numbered.collect()}
    assert got == expected
    lengths = runs.run_length_encode(df, "code", KEYS, ORDER)
    assert lengths.agg(F.sum("length")).first()[0] == len(rows)
    assert lengths.where(F.col("idx_end") - F.col("idx_start") + 1 != F.col("length")).count() == 0
    expanded = runs.expand_runs(lengths, KEYS)
    assert expanded.count() == len(rows)


@FEW
@given(ROWS)
def test_interpolation_passes_through_known_values(spark, rows):
    df = frame(spark, rows)
    out = ordered.interpolate_linear(df, ["v"], KEYS, ORDER, out={"v": "line"})
    got = {r["n"]: (r["v"], r["line"]) for r in out.collect()}
    by_series = {}
    for s, _, i, v in sorted(
        ((s, m, i, v) for i, (s, m, _, v) in enumerate(rows)), key=lambda x: x[:3]
    ):
        by_series.setdefault(s, []).append((i, v))
    for items in by_series.values():
        known = [(x, v) for x, (_, v) in enumerate(items) if v is not None]
        for x, (i, v) in enumerate(items):
            left = [k for k in known if k[0] <= x]
            right = [k for k in known if k[0] >= x]
            if v is not None:
                want = v
            elif left and right:
                (x0, v0), (x1, v1) = left[-1], right[0]
                want = v0 + (v1 - v0) * (x - x0) / (x1 - x0)
            else:
                want = None
            have = got[i][1]
            assert (have is None) == (want is None)
            if want is not None:
                assert abs(have - want) < 1e-9


BOUND = st.one_of(st.none(), st.integers(0, 4000))


@FEW
@given(st.lists(st.tuples(BOUND, BOUND, st.integers(1, 3)), max_size=8), st.lists(st.integers(0, 4000), min_size=1, max_size=30))
def test_rule_lookup_equals_a_ladder(spark, spans, minutes):
    base = dt.datetime(2024, 1, 1)
    text = lambda m: None if m is None else str(base + dt.timedelta(minutes=m))
    rules = [Rule(text(a), text(b), c) for a, b, c in spans]
    df = spark.createDataFrame(
        [(i, base + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)], "n int, ts timestamp"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    arms = [(timefn.between_open("ts", x.start, x.end), x.code) for x in rules]
    ladder = scalars.first_match(arms, 0)
    out = flag_by_rules(df, rules).withColumn("ladder", ladder)
    assert out.where(~F.col("flag").eqNullSafe(F.col("ladder"))).count() == 0
    inside = regime_of(df, rules).count() if rules else 0
    assert inside == out.where(F.col("ladder") != 0).count()


def test_regimes_equal_the_union_of_filters(spark, sf_dir):
    from catalog.base import Tables

    df = Tables(spark, sf_dir).signal()
    regimes = [Rule(None, "2024-01-11", 0), Rule("2024-01-11", "2024-01-14 08:17", 1),
               Rule("2024-01-14 08:17", None, 2)]
    parts = [
        df.where(timefn.between_open("ts", x.start, x.end)).withColumn("regime", F.lit(x.code))
        for x in regimes
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("event_id", "regime")
    joined = regime_of(df, regimes).select("event_id", "regime")
    assert union.exceptAll(joined).count() == 0 and joined.exceptAll(union).count() == 0


def test_one_crowded_day_is_split(spark):
    """A third of all rows in one minute of one series still spreads over the chunks."""
    hot = spark.range(6000).select(
        F.lit("a").alias("series"), F.lit("2024-01-05 10:00:00").cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("n"), F.when(F.col("id") % 97 == 0, F.col("id") * 1.0).alias("v"),
    )
    rest = spark.range(12000).select(
        F.concat(F.lit("s"), (F.col("id") % 40).cast("string")).alias("series"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
        (F.col("id") + 6000).alias("n"), F.lit(None).cast("double").alias("v"),
    )
    seq = ordered.sequence(hot.unionByName(rest), KEYS, ORDER)
    sizes = [r["count"] for r in seq.groupBy(ordered.CHUNK).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 2 * 18000 / 5
    filled = ordered.fill_down(seq, ["v"], KEYS, ORDER).where("series = 'a'")
    assert filled.where(F.col("v") != F.floor(F.col("n") / 97) * 97).count() == 0
    assert filled.where("v IS NULL").count() == 0


def test_paired_moments_equal_the_joined_rows(spark):
    """Statistics over a fan-out join match the rows the join would build."""
    from strandline.operators.joins import left_join
    from strandline.operators.resample import time_average
    from strandline.operators.stats import fanout_stats
    from strandline.plans import pairs

    def side(n, step, name):
        return spark.range(n).select(
            F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("series"),
            F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") / step) * 1800)
            .cast("timestamp_ntz").alias("ts"),
            F.when(F.pmod(F.xxhash64("id"), F.lit(5)) > 0, F.sin("id") + 10).alias(name),
        )

    left, right = side(300, 4, "x"), side(200, 7, "y")
    joined = left_join(left, right, ["series", "ts"])
    moments = pairs.paired_moments(left, right, KEYS, ["x"], ["y"])
    assert moments.agg(F.sum("pairs")).first()[0] == joined.count()
    want = time_average(joined, "2 hour", KEYS)
    got = pairs.paired_average(moments, "2 hour", KEYS, ["x", "y"])
    rows = lambda df, by: [
        tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r)
        for r in df.select(*by, *sorted(c for c in df.columns if c not in by)).orderBy(*by).collect()
    ]
    assert rows(got, ["series", "ts"]) == rows(want, ["series", "ts"])
    by = ["series", "hour"]
    want = fanout_stats(joined.withColumn("hour", F.hour("ts")).drop("ts"), by)
    assert rows(pairs.paired_hour_stats(moments, KEYS, ["x", "y"]), by) == rows(want, by)
