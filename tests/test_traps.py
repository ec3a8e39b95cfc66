"""Hand-made frames, one per rule that is easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.functions import chem, scalars, timefn
from strandline.operators import columns, joins, ordered, reshape, resample, runs, stats
from strandline.operators.intervals import Rule, flag_by_rules, parse_rules, regime_of
from strandline.plans import airmass, budget, calibration, campaign, zeroing

KEYS, ORDER = ["series"], ["ts", "n"]


def values(df, *cols):
    return [tuple(row[c] for c in cols) for row in df.orderBy("series", "ts", "n").collect()]


def test_anchor_sits_on_the_half_even_row(series):
    # runs on rows 1-2 (mean 1.5), 5-8 (6.5) and 11-14 (12.5)
    code = [1, 1, 0, 0, 1, 1, 1, 1, 0, 0, 1, 1, 1, 1]
    df = series({"code": code, "ch1": [float(i) for i in range(14)]})
    out = runs.midpoint_anchors(ordered.run_ids(df, "code", KEYS, ORDER), ["ch1"], KEYS)
    marked = [i for i, v in values(out, "idx", "ch1_zeroes") if v is not None]
    assert marked == [2, 6, 12]


def test_strict_mean_is_void_with_one_gap(series):
    df = series({"code": [1, 1, 1], "ch1": [1.0, None, 3.0]})
    numbered = ordered.run_ids(df, "code", KEYS, ORDER)
    lenient = runs.run_averages(numbered, ["ch1"], KEYS).first()
    strict = runs.run_averages(numbered, ["ch1"], KEYS, strict=True).first()
    assert lenient["ch1_zeroes"] == 2.0 and lenient["ch1_zero_3sd"] == pytest.approx(3 * 2**0.5)
    assert strict["ch1_zeroes"] is None and strict["ch1_zero_3sd"] is None


def test_single_value_has_no_deviation(series):
    df = series({"code": [1], "ch1": [1.0]})
    row = runs.run_averages(ordered.run_ids(df, "code", KEYS, ORDER), ["ch1"], KEYS).first()
    assert row["ch1_zeroes"] == 1.0 and row["ch1_zero_3sd"] is None


def stamps(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    return df.select(
        F.lit("a").alias("series"), "n", F.col("t").cast("timestamp_ntz").alias("ts")
    )


def test_rows_on_a_regime_bound_vanish(spark):
    df = stamps(
        spark, "2024-09-10 23:59:59", "2024-09-11 00:00:00", "2024-09-11 00:00:00.000001",
        "2024-09-14 08:17:00", "2024-09-14 08:17:01",
    )
    kept = regime_of(df, campaign.regime_rules(campaign.REGIMES)).orderBy("n").collect()
    assert [(r["n"], r["regime"]) for r in kept] == [(0, 0), (2, 1), (4, 2)]


def test_campaign_rules_match_a_case_ladder(spark):
    day = [dt.datetime(2024, 9, 5) + dt.timedelta(minutes=i) for i in range(15 * 1440)]
    df = spark.createDataFrame([(d,) for d in day], "ts timestamp").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )
    for rules in (campaign.flag_rules(), campaign.zero_air_rules(), campaign.bad_night_rules()):
        ladder = scalars.first_match(
            [(timefn.between_open("ts", x.start, x.end), x.code) for x in rules], 0
        )
        both = flag_by_rules(df, rules, "flag").withColumn("ladder", ladder)
        assert both.where(~F.col("flag").eqNullSafe(F.col("ladder"))).count() == 0
    assert len(campaign.flag_rules()) == 48 and len(campaign.zero_air_rules()) == 45


def test_first_rule_wins_and_bounds_are_open(spark):
    rules = [
        Rule("2024-01-01 10:00", "2024-01-01 11:00", 2),
        Rule("2024-01-01 09:00", "2024-01-03 12:00", 1),
        Rule(None, "2024-01-01", 7),
        Rule("2024-02-01", None, 8),
    ]
    df = stamps(
        spark, "2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-01 09:00:00",
        "2024-01-01 09:30:00", "2024-01-01 10:00:00", "2024-01-01 10:30:00", "2024-01-01 11:00:00",
        "2024-01-03 11:59:59", "2024-01-03 12:00:00", "2024-02-01 00:00:00", "2025-01-01 00:00:00",
    )
    out = [r["flag"] for r in flag_by_rules(df, rules).orderBy("n").collect()]
    assert out == [7, 0, 0, 1, 1, 2, 1, 1, 0, 0, 8]


def test_rules_can_name_a_series(spark):
    rules = [
        Rule("2024-01-01", "2024-01-03", 3, series="b"),
        Rule("2024-01-02", "2024-01-04", 1),
    ]
    rows = [(s, f"2024-01-0{d} 12:00:00") for s in "ab" for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "series string, t string").select(
        "series", F.col("t").cast("timestamp_ntz").alias("ts")
    )
    out = flag_by_rules(df, rules, series="series").orderBy("series", "ts").collect()
    assert [r["flag"] for r in out] == [0, 1, 1, 3, 3, 1]


def test_many_years_of_rules_use_wider_buckets(spark):
    rules = [Rule("1000-01-01", "3000-01-01", 5)]
    out = flag_by_rules(stamps(spark, "0999-12-31 00:00:00", "2024-05-05 05:05:05"), rules)
    assert [r["flag"] for r in out.orderBy("n").collect()] == [0, 5]


def test_rule_text(spark):
    rules = parse_rules("| 2024-09-06 | 3\n2024-09-18 13:00 | | 1", shift_days=-244)
    assert rules[0].start is None and rules[0].end.startswith("2024-01-06")
    assert rules[1].start.startswith("2024-01-18 13:00") and rules[1].end is None


def test_runs_break_on_value_only(series, spark):
    code = [1, 1, 0, 1, 2, 2, 0, 0]
    df = series({"code": code})
    gap = df.withColumn(
        "ts", F.when(F.col("n") >= 1, F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    )
    out = values(ordered.run_ids(gap, "code", KEYS, ORDER), "run_no", "run_id", "idx")
    assert out == [
        (1, 1, 1), (1, 1, 2), (2, 0, 3), (3, 2, 4), (4, 3, 5), (4, 3, 6), (5, 0, 7), (5, 0, 8)
    ]


def test_no_runs_at_all(series):
    df = series({"code": [0, 0, 0], "ch1": [1.0, 2.0, 3.0], "ch2": [1.0, 2.0, 3.0]})
    out = zeroing.anchored_baseline(df, "code", KEYS, ORDER, False, zeroing.Cutover())
    assert values(out, "ch1_zeroed") == [(None,)] * 3


@pytest.mark.parametrize(
    "known, expected, down, up",
    [
        ([None] * 4, [None] * 4, [None] * 4, [None] * 4),
        ([None, 5.0, None, None], [None, 5.0, None, None], [None, 5.0, 5.0, 5.0], [5.0, 5.0, None, None]),
        ([None, 2.0, None, 4.0, None], [None, 2.0, 3.0, 4.0, None], [None, 2.0, 3.0, 4.0, 4.0],
         [2.0, 2.0, 3.0, 4.0, None]),
    ],
)
def test_interpolation_edges(series, known, expected, down, up):
    df = series({"v": known})
    run = lambda **kw: [v for (v,) in values(ordered.interpolate_linear(df, ["v"], KEYS, ORDER, **kw), "v")]
    assert run() == expected
    assert run(extend={"v": "down"}) == down
    assert run(extend={"v": "up"}) == up


def test_interpolation_over_time_differs_from_rows(series):
    df = series({"v": [0.0, None, 10.0]})
    moved = df.withColumn(
        "ts", F.when(F.col("n") == 2, F.col("ts") + F.expr("INTERVAL 8 MINUTE")).otherwise(F.col("ts"))
    )
    by_row = values(ordered.interpolate_linear(moved, ["v"], KEYS, ORDER), "v")
    by_time = values(ordered.interpolate_linear(moved, ["v"], KEYS, ORDER, by="ts"), "v")
    assert by_row == [(0.0,), (5.0,), (10.0,)] and by_time == [(0.0,), (1.0,), (10.0,)]


def test_missing_series_key_is_refused(spark):
    df = stamps(spark, "2024-01-01").withColumn("series", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="series key series is NULL"):
        ordered.row_index(df, KEYS, ORDER).collect()


def test_cutovers_differ(series):
    # hourly rows from 09-15 12:00; anchors on 09-15 14:00 and, after the cut, 09-16 05:00
    n = 24
    anchor = [i in (2, 17) for i in range(n)]
    df = series(
        {
            "code": [int(a) for a in anchor],
            "ch1": [10.0 if i == 2 else 30.0 if i == 17 else 50.0 for i in range(n)],
            "ch2": [1.0] * n,
        },
        start="2024-09-15 12:00:00",
        step="1 hour",
    )
    out = values(
        zeroing.anchored_baseline(df, "code", KEYS, ORDER, False, zeroing.Cutover()), "ch1_baseline"
    )
    base = [v for (v,) in out]
    # "up" carries the first anchor back, but nothing extends it forward before midnight
    assert base[:3] == [10.0, 10.0, 10.0] and base[3:12] == [None] * 9
    # from midnight on the later line counts, NULL ahead of its first anchor at 05:00
    assert base[12:17] == [None] * 5 and base[17:] == [30.0] * 7


def test_daily_values_need_their_midnight_row(spark):
    hours = stamps(
        spark, "2024-01-01 00:00:00", "2024-01-01 05:00:00", "2024-01-02 01:00:00",
        "2024-01-03 00:00:00", "2024-01-03 02:00:00", "2024-01-04 00:00:00",
    )
    daily = spark.createDataFrame(
        [("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 2), 2.0), ("a", dt.date(2024, 1, 3), None)],
        "series string, date date, nitrate double",
    )
    out = budget.add_daily_nitrate(hours, daily, KEYS).orderBy("ts").collect()
    # 01-02 has no midnight row and 01-03 no value: both keep the value of 01-01
    assert [r["nitrate"] for r in out] == [1.0] * 6


@pytest.mark.parametrize("turned", [False, True])
def test_rows_at_one_time_carry_on_the_longest_lifetime(spark, turned):
    at = [dt.datetime(2024, 9, 10, 15), dt.datetime(2024, 9, 10, 15), dt.datetime(2024, 9, 10, 16)]
    rows = [("a", t, j, 1.0, 1.0, 20.0, 0.0) for t, j in zip(at, (0.5, 0.25, 0.1))]
    names = "series string, ts timestamp, jhono double, no_ppt double, hono_night double, temp double, oh_molecules_cm3 double"
    df = spark.createDataFrame(rows[::-1] if turned else rows, names).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = budget.budget_without_nitrate(df.coalesce(1), KEYS).orderBy("ts", "lifetime").collect()
    assert [r["lifetime"] for r in out] == [2.0, 4.0, 4.0]


def test_null_keys_match_and_fan_out(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), (None, 11), ("y", 12)], "k string, w int")
    left = {tuple(r) for r in joins.natural_left_join(a, b).collect()}
    assert left == {(None, 1, 10), (None, 1, 11), ("x", 2, None)}
    full = {tuple(r) for r in joins.natural_full_join(a, b).collect()}
    assert full == left | {("y", None, 12)}
    with pytest.raises(ValueError, match="share no column"):
        joins.natural_left_join(a, b.toDF("q", "w"))


def test_rows_rounding_to_one_time_are_all_kept(spark):
    night = stamps(spark, "2024-09-12 00:00:00", "2024-09-12 00:00:00").withColumn("hono_night", F.lit(1.0))
    za = stamps(spark, "2024-09-12 00:00:00", "2024-09-12 00:00:00").withColumn("hono_za", F.lit(2.0))
    out = calibration.combined_series(night.drop("n"), za.drop("n"), KEYS)
    assert out.count() == 4
    assert {r["local_pollution"] for r in out.collect()} == {"polluted"}


def test_chained_joins_suffix_repeated_names(spark):
    a = spark.createDataFrame([(1, 1.0)], "ts int, v double")
    b = spark.createDataFrame([(1, 2.0)], "ts int, v double")
    assert joins.left_join_chain([a, b], "ts").columns == ["ts", "v.x", "v.y"]


def test_standard_error_counts_missing_rows(series):
    df = series({"v": [1.0, 3.0, None, None]}).select("series", "v")
    row = stats.fanout_stats(df, KEYS).first()
    assert row["v_se"] == pytest.approx(2**0.5 / 2)


def test_bias_skips_pairs_above_but_only_missing_observations_below(spark):
    df = spark.createDataFrame([(3.0, 2.0), (None, 2.0), (5.0, None)], "m double, o double")
    assert df.agg(chem.normalised_mean_bias("m", "o")).first()[0] == pytest.approx(25.0)
    assert df.agg(chem.normalised_mean_bias("m", "o", na_rm=False)).first()[0] is None
    zero = spark.createDataFrame([(3.0, 0.0)], "m double, o double")
    assert zero.agg(chem.normalised_mean_bias("m", "o")).first()[0] is None


def test_zero_photolysis_gives_null(spark):
    df = stamps(spark, "2024-09-10 12:00:00").selectExpr(
        "series", "ts", "12 AS hour", "0D AS jhono", "2e6 AS oh_molecules_cm3", "1D AS no_ppt",
        "1D AS hono_night", "1D AS jhno3", "1D AS nitrate_molecules_cm3", "1D AS nitrate_nmol_m3",
    )
    row = budget.budget_with_nitrate(df).first()
    assert row["lifetime"] is None and row["f_calc"] is None
    assert row["f_fit_a"] == pytest.approx(385.7 / 1.19)


def test_wind_is_averaged_as_vectors(spark):
    df = stamps(spark, "2024-01-01 00:10:00", "2024-01-01 00:20:00").withColumn(
        "wd", F.when(F.col("n") == 0, 350.0).otherwise(20.0)
    )
    assert resample.time_average(df, "1 hour", KEYS, cols=["wd"]).first()["wd"] == pytest.approx(5.0)


def test_averages_drop_text_and_skip_gaps(series):
    df = series({"v": [None, None], "w": [1.0, None], "note": ["x", "y"]})
    row = resample.time_average(df.drop("n"), "1 hour", KEYS).first().asDict()
    assert row == {"series": "a", "ts": dt.datetime(2024, 9, 10), "v": None, "w": 1.0}


def test_step_response_threshold(series):
    signal = [0.5939, 0.58, 0.56, 0.537, 0.535, 0.53]
    df = series({"code": [1] * 6, "ch1": signal})
    row = zeroing.step_response(df, "code", "ch1", KEYS, ORDER).first()
    assert row["threshold"] == pytest.approx(0.5939 - 0.9 * 0.0639)
    assert row["seconds"] == 240.0
    fixed = zeroing.step_response(df, "code", "ch1", KEYS, ORDER, plateaus=(0.6, 0.5)).first()
    assert fixed["threshold"] == pytest.approx(0.51) and fixed["crossed_ts"] is None


def test_two_way_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    out = df.select(scalars.two_way(F.col("x") > 0, "yes", "no").alias("y")).collect()
    assert [r["y"] for r in out] == ["yes", None, "no"]
    first = df.select(scalars.first_match([(F.col("x") > 0, "yes")], "no").alias("y")).collect()
    assert [r["y"] for r in first] == ["yes", "no", "no"]


def test_split_leaves_the_cut_row_out(spark):
    df = stamps(spark, "2024-09-16 01:59:59", "2024-09-16 02:00:00", "2024-09-16 02:00:01")
    before, after = scalars.split_at(F.lit(1.0), "ts", "2024-09-16 02:00")
    out = df.select("n", before.alias("b"), after.alias("a")).orderBy("n").collect()
    assert [(r["b"], r["a"]) for r in out] == [(1.0, None), (None, None), (None, 1.0)]


def test_nan_never_enters(spark):
    df = spark.createDataFrame([(float("nan"), "NaN"), (1.0, "2")], "v double, t string")
    out = columns.to_double(columns.without_nan(df), ["t"])
    assert [tuple(r) for r in out.collect()] == [(None, None), (1.0, 2.0)]


@pytest.mark.parametrize(
    "text, layout, expected",
    [
        ("05.09.2024 17:45:00", "dmy_hms", "2024-09-05 17:45:00"),
        ("5/9/24 7:05", "dmy_hm", "2024-09-05 07:05:00"),
        ("2024-09-05T17:45:00.25Z", "ymd_hms", "2024-09-05 17:45:00.250000"),
        ("2024-09-05", "ymd", "2024-09-05 00:00:00"),
        ("9/5/2024 17:45", "mdy_hm", "2024-09-05 17:45:00"),
        ("31/02/2024 10:00", "dmy_hm", None),
        ("2024-09-05 17:45", "ymd_hms", None),
        ("", "ymd", None),
        (None, "ymd", None),
        ("hello", "ymd_hms", None),
    ],
)
def test_parse_datetime(spark, text, layout, expected):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(timefn.parse_datetime("t", layout).alias("p")).first()["p"]
    assert (None if got is None else str(got)) == expected


def test_ties_round_up(spark):
    df = stamps(spark, "2024-01-01 12:00:15", "2024-01-01 12:00:14.999999", "1969-12-31 23:59:45")
    out = df.select("n", timefn.round_time("ts", "30 seconds").alias("r")).orderBy("n").collect()
    assert [str(x["r"]) for x in out] == [
        "2024-01-01 12:00:30", "2024-01-01 12:00:00", "1970-01-01 00:00:00"
    ]
    shifted = df.select(timefn.shift_time("ts", -1351.2).alias("s")).first()["s"]
    assert str(shifted) == "2024-01-01 11:37:43.800000"


def test_names(spark):
    assert columns.snake_case(["TEMP_10M_degC", "O3 (ppb-v)", "North.Atlantic", "a", "A", "2x", "%"]) == [
        "temp_10m_deg_c", "o3_ppb_v", "north_atlantic", "a", "a_2", "x2x", "percent"
    ]
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert columns.span(df, "b", "d") == ["b", "c", "d"]
    assert columns.span(df, "d", "c") == ["d", "c"]


def test_long_forms_keep_nulls_and_pairs(spark):
    df = spark.createDataFrame([(1, 1.0, None, 3.0, 4.0)], "id int, mn double, fn double, mz double, fz double")
    assert reshape.unpivot(df, ["mn", "fn"], ["id"]).count() == 2
    paired = reshape.unpivot_paired(
        df, ["id"], {"Night": {"M": "mn", "F": "fn"}, "ZA": {"M": "mz", "F": "fz"}}
    )
    assert {tuple(r) for r in paired.collect()} == {
        (1, "Night", "M", 1.0), (1, "Night", "F", None), (1, "ZA", "M", 3.0), (1, "ZA", "F", 4.0)
    }


def test_constant_factors_begin_with_the_first_covered_hour(spark):
    rows = stamps(
        spark, "2024-09-09 02:00:00", "2024-09-09 14:55:00", "2024-09-09 15:50:00",
        "2024-09-09 20:00:00", "2024-09-11 02:00:00",
    ).withColumns(
        {
            "flag": F.lit(0),
            "ch1_zeroed": F.when(F.col("n") == 1, 0.1).otherwise(0.5),
            "ch2_zeroed": F.when(F.col("n") == 1, 0.1).otherwise(0.4),
        }
    )
    flow = spark.createDataFrame([("2024-09-09 15:10:00", 1000.0)], "t string, gas_flow double").select(
        F.col("t").cast("timestamp_ntz").alias("ts"), "gas_flow"
    )
    out = calibration.concentrations(rows, flow, campaign.REGIMES, KEYS).orderBy("n").collect()
    assert [r["n"] for r in out] == [0, 1, 2, 3, 4]
    assert [r["hono_constant"] is not None for r in out] == [False, False, True, True, False]
    assert [r["hono"] is not None for r in out] == [False, False, True, False, False]
    conc = 0.01 / 1000 * (5 / 26.55) / 1000 / 46 * 6.022e23 / (2.46e19 * 900) * 1e12
    assert out[2]["slope_ch1"] == pytest.approx(conc / 0.4)
    assert str(out[2]["ts"]) == "2024-09-09 15:27:30"


def test_fit_matches_the_textbook(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (4.0, 8.2)], "x double, y double")
    fit = stats.linear_fit(df, "x", "y").first()
    assert fit["slope"] == pytest.approx(2.04) and fit["intercept"] == pytest.approx(-0.05)
    # residuals 0.01, 0.07, -0.17, 0.09: RSS 0.042 on 2 degrees of freedom, Sxx 5
    assert fit["slope_se"] == pytest.approx((0.042 / 2 / 5) ** 0.5)
    two = stats.linear_fit(df.limit(2), "x", "y").first()
    assert two["n"] == 2 and two["slope_se"] is None


def test_box_plot_summary(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "i int, v double")
    df = df.withColumn("g", F.lit("a"))
    row = stats.five_number(df, "v", ["g"], "i").first()
    assert (row["q1"], row["median"], row["q3"]) == (2.0, 3.0, 4.0)
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (1.0, 4.0, 1)


def test_nitrate_union_and_full_join(spark):
    def frame(rows, ddl):
        return spark.createDataFrame(rows, ddl).withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    first = frame([("s", "2024-01-01 13:00:00", 1.0)], "site string, ts string, nitrate_mg_m double")
    second = frame([("s", "2024-01-05 13:00:00", 2.0)], "site string, ts string, nitrate double")
    sectors = frame([("s", "2024-01-02 01:00:00", 9.0), ("s", "2024-01-09 00:00:00", 8.0)],
                    "site string, ts string, `North.Atlantic` double")
    out = airmass.export_order(
        airmass.nitrate_with_airmass(first, second, sectors, ["site"]), ["site"]
    ).collect()
    assert [(str(r["ts"])[:10], r["nitrate"], r["north_atlantic"]) for r in out] == [
        ("2024-01-02", 1.0, 9.0), ("2024-01-05", 2.0, None), ("2024-01-09", None, 8.0)
    ]
