"""Aggregations."""

from pyspark.sql import functions as F

from catalog.base import (
    BAD_NIGHTS,
    KEYS,
    ORDER,
    OVER,
    SIGNAL,
    Tables,
    from_signal,
    night_case,
    query,
    r,
    rounded,
    rq,
    rq_as,
    with_,
)
from strandline.functions import chem
from strandline.operators import stats
from strandline.operators.ordered import run_ids
from strandline.operators.runs import run_averages
from strandline.plans.zeroing import mark_nights


@query(
    "agg_global_mean",
    from_signal(
        f"""SELECT 'lenient' AS kind, {rq('avg(ch1)')} AS ch1, {rq('avg(value) / 997e0')} AS value
            FROM signal
            UNION ALL
            SELECT 'strict', CASE WHEN count(ch1) = count(*) THEN {rq('avg(ch1)')} END,
                   CASE WHEN count(value) = count(*) THEN {rq('avg(value) / 997e0')} END
            FROM signal"""
    ),
)
def agg_global_mean(t: Tables):
    df = t.signal().withColumn("value", F.col("value") / 997.0)
    lenient = stats.global_means(df, ["ch1", "value"])
    strict = stats.global_means(df, ["ch1", "value"], strict=True)
    both = lenient.select(F.lit("lenient").alias("kind"), "*").unionByName(
        strict.select(F.lit("strict").alias("kind"), "*")
    )
    return rounded(both, "ch1", "value")


@query(
    "agg_group_mean_sd",
    from_signal(
        f"""SELECT series, {rq('avg(ch1)')} AS ch1_mean, {rq('3 * stddev_samp(ch1)')} AS ch1_3sd,
                   {rq('avg(ch2)')} AS ch2_mean, {rq('3 * stddev_samp(ch2)')} AS ch2_3sd
            FROM signal GROUP BY series"""
    ),
)
def agg_group_mean_sd(t: Tables):
    out = stats.group_mean_sd(t.signal(), KEYS, ["ch1", "ch2"])
    return rounded(out, "ch1_mean", "ch1_3sd", "ch2_mean", "ch2_3sd")


_HOURLY_CODE = "series, date_trunc('hour', ts) AS ts"


@query(
    "agg_strict_mean",
    from_signal(
        f"""SELECT {_HOURLY_CODE}, CASE WHEN count(ch1) = count(*) THEN {rq('avg(ch1)')} END AS ch1,
                   CASE WHEN count(ch2) = count(*) THEN {rq('avg(ch2)')} END AS ch2
            FROM signal GROUP BY ALL"""
    ),
)
def agg_strict_mean(t: Tables):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    out = t.signal().groupBy("series", hour).agg(
        stats.mean_of("ch1", strict=True).alias("ch1"),
        stats.mean_of("ch2", strict=True).alias("ch2"),
    )
    return rounded(out, "ch1", "ch2")


@query(
    "agg_strict_sd",
    from_signal(
        f"""SELECT {_HOURLY_CODE},
                   CASE WHEN count(ch1) = count(*) THEN {rq('stddev_samp(ch1)')} END AS ch1_sd
            FROM signal GROUP BY ALL"""
    ),
)
def agg_strict_sd(t: Tables):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    out = t.signal().groupBy("series", hour).agg(stats.sd_of("ch1", strict=True).alias("ch1_sd"))
    return rounded(out, "ch1_sd")


_WINDOWS = {
    "zero": ("2024-01-09 14:53", "2024-01-11 15:05"),
    "cal": ("2024-01-13 15:47", "2024-01-14 16:04"),
}


def _cond(col: str, window: str) -> str:
    a, b = _WINDOWS[window]
    return f"avg(CASE WHEN ts > TIMESTAMP '{a}:00' AND ts < TIMESTAMP '{b}:00' THEN {col} END)"


@query(
    "agg_conditional_mean",
    from_signal(
        "SELECT series, "
        + ", ".join(
            f"{rq(_cond(c, w))} AS {w}_{c}" for w in _WINDOWS for c in ("ch1", "ch2")
        )
        + " FROM signal GROUP BY series"
    ),
)
def agg_conditional_mean(t: Tables):
    out = stats.conditional_means(t.signal(), _WINDOWS, ["ch1", "ch2"], KEYS)
    return rounded(out, "zero_ch1", "zero_ch2", "cal_ch1", "cal_ch2")


@query(
    "agg_hour_climatology",
    from_signal(
        f"""SELECT series, CAST(hour(ts) AS INTEGER) AS hour, {rq('avg(ch1)')} AS ch1,
                   {rq('avg(ch2)')} AS ch2 FROM signal GROUP BY ALL"""
    ),
)
def agg_hour_climatology(t: Tables):
    return rounded(stats.hour_climatology(t.signal(), ["ch1", "ch2"], KEYS), "ch1", "ch2")


def _fanout_sql(cols) -> str:
    parts = []
    for c in cols:
        parts += [
            f"{rq(f'avg({c})')} AS {c}_mean",
            f"{rq(f'stddev_samp({c})')} AS {c}_sd",
            f"{rq(f'stddev_samp({c}) / sqrt(count(*))')} AS {c}_se",
        ]
    return ", ".join(parts)


def _fanout_names(cols) -> list[str]:
    return [f"{c}_{s}" for c in cols for s in ("mean", "sd", "se")]


@query(
    "agg_fanout_stats",
    from_signal(f"SELECT series, {_fanout_sql(['ch1', 'ch2'])} FROM signal GROUP BY series"),
)
def agg_fanout_stats(t: Tables):
    df = t.signal().select("series", "ch1", "ch2")
    return rounded(stats.fanout_stats(df, KEYS), *_fanout_names(["ch1", "ch2"]))


@query(
    "fn_lambda_stats",
    f"SELECT l_returnflag, l_linestatus, {_fanout_sql(['l_discount', 'l_tax'])} "
    "FROM lineitem GROUP BY ALL",
)
def fn_lambda_stats(t: Tables):
    keys = ["l_returnflag", "l_linestatus"]
    df = t.lineitem.select(*keys, "l_discount", "l_tax")
    return rounded(stats.fanout_stats(df, keys), *_fanout_names(["l_discount", "l_tax"]))


_NMB = "100 * sum(ch2 - ch1) / nullif(sum(ch1), 0)"


@query(
    "agg_bias_nmb",
    from_signal(
        f"SELECT series, {rq(_NMB)} AS nmb FROM signal GROUP BY series"
    ),
)
def agg_bias_nmb(t: Tables):
    out = t.signal().groupBy("series").agg(chem.normalised_mean_bias("ch2", "ch1").alias("nmb"))
    return rounded(out, "nmb")


@query(
    "fn_nmb",
    from_signal(
        f"""SELECT series, date_trunc('day', ts) AS ts, {rq(_NMB)} AS lenient,
                   CASE WHEN count(ch2 - ch1) = count(*) THEN {rq(_NMB)} END AS strict
            FROM signal GROUP BY ALL"""
    ),
)
def fn_nmb(t: Tables):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")
    out = t.signal().groupBy("series", day).agg(
        chem.normalised_mean_bias("ch2", "ch1").alias("lenient"),
        chem.normalised_mean_bias("ch2", "ch1", na_rm=False).alias("strict"),
    )
    return rounded(out, "lenient", "strict")


def fit_sql(x: str, y: str, keys: str, source: str) -> str:
    return f"""SELECT {keys}, n, {rq_as('slope', 'intercept', 'r2', 'residual_se', 'slope_se')},
        {rq('intercept_se')} AS intercept_se, {rq('slope / slope_se')} AS slope_t,
        {rq('intercept / intercept_se')} AS intercept_t
      FROM (SELECT *, residual_se / sqrt(sxx) AS slope_se,
                   residual_se * sqrt(1e0 / n + mx * mx / sxx) AS intercept_se
            FROM (SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) AS residual_se
                  FROM (SELECT {keys}, CAST(regr_count({y}, {x}) AS BIGINT) AS n,
                               regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept,
                               regr_r2({y}, {x}) AS r2, regr_sxx({y}, {x}) AS sxx,
                               regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy,
                               regr_avgx({y}, {x}) AS mx
                        FROM {source} GROUP BY {keys})))"""


FIT_COLS = ["slope", "intercept", "r2", "residual_se", "slope_se", "intercept_se"]
FIT_COLS += ["slope_t", "intercept_t"]


@query("agg_linear_fit", from_signal(fit_sql("ch1", "ch2", "series", "signal")))
def agg_linear_fit(t: Tables):
    return rounded(stats.linear_fit(t.signal(), "ch1", "ch2", KEYS), *FIT_COLS)


def five_number_ctes(source: str, value: str, key: str) -> list[str]:
    return [
        f"""q AS (SELECT {key}, count({value}) AS n, quantile_cont({value}, 0.25) AS q1,
              quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3
              FROM {source} GROUP BY {key})""",
        f"""b AS (SELECT {key}, min(CASE WHEN inside THEN {value} END) AS whisker_low,
              max(CASE WHEN inside THEN {value} END) AS whisker_high,
              count(CASE WHEN NOT inside THEN 1 END) AS outliers
              FROM (SELECT {key}, {value}, {value} BETWEEN q1 - 1.5 * (q3 - q1)
                           AND q3 + 1.5 * (q3 - q1) AS inside FROM {source} JOIN q USING ({key}))
              GROUP BY {key})""",
    ]


FIVE = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query(
    "agg_five_number",
    with_(
        SIGNAL,
        *five_number_ctes("signal", "ch1", "series"),
        select=f"SELECT series, n, {rq_as(*FIVE)}, outliers FROM q JOIN b USING (series)",
    ),
)
def agg_five_number(t: Tables):
    return rounded(stats.five_number(t.signal(), "ch1", KEYS, "event_id"), *FIVE)


_RUN_SD = f"""
  runs AS (SELECT series, run_id, 3 * stddev_samp(ch1) AS s1, 3 * stddev_samp(ch2) AS s2
           FROM (SELECT *, sum(CASE WHEN st = 1 AND code <> 0 THEN 1 ELSE 0 END) OVER {OVER} AS run_id
                 FROM (SELECT *, CASE WHEN lag(code) OVER {OVER} IS DISTINCT FROM code
                                      THEN 1 ELSE 0 END AS st
                       FROM (SELECT *, {night_case()} AS code FROM signal)))
           WHERE code <> 0 GROUP BY series, run_id)"""
_LOD = "sqrt(pow(s1 * 3.5e0, 2) + pow(s2 * 4.5e0, 2))"


@query(
    "agg_limit_of_detection",
    with_(
        SIGNAL,
        _RUN_SD,
        select=f"SELECT series, CAST(run_id AS BIGINT) AS run_id, {rq(_LOD)} AS lod FROM runs",
    ),
)
def agg_limit_of_detection(t: Tables):
    numbered = run_ids(mark_nights(t.signal(), BAD_NIGHTS), "night_zero", KEYS, ORDER)
    runs = run_averages(numbered, ["ch1", "ch2"], KEYS)
    lod = chem.detection_limit("ch1_zero_3sd", "ch2_zero_3sd", F.lit(3.5), F.lit(4.5))
    return runs.select("series", "run_id", r(lod).alias("lod"))


@query(
    "fn_lod",
    f"""SELECT l_orderkey, l_linenumber,
               {rq('sqrt(pow(l_discount * l_quantity, 2) + pow(l_tax * l_quantity, 2))')} AS lod
        FROM lineitem""",
)
def fn_lod(t: Tables):
    lod = chem.detection_limit("l_discount", "l_tax", "l_quantity", "l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", r(lod).alias("lod"))


@query(
    "fn_ppt",
    from_signal(
        f"""SELECT event_id,
                   {rq('ch1 / (0.5 + k / 200e0) - (ch2 - ch1 * (1 - (0.5 + k / 200e0)))')} AS ppt
            FROM signal"""
    ),
)
def fn_ppt(t: Tables):
    efficiency = 0.5 + F.col("k") / 200.0
    return t.signal().select(
        "event_id", r(chem.two_channel_ppt("ch1", "ch2", efficiency)).alias("ppt")
    )


@query(
    "fn_unit",
    from_signal(
        f"""SELECT event_id, {rq('ch1 * 2.46e7 / 1e6')} AS molecules_1e6, {rq('ch1')} AS ppt
            FROM signal"""
    ),
)
def fn_unit(t: Tables):
    molecules = chem.ppt_to_molecules("ch1")
    return t.signal().select(
        "event_id",
        r(molecules / 1e6).alias("molecules_1e6"),
        r(chem.molecules_to_ppt(molecules)).alias("ppt"),
    )
