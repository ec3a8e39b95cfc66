"""Joins."""

from pyspark.sql import functions as F

from catalog.base import (
    BAD_NIGHTS,
    FLAGS,
    KEYS,
    ORDER,
    OVER,
    SIGNAL,
    ZERO_AIR,
    Tables,
    from_signal,
    night_case,
    query,
    r,
    rounded,
    rq,
    rule_case,
    with_,
)
from strandline.operators import joins
from strandline.operators.intervals import Rule, flag_by_rules, regime_of
from strandline.operators.ordered import fill_down
from strandline.operators.resample import time_average
from strandline.operators.runs import expand_runs, run_length_encode
from strandline.operators.stats import conditional_means, hour_climatology
from strandline.plans.zeroing import mark_nights


@query(
    "left_join_key",
    """SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders
       LEFT JOIN lineitem ON o_orderkey = l_orderkey""",
)
def left_join_key(t: Tables):
    orders = t.orders.select("o_orderkey", "o_custkey")
    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return joins.left_join(orders, items, "o_orderkey", null_safe=False)


_HALF_KEYS = """
  a AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS nationkey, c_custkey FROM customer),
  b AS (SELECT CASE WHEN n_regionkey > 0 THEN n_nationkey END AS nationkey, n_name FROM nation)"""


@query(
    "left_join_natural",
    with_(
        _HALF_KEYS,
        select="""SELECT a.nationkey, c_custkey, n_name
                  FROM a LEFT JOIN b ON a.nationkey IS NOT DISTINCT FROM b.nationkey""",
    ),
)
def left_join_natural(t: Tables):
    a = t.customer.select(
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("nationkey"), "c_custkey"
    )
    b = t.nation.select(
        F.when(F.col("n_regionkey") > 0, F.col("n_nationkey")).alias("nationkey"), "n_name"
    )
    return joins.natural_left_join(a, b)


def _hourly_sql(name: str, col: str, shift: int) -> str:
    return f"""{name} AS (SELECT date_trunc('hour', ts + INTERVAL ({shift}) HOUR) AS ts, avg({col}) AS {name}_{col},
                 avg(k) AS k FROM signal GROUP BY 1)"""


@query(
    "left_join_chain",
    with_(
        SIGNAL,
        _hourly_sql("a", "ch1", 0),
        _hourly_sql("b", "ch2", 30),
        _hourly_sql("c", "value", -50),
        select=f"""SELECT ts, {rq('a_ch1')} AS a_ch1, {rq('a.k')} AS "k.x", {rq('b_ch2')} AS b_ch2,
                          {rq('b.k')} AS "k.y", {rq('c_value')} AS c_value, {rq('c.k')} AS k
                   FROM a LEFT JOIN b USING (ts) LEFT JOIN c USING (ts)""",
    ),
)
def left_join_chain(t: Tables):
    """Three tables of hours, moved against each other so that each has hours the others lack."""

    def hourly(name: str, col: str, shift: int):
        moved = t.signal().withColumn("ts", F.col("ts") + F.make_dt_interval(hours=F.lit(shift)))
        return time_average(moved, "1 hour", cols=[col, "k"]).withColumnsRenamed({col: f"{name}_{col}"})

    out = joins.left_join_chain([hourly("a", "ch1", 0), hourly("b", "ch2", 30), hourly("c", "value", -50)], "ts")
    return out.select(
        "ts",
        *[r(F.col(f"`{c}`")).alias(c) for c in ("a_ch1", "k.x", "b_ch2", "k.y", "c_value", "k")],
    )


@query(
    "full_join_natural",
    with_(
        """a AS (SELECT date_trunc('month', o_orderdate) AS ts, o_orderstatus AS kind,
                        count(*) AS orders FROM orders GROUP BY ALL)""",
        """b AS (SELECT date_trunc('month', o_orderdate + INTERVAL 90 DAY) AS ts, o_orderstatus AS kind,
                        count(*) AS due FROM orders GROUP BY ALL)""",
        select="SELECT CAST(ts AS TIMESTAMP) AS ts, kind, orders, due FROM a FULL JOIN b USING (ts, kind)",
    ),
)
def full_join_natural(t: Tables):
    """Orders by month and status, against those due 90 days later; either side has months of its own."""

    def monthly(day, name: str):
        month = F.date_trunc("month", day).cast("timestamp_ntz").alias("ts")
        return t.orders.groupBy(month, F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias(name))

    return joins.natural_full_join(
        monthly(F.col("o_orderdate"), "orders"), monthly(F.col("o_orderdate") + F.expr("interval 90 days"), "due")
    )


@query(
    "broadcast_dim_join",
    from_signal(
        f"""SELECT event_id, CAST(hour AS INTEGER) AS hour, {rq('value - usual')} AS excess
            FROM (SELECT *, hour(ts) AS hour FROM signal)
            LEFT JOIN (SELECT hour(ts) AS hour, avg(value) AS usual FROM signal
                       WHERE hour(ts) BETWEEN 6 AND 19 GROUP BY 1) USING (hour)"""
    ),
)
def broadcast_dim_join(t: Tables):
    df = t.signal().withColumn("hour", F.hour("ts"))
    dim = hour_climatology(df.where(F.col("hour").between(6, 19)), ["value"]).withColumnsRenamed(
        {"value": "usual"}
    )
    out = joins.lookup_join(df, dim, "hour")
    return out.select("event_id", "hour", r(F.col("value") - F.col("usual")).alias("excess"))


@query(
    "row_index_join",
    from_signal(
        f"""SELECT series, idx, run_no AS id FROM (
              SELECT *, row_number() OVER {OVER} AS idx, CAST(sum(st) OVER {OVER} AS BIGINT) AS run_no
              FROM (SELECT *, CASE WHEN lag(code) OVER {OVER} IS DISTINCT FROM code
                                   THEN 1 ELSE 0 END AS st
                    FROM (SELECT *, {night_case()} AS code FROM signal)))
            WHERE code <> 0"""
    ),
)
def row_index_join(t: Tables):
    runs = run_length_encode(mark_nights(t.signal(), BAD_NIGHTS), "night_zero", KEYS, ORDER)
    return expand_runs(runs.where("value <> 0"), KEYS)


@query(
    "scalar_cross_join",
    from_signal(
        f"""SELECT event_id, {rq('ch1 / (hi - lo)')} AS scaled FROM signal,
            (SELECT avg(CASE WHEN ts > TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-12'
                             THEN value END) AS lo,
                    avg(CASE WHEN ts > TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-14'
                             THEN value END) AS hi FROM signal)"""
    ),
)
def scalar_cross_join(t: Tables):
    df = t.signal()
    cal = conditional_means(
        df,
        {"lo": ("2024-01-09", "2024-01-12"), "hi": ("2024-01-13", "2024-01-14")},
        ["value"],
    )
    scaled = joins.with_scalars(df, cal).withColumn(
        "scaled", F.col("ch1") / (F.col("hi_value") - F.col("lo_value"))
    )
    return scaled.select("event_id", r("scaled").alias("scaled"))


@query(
    "interval_flag_join",
    from_signal(
        f"""SELECT event_id, ts, {rule_case(FLAGS)} AS flag, {rule_case(ZERO_AIR)} AS zeroing
            FROM signal"""
    ),
)
def interval_flag_join(t: Tables):
    df = t.signal().select("event_id", "ts")
    return flag_by_rules(flag_by_rules(df, FLAGS, "flag"), ZERO_AIR, "zeroing")


@query(
    "interval_flag_table",
    with_(
        SIGNAL,
        """rules AS (SELECT event_id + CASE WHEN event_id % 50 < 2 THEN 1000000000 ELSE 0 END AS prio,
             CASE WHEN event_id % 7 > 0 THEN series END AS series, CASE WHEN event_id % 50 <> 0 THEN ts END AS "start",
             CASE WHEN event_id % 50 <> 1 THEN ts + to_minutes(CAST(k AS INTEGER)) END AS "end", 1 + event_id % 3 AS code
           FROM signal WHERE k > 95)""",
        select="""SELECT event_id, CAST(coalesce(arg_min(code, prio), 0) AS INTEGER) AS flag
                  FROM signal s LEFT JOIN rules r ON (r.series IS NULL OR r.series = s.series)
                    AND (r."start" IS NULL OR s.ts > r."start") AND (r."end" IS NULL OR s.ts < r."end")
                  GROUP BY event_id""",
    ),
)
def interval_flag_table(t: Tables):
    """Rules derived from the events themselves: own and general ones, some open at one side, overlapping."""
    sig = t.signal()
    i = F.col("event_id")
    rules = sig.where("k > 95").select(
        (i + F.when(i % 50 < 2, 1_000_000_000).otherwise(0)).alias("prio"),
        F.when(i % 7 > 0, F.col("series")).alias("series"),
        F.when(i % 50 != 0, F.col("ts")).alias("start"),
        F.when(i % 50 != 1, F.expr("ts + make_dt_interval(0, 0, int(k), 0)")).alias("end"),
        (1 + i % 3).alias("code"),
    )
    return flag_by_rules(sig.select("event_id", "series", "ts"), rules, series="series").select("event_id", "flag")


_REGIMES = [
    Rule(None, "1997-01-01", 0),
    Rule("1997-01-01", "1999-06-15", 1),
    Rule("1999-06-15", None, 2),
]


@query(
    "regime_join",
    f"""SELECT l_orderkey, l_linenumber, regime, {rq('l_quantity * factor')} AS scaled
        FROM (SELECT *, {rule_case(_REGIMES, 'NULL', 'l_shipdate')} AS regime FROM lineitem)
        JOIN (VALUES (0, 0.5e0), (1, 0.25e0), (2, 2e0)) f(regime, factor) USING (regime)""",
)
def regime_join(t: Tables):
    inside = regime_of(t.lineitem, _REGIMES, ts="l_shipdate")
    constants = t.spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 2.0)], "regime int, factor double")
    out = joins.lookup_join(inside, constants, "regime", "inner")
    return out.select(
        "l_orderkey", "l_linenumber", "regime",
        r(F.col("l_quantity") * F.col("factor")).alias("scaled"),
    )


@query(
    "daily_to_subdaily_asof",
    with_(
        SIGNAL,
        """h AS (SELECT series, date_trunc('hour', ts) AS ts, avg(value) AS v, avg(k) AS k
                 FROM signal GROUP BY ALL)""",
        """d AS (SELECT series, date_trunc('day', ts) AS ts, CASE WHEN avg(k) < 51 THEN avg(value) END AS nitrate
                 FROM signal GROUP BY ALL)""",
        select=f"""SELECT series, ts, {rq('v')} AS v, {rq('last_value(nitrate IGNORE NULLS) OVER '
                   '(PARTITION BY series ORDER BY ts)')} AS nitrate
                   FROM h LEFT JOIN d USING (series, ts)""",
    ),
)
def daily_to_subdaily_asof(t: Tables):
    sig = t.signal()
    hourly = time_average(sig, "1 hour", KEYS, cols=["value", "k"])
    daily = time_average(sig, "1 day", KEYS, cols=["value", "k"])
    daily = daily.select("series", "ts", F.when(F.col("k") < 51, F.col("value")).alias("nitrate"))
    joined = joins.left_join(hourly, daily, ["series", "ts"], null_safe=False)
    out = fill_down(joined, ["nitrate"], KEYS, ["ts"])
    return rounded(
        out.select("series", "ts", F.col("value").alias("v"), "nitrate"), "v", "nitrate"
    )


_ASOF = [
    SIGNAL,
    "h AS (SELECT series, date_trunc('hour', ts) AS ts, avg(value) AS v FROM signal GROUP BY ALL)",
    "d AS (SELECT series, min(ts) AS ts, avg(k) AS nitrate FROM signal GROUP BY series, date_trunc('day', ts))",
]


def _asof_sql(sign: str, gap: str) -> str:
    return with_(
        *_ASOF,
        select=f"""SELECT h.series, h.ts, {rq('v')} AS v,
                          CASE WHEN {gap} <= INTERVAL 20 HOUR THEN {rq('nitrate')} END AS nitrate,
                          CASE WHEN {gap} <= INTERVAL 20 HOUR THEN d.ts END AS measured
                   FROM h ASOF LEFT JOIN d ON h.series = d.series AND h.ts {sign} d.ts""",
    )


def _asof(t: Tables, direction: str):
    """Hours with the daily value measured last before them (first after them), at most 20 hours away; no day begins at midnight."""
    sig = t.signal()
    hourly = time_average(sig, "1 hour", KEYS, cols=["value"]).withColumnRenamed("value", "v")
    daily = sig.groupBy("series", F.to_date("ts").alias("day")).agg(F.min("ts").alias("ts"), F.avg("k").alias("nitrate"))
    out = joins.asof_join(hourly, daily, KEYS, ["nitrate"], direction=direction, tolerance_s=20 * 3600, matched="measured")
    return rounded(out, "v", "nitrate")


@query("asof_backward", _asof_sql(">=", "h.ts - d.ts"))
def asof_backward(t: Tables):
    return _asof(t, "backward")


@query("asof_forward", _asof_sql("<=", "d.ts - h.ts"))
def asof_forward(t: Tables):
    return _asof(t, "forward")
