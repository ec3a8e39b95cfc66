"""Resampling, long forms and sorted outputs."""

from pyspark.sql import functions as F

from catalog.base import (
    KEYS,
    SIGNAL,
    Tables,
    from_signal,
    query,
    rounded,
    rq,
    with_,
)
from strandline.operators import reshape, resample


def _bucket(width_s: int) -> str:
    us = width_s * 1_000_000
    return f"make_timestamp((epoch_us(ts) // {us}) * {us})"


@query(
    "time_average",
    from_signal(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS every, series, {_bucket(w)} AS ts, {rq('avg(ch1)')} AS ch1,
                       {rq('avg(ch2)')} AS ch2 FROM signal GROUP BY ALL"""
            for name, w in (("30 sec", 30), ("15 min", 900), ("1 hour", 3600), ("1 day", 86400))
        )
    ),
)
def time_average(t: Tables):
    df = t.signal().select("series", "ts", "ch1", "ch2", F.lit("text").alias("note"))
    parts = [
        resample.time_average(df, e, KEYS).select(F.lit(e).alias("every"), "*")
        for e in ("30 sec", "15 min", "1 hour", "1 day")
    ]
    return rounded(reshape.union_by_name(*parts), "ch1", "ch2")


_WD = "k * 3.6e0"


@query(
    "time_average_vector_wind",
    from_signal(
        f"""SELECT series, date_trunc('hour', ts) AS ts, {rq('avg(ch1)')} AS ch1,
                        round((degrees(atan2(avg(sin(radians({_WD}))), avg(cos(radians({_WD})))))
                               + 360) % 360, 5) AS wd
                 FROM signal GROUP BY ALL"""
    ),
)
def time_average_vector_wind(t: Tables):
    df = t.signal().select("series", "ts", "ch1", (F.col("k") * 3.6).alias("wd"))
    out = rounded(resample.time_average(df, "1 hour", KEYS), "ch1")
    return rounded(out, "wd", digits=5)


_PROFILE = """SELECT series, CAST(hour(ts) AS INTEGER) AS hour, '{c}' AS variable, {m} AS mean,
  {lo} AS lower, {hi} AS upper, count({c}) AS n FROM signal GROUP BY ALL"""


def _profile(c: str) -> str:
    half = f"1.96e0 * stddev_samp({c}) / sqrt(count({c}))"
    return _PROFILE.format(
        c=c, m=rq(f"avg({c})"), lo=rq(f"avg({c}) - {half}"), hi=rq(f"avg({c}) + {half}")
    )


@query("diurnal_profile", from_signal(f"{_profile('ch1')} UNION ALL {_profile('ch2')}"))
def diurnal_profile(t: Tables):
    return rounded(
        resample.diurnal_profile(t.signal(), ["ch1", "ch2"], KEYS), "mean", "lower", "upper"
    )


_WEIGHT = " + ".join(f"(u >= '{t}')::INT" for t in resample.POISSON)


@query(
    "diurnal_bootstrap",
    with_(
        SIGNAL,
        f"""drawn AS (SELECT series, hour, b, v, {_WEIGHT} AS w FROM (
              SELECT series, CAST(hour(ts) AS INTEGER) AS hour, ch1 AS v, b, substr(md5('7:' || event_id || ':' || b), 1, 8) AS u
              FROM signal, range(50) AS r(b) WHERE ch1 IS NOT NULL))""",
        """means AS (SELECT series, hour, b, sum(w * v) / nullif(sum(w), 0) AS m, avg(v) AS mean, count(*) AS n
                     FROM drawn GROUP BY ALL)""",
        select=f"""SELECT series, hour, {rq('max(mean) FILTER (b = 0)')} AS mean, {rq('quantile_cont(m, 0.025)')} AS lower,
                          {rq('quantile_cont(m, 0.975)')} AS upper, max(n) AS n FROM means GROUP BY ALL""",
    ),
)
def diurnal_bootstrap(t: Tables):
    out = resample.diurnal_bootstrap(t.signal(), "ch1", "event_id", KEYS, replicates=50, seed=7)
    return rounded(out, "mean", "lower", "upper")


@query("sort_time", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id")
def sort_time(t: Tables):
    return reshape.sort_time(t.events.select("event_id", "ts", "value"), "ts", "event_id")


@query(
    "last_rows",
    "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 6",
)
def last_rows(t: Tables):
    return reshape.last_rows(t.events.select("event_id", "ts", "value"), ["ts", "event_id"])


@query(
    "union_by_name",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment,
              NULL AS nation FROM customer
       UNION ALL
       SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier""",
)
def union_by_name(t: Tables):
    a = t.customer.selectExpr(
        "c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    b = t.supplier.selectExpr(
        "s_acctbal AS balance", "s_suppkey AS id", "s_name AS name", "s_nationkey AS nation"
    )
    return reshape.union_by_name(a, b)


@query(
    "unpivot_columns",
    from_signal(
        " UNION ALL ".join(
            f"SELECT event_id, '{c}' AS name, {rq(c)} AS value FROM signal" for c in ("ch1", "ch2")
        )
    ),
)
def unpivot_columns(t: Tables):
    df = t.signal().select("event_id", "ch1", "ch2")
    return rounded(reshape.unpivot(df, ["ch1", "ch2"]), "value")


_PAIRS = {
    "Night": {"Price": "l_extendedprice", "Amount": "l_quantity"},
    "ZA": {"Price": "l_discount", "Amount": "l_tax"},
}


@query(
    "unpivot_paired",
    " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, '{v}' AS name, '{q}' AS quantity, {c} AS value FROM lineitem"
        for v, cols in _PAIRS.items()
        for q, c in cols.items()
    ),
)
def unpivot_paired(t: Tables):
    return reshape.unpivot_paired(t.lineitem, ["l_orderkey", "l_linenumber"], _PAIRS)
