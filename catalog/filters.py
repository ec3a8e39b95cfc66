"""Row filters."""

from pyspark.sql import functions as F

from catalog.base import FLAGS, KEYS, ORDER, OVER, Tables, from_signal, query, rule_case
from strandline.functions import scalars, timefn
from strandline.operators.intervals import flag_by_rules
from strandline.operators.runs import event_runs, run_length_encode

_EVENTS = "SELECT event_id, ts, value FROM events WHERE "


def _events(t: Tables):
    return t.events.select("event_id", "ts", "value")


@query(
    "filter_time_open",
    _EVENTS + "ts > TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-19 06:30:00'",
)
def filter_time_open(t: Tables):
    return _events(t).where(timefn.between_open("ts", "2024-01-08", "2024-01-19 06:30"))


@query(
    "filter_time_halfopen",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1997-03-01'""",
)
def filter_time_halfopen(t: Tables):
    return t.orders.select("o_orderkey", "o_orderdate").where(
        timefn.between_halfopen("o_orderdate", "1996-03-01", "1997-03-01")
    )


@query(
    "filter_time_closed",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1997-03-01'""",
)
def filter_time_closed(t: Tables):
    return t.orders.select("o_orderkey", "o_orderdate").where(
        timefn.between_closed("o_orderdate", "1996-03-01", "1997-03-01")
    )


@query(
    "filter_time_one_sided",
    """SELECT 'before' AS side, event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-11'
       UNION ALL
       SELECT 'after', event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-14 08:17:00'""",
)
def filter_time_one_sided(t: Tables):
    cols = ["event_id", "ts"]
    before = t.events.where(timefn.between_open("ts", end="2024-01-11"))
    after = t.events.where(timefn.between_open("ts", start="2024-01-14 08:17"))
    return before.select(F.lit("before").alias("side"), *cols).unionByName(
        after.select(F.lit("after").alias("side"), *cols)
    )


@query(
    "filter_category",
    """SELECT o_orderkey, o_orderpriority FROM orders
       WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""",
)
def filter_category(t: Tables):
    return t.orders.where(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    ).select("o_orderkey", "o_orderpriority")


@query("filter_hour_of_day", _EVENTS + "hour(ts) BETWEEN 11 AND 15")
def filter_hour_of_day(t: Tables):
    return _events(t).where(scalars.in_range(timefn.extract_hour("ts"), 11, 15))


@query("filter_not_null", from_signal("SELECT event_id, ch1 FROM signal WHERE ch1 IS NOT NULL"))
def filter_not_null(t: Tables):
    return t.signal().where(F.col("ch1").isNotNull()).select("event_id", "ch1")


@query(
    "filter_nonzero_run",
    from_signal(
        f"""SELECT series, count(*) AS length, min(ts) AS start_ts, max(ts) AS end_ts,
                   min(flag) AS value
            FROM (SELECT *, sum(st) OVER {OVER} AS run_no
                  FROM (SELECT *, CASE WHEN lag(flag) OVER {OVER} IS DISTINCT FROM flag
                                       THEN 1 ELSE 0 END AS st
                        FROM (SELECT *, {rule_case(FLAGS)} AS flag FROM signal)))
            GROUP BY series, run_no HAVING min(flag) <> 0"""
    ),
)
def filter_nonzero_run(t: Tables):
    runs = run_length_encode(flag_by_rules(t.signal(), FLAGS), "flag", KEYS, ORDER)
    return event_runs(runs).select("series", "length", "start_ts", "end_ts", "value")
