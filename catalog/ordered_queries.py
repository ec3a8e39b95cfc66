"""Operators on row order."""

from pyspark.sql import functions as F

from catalog.base import (
    BAD_NIGHTS,
    KEYS,
    ORDER,
    OVER,
    SIGNAL,
    ZERO_AIR,
    Tables,
    from_signal,
    night_case,
    query,
    rounded,
    rq,
    rq_as,
    rule_case,
    with_,
)
from strandline.functions.scalars import split_at
from strandline.operators import ordered
from strandline.operators.intervals import Rule, flag_by_rules, regime_of
from strandline.operators.runs import expand_runs, midpoint_anchors, run_length_encode
from strandline.operators.stats import impute_group_mean
from strandline.plans.zeroing import mark_nights

RUNNING = "(PARTITION BY series ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
AHEAD = (
    "(PARTITION BY series ORDER BY ts, event_id "
    "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
)


def runs_cte(name: str, source: str, code: str) -> str:
    """Rows of ``source`` with row number, run number and dense event-run id."""
    return f"""{name} AS (
      SELECT * EXCLUDE (st), CAST(sum(st) OVER {OVER} AS BIGINT) AS run_no,
             CASE WHEN code <> 0 THEN CAST(sum(CASE WHEN st = 1 AND code <> 0 THEN 1 ELSE 0 END)
                  OVER {OVER} AS BIGINT) ELSE 0 END AS run_id
      FROM (SELECT *, row_number() OVER {OVER} AS idx,
                   CASE WHEN lag(code) OVER {OVER} IS DISTINCT FROM code THEN 1 ELSE 0 END AS st
            FROM (SELECT *, {code} AS code FROM {source})))"""


def anchors_cte(name: str, runs: str, strict: bool) -> str:
    def whole(c: str, x: str) -> str:
        return f"CASE WHEN count({c}) = count(*) THEN {x} END" if strict else x

    means = ", ".join(
        f"{whole(c, f'avg({c})')} AS {c}_zeroes, "
        f"{whole(c, f'3 * stddev_samp({c})')} AS {c}_zero_3sd"
        for c in ("ch1", "ch2")
    )
    return f"""{name} AS (
      SELECT * FROM {runs} LEFT JOIN (
        SELECT series, CAST(round_even(avg(idx), 0) AS BIGINT) AS idx, {means}
        FROM {runs} WHERE run_id <> 0 GROUP BY series, run_id) USING (series, idx))"""


def line(col: str, extend: str | None = None, x: str = "idx") -> str:
    """Line through the known values of ``col`` over ``x`` (needs row order columns)."""
    known = f"CASE WHEN {col} IS NOT NULL THEN {x} END"
    x0 = f"last_value({known} IGNORE NULLS) OVER {RUNNING}"
    v0 = f"last_value({col} IGNORE NULLS) OVER {RUNNING}"
    x1 = f"first_value({known} IGNORE NULLS) OVER {AHEAD}"
    v1 = f"first_value({col} IGNORE NULLS) OVER {AHEAD}"
    ext = {None: "", "down": f", {v0}", "up": f", {v1}"}[extend]
    return f"coalesce({col}, {v0} + ({v1} - {v0}) / nullif({x1} - {x0}, 0) * ({x} - {x0}){ext})"


@query("row_index", from_signal(f"SELECT event_id, series, row_number() OVER {OVER} AS idx FROM signal"))
def row_index(t: Tables):
    df = t.signal().select("series", "ts", "event_id")
    return ordered.row_index(df, KEYS, ORDER).select("event_id", "series", "idx")


_RLE = """SELECT series, run_no, min(code) AS value, count(*) AS length, min(idx) AS idx_start,
                 max(idx) AS idx_end, min(ts) AS start_ts, max(ts) AS end_ts
          FROM runs GROUP BY series, run_no"""


@query(
    "run_length_encode", with_(SIGNAL, runs_cte("runs", "signal", rule_case(ZERO_AIR)), select=_RLE)
)
def run_length_encode_(t: Tables):
    coded = flag_by_rules(t.signal().select("series", "ts", "event_id"), ZERO_AIR, "code")
    return run_length_encode(coded, "code", KEYS, ORDER)


@query("fn_rle", with_(SIGNAL, runs_cte("runs", "signal", "CAST(k >= 50 AS INTEGER)"), select=_RLE))
def fn_rle(t: Tables):
    coded = t.signal().select(
        "series", "ts", "event_id", (F.col("k") >= 50).cast("int").alias("code")
    )
    return run_length_encode(coded, "code", KEYS, ORDER)


@query(
    "fn_expand_runs",
    with_(
        SIGNAL,
        runs_cte("runs", "signal", "CAST(k >= 50 AS INTEGER)"),
        select="SELECT series, idx, run_no AS id FROM runs",
    ),
)
def fn_expand_runs(t: Tables):
    return expand_runs(fn_rle(t), KEYS)


@query(
    "run_ids",
    with_(
        SIGNAL,
        runs_cte("runs", "signal", rule_case(ZERO_AIR)),
        select="SELECT event_id, series, code, idx, run_no, run_id FROM runs",
    ),
)
def run_ids(t: Tables):
    coded = flag_by_rules(t.signal().select("series", "ts", "event_id"), ZERO_AIR, "code")
    return ordered.run_ids(coded, "code", KEYS, ORDER).select(
        "event_id", "series", "code", "idx", "run_no", "run_id"
    )


@query(
    "cumulative_sum",
    from_signal(
        f"SELECT event_id, series, {rq(f'sum(ch1) OVER {RUNNING}')} AS total FROM signal"
    ),
)
def cumulative_sum(t: Tables):
    df = t.signal().select("series", "ts", "event_id", "ch1")
    out = ordered.cumulative_sum(df, "ch1", KEYS, ORDER, "total")
    return rounded(out.select("event_id", "series", "total"), "total")


@query(
    "run_midpoint_anchor",
    with_(
        SIGNAL,
        runs_cte("runs", "signal", night_case()),
        anchors_cte("anchored", "runs", False),
        select="SELECT event_id, series, idx, run_id, "
        + rq_as("ch1_zeroes", "ch2_zeroes", "ch1_zero_3sd", "ch2_zero_3sd")
        + " FROM anchored",
    ),
)
def run_midpoint_anchor(t: Tables):
    nights = mark_nights(t.signal(), BAD_NIGHTS)
    out = midpoint_anchors(
        ordered.run_ids(nights, "night_zero", KEYS, ORDER), ["ch1", "ch2"], KEYS
    )
    cols = ["ch1_zeroes", "ch2_zeroes", "ch1_zero_3sd", "ch2_zero_3sd"]
    return rounded(out.select("event_id", "series", "idx", "run_id", *cols), *cols)


@query(
    "interpolate_linear",
    from_signal(
        f"""SELECT event_id, series, {rq(line('v1'))} AS v1, {rq(line('v2'))} AS v2
            FROM (SELECT *, row_number() OVER {OVER} AS idx,
                         CASE WHEN k > 90 THEN ch1 END AS v1, CASE WHEN k < 5 THEN ch2 END AS v2
                  FROM signal)"""
    ),
)
def interpolate_linear(t: Tables):
    sparse = t.signal().select(
        "series",
        "ts",
        "event_id",
        F.when(F.col("k") > 90, F.col("ch1")).alias("v1"),
        F.when(F.col("k") < 5, F.col("ch2")).alias("v2"),
    )
    out = ordered.interpolate_linear(sparse, ["v1", "v2"], KEYS, ORDER)
    return rounded(out.select("event_id", "series", "v1", "v2"), "v1", "v2")


_AT = "PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN"
_BACK, _AHEAD = f"({_AT} UNBOUNDED PRECEDING AND CURRENT ROW)", f"({_AT} CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    "interpolate_over_time",
    from_signal(
        f"""SELECT event_id, series,
                   {rq('coalesce(v, pv + (nv - pv) / nullif(nx - px, 0) * (x - px))')} AS v
            FROM (SELECT *, last_value(v IGNORE NULLS) OVER {_BACK} AS pv,
                         first_value(v IGNORE NULLS) OVER {_AHEAD} AS nv,
                         last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER {_BACK} AS px,
                         first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER {_AHEAD} AS nx
                  FROM (SELECT *, CASE WHEN k > 80 THEN ch1 END AS v, epoch_us(ts) AS x FROM signal))"""
    ),
)
def interpolate_over_time(t: Tables):
    known = F.when(F.col("k") > 80, F.col("ch1"))
    sparse = t.signal().select("series", "ts", "event_id", known.alias("v"))
    out = ordered.interpolate_linear(sparse, ["v"], KEYS, ORDER, by="ts")
    return rounded(out.select("event_id", "series", "v"), "v")


_CUT = "2024-01-16 02:00"


@query(
    "interpolate_by_regime",
    from_signal(
        f"""SELECT event_id, series, {rq(line('a', 'up'))} AS early, {rq(line('b', 'down'))} AS late,
                   {rq(f"CASE WHEN ts < TIMESTAMP '2024-01-16' THEN {line('a', 'up')} ELSE "
                       f"{line('b', 'down')} END")} AS baseline
            FROM (SELECT *, row_number() OVER {OVER} AS idx,
                         CASE WHEN ts < TIMESTAMP '{_CUT}' AND k > 80 THEN ch1 END AS a,
                         CASE WHEN ts > TIMESTAMP '{_CUT}' AND k > 80 THEN ch1 END AS b
                  FROM signal)"""
    ),
)
def interpolate_by_regime(t: Tables):
    known = F.when(F.col("k") > 80, F.col("ch1"))
    early, late = split_at(known, "ts", _CUT)
    df = t.signal().select("series", "ts", "event_id", early.alias("early"), late.alias("late"))
    out = ordered.interpolate_linear(
        df, ["early", "late"], KEYS, ORDER, extend={"early": "up", "late": "down"}
    )
    before = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    out = out.withColumn("baseline", F.when(before, F.col("early")).otherwise(F.col("late")))
    return rounded(
        out.select("event_id", "series", "early", "late", "baseline"), "early", "late", "baseline"
    )


@query(
    "fill_down",
    from_signal(
        f"""SELECT event_id, series, {rq(f'last_value(ch1 IGNORE NULLS) OVER {RUNNING}')} AS ch1,
                   {rq(f'last_value(ch2 IGNORE NULLS) OVER {RUNNING}')} AS ch2 FROM signal"""
    ),
)
def fill_down(t: Tables):
    df = t.signal().select("series", "ts", "event_id", "ch1", "ch2")
    out = ordered.fill_down(df, ["ch1", "ch2"], KEYS, ORDER)
    return rounded(out.select("event_id", "series", "ch1", "ch2"), "ch1", "ch2")


@query(
    "fill_up",
    from_signal(
        f"""SELECT event_id, series, {rq(f'first_value(ch1 IGNORE NULLS) OVER {AHEAD}')} AS ch1,
                   {rq(f'first_value(ch2 IGNORE NULLS) OVER {AHEAD}')} AS ch2 FROM signal"""
    ),
)
def fill_up(t: Tables):
    df = t.signal().select("series", "ts", "event_id", "ch1", "ch2")
    out = ordered.fill_up(df, ["ch1", "ch2"], KEYS, ORDER)
    return rounded(out.select("event_id", "series", "ch1", "ch2"), "ch1", "ch2")


_REGIMES = [
    Rule(None, "2024-01-11", 0),
    Rule("2024-01-11", "2024-01-14 08:17", 1),
    Rule("2024-01-14 08:17", None, 2),
]


@query(
    "fill_within_regime",
    from_signal(
        f"""SELECT event_id, series, regime,
                   {rq('''last_value(v IGNORE NULLS) OVER (PARTITION BY series, regime
                          ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)''')} AS v
            FROM (SELECT *, {rule_case(_REGIMES, 'NULL')} AS regime,
                         CASE WHEN hour(ts) BETWEEN 6 AND 19 THEN ch1 END AS v FROM signal)
            WHERE regime IS NOT NULL"""
    ),
)
def fill_within_regime(t: Tables):
    df = t.signal().select(
        "series", "ts", "event_id",
        F.when(F.hour("ts").between(6, 19), F.col("ch1")).alias("v"),
    )
    out = ordered.fill_down(regime_of(df, _REGIMES), ["v"], ["series", "regime"], ORDER)
    return rounded(out.select("event_id", "series", "regime", "v"), "v")


@query(
    "impute_group_mean",
    from_signal(
        "SELECT event_id, series, "
        + ", ".join(
            f"{rq(f'coalesce({c}, avg({c}) OVER (PARTITION BY series, hour(ts)))')} AS {c}"
            for c in ("ch1", "ch2")
        )
        + " FROM signal"
    ),
)
def impute_group_mean_(t: Tables):
    out = impute_group_mean(t.signal(), ["ch1", "ch2"], KEYS)
    return rounded(out.select("event_id", "series", "ch1", "ch2"), "ch1", "ch2")
