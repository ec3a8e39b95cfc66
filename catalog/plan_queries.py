"""Composed plans: zeroing, calibration, merging, budgets, flow and air masses.

Hourly site tables are derived from the event stream, each with its own hours
missing, so that left joins, carried values and gaps all come up.
"""

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.agg_queries import FIT_COLS, FIVE, fit_sql, five_number_ctes
from catalog.base import (
    BAD_NIGHTS,
    FLAGS,
    KEYS,
    ORDER,
    SIGNAL,
    ZERO_AIR,
    Tables,
    night_case,
    query,
    r,
    rounded,
    rq,
    rq_as,
    rule_case,
    with_,
)
from catalog.ordered_queries import anchors_cte, line, runs_cte
from strandline.functions.timefn import between_open
from strandline.operators.columns import clean_names
from strandline.operators.intervals import flag_by_rules
from strandline.operators.ordered import sequence
from strandline.operators.resample import time_average
from strandline.plans import (
    airmass,
    budget,
    calibration,
    comparison,
    flow,
    pairs,
    series,
    zeroing,
)
from strandline.plans.campaign import Regime
from strandline.session import fresh_path
from strandline.sources import files

CUT = zeroing.Cutover("2024-01-16 02:00", "2024-01-16")
SQL_CUT = "TIMESTAMP '2024-01-16 02:00:00'"
SQL_BASE = "TIMESTAMP '2024-01-16'"

# Regimes of the test stream, with windows long enough for every series.
REGIMES = [
    Regime(0, None, "2024-01-11", "2024-01-06", "2024-01-07 12:00", "2024-01-09 14:40",
           "2024-01-10 20:00", 5 / 26.55, 5 / 27.48),
    Regime(1, "2024-01-11", "2024-01-14 08:17", "2024-01-11 14:45", "2024-01-12 12:00",
           "2024-01-12 15:10", "2024-01-14 06:30", 5 / 26.55, 5 / 27.48),
    Regime(2, "2024-01-14 08:17", None, "2024-01-17", "2024-01-20", "2024-01-20",
           "2024-01-25", 5 / 27.73, 5 / 29.73),
]
REGIME_RULES = calibration.campaign.regime_rules(REGIMES)


def flagged(t: Tables):
    return flag_by_rules(raw(t), FLAGS)


def night(t: Tables):
    return zeroing.night_zero(flagged(t), KEYS, ORDER, BAD_NIGHTS, CUT)


def zero_air(t: Tables):
    return zeroing.zero_air_zero(flagged(t), KEYS, ORDER, ZERO_AIR, CUT)


FLAGGED = f"""flagged AS (
  SELECT series, ts, event_id, ch1, ch2, {rule_case(FLAGS)} AS flag FROM signal)"""


def zero_ctes(p: str, mask: str, code: str, strict: bool) -> list[str]:
    """Rows with anchors, both lines, baseline and zeroed channels, as ``<p>``."""
    halves = ", ".join(
        f"CASE WHEN ts < {SQL_CUT} THEN {c}_zeroes END AS {c}_a, "
        f"CASE WHEN ts > {SQL_CUT} THEN {c}_zeroes END AS {c}_b"
        for c in ("ch1", "ch2")
    )
    lines = ", ".join(
        f"{line(f'{c}_a', 'up')} AS {c}_inter1, {line(f'{c}_b', 'down')} AS {c}_inter2"
        for c in ("ch1", "ch2")
    )
    base = ", ".join(
        f"CASE WHEN ts < {SQL_BASE} THEN {c}_inter1 ELSE {c}_inter2 END AS {c}_baseline, "
        f"{c} - CASE WHEN ts < {SQL_BASE} THEN {c}_inter1 ELSE {c}_inter2 END AS {c}_zeroed"
        for c in ("ch1", "ch2")
    )
    return [
        f"""{p}_mask AS (SELECT series, ts, event_id, flag,
              CASE WHEN {mask} THEN ch1 END AS ch1, CASE WHEN {mask} THEN ch2 END AS ch2
              FROM flagged)""",
        runs_cte(f"{p}_runs", f"{p}_mask", code),
        anchors_cte(f"{p}_anch", f"{p}_runs", strict),
        f"{p}_half AS (SELECT *, {halves} FROM {p}_anch)",
        f"{p}_line AS (SELECT *, {lines} FROM {p}_half)",
        f"{p} AS (SELECT *, {base} FROM {p}_line)",
    ]


NIGHT = [SIGNAL, FLAGGED, *zero_ctes("night", "flag IN (0, 2)", night_case(), False)]
ZA = zero_ctes("za", "flag <> 3", rule_case(ZERO_AIR), True)

_ZERO_COLS = [
    "ch1_zeroes", "ch2_zeroes", "ch1_zero_3sd", "ch2_zero_3sd", "ch1_baseline", "ch2_baseline",
    "ch1_zeroed", "ch2_zeroed",
]


@query(
    "valid_hourly_means",
    with_(
        SIGNAL,
        FLAGGED,
        select=f"""SELECT series, date_trunc('hour', ts) AS ts,
                          {rq('avg(CASE WHEN flag = 0 THEN ch1 END)')} AS ch1,
                          {rq('avg(CASE WHEN flag = 0 THEN ch2 END)')} AS ch2
                   FROM flagged GROUP BY ALL""",
    ),
)
def valid_hourly_means(t: Tables):
    good = F.col("flag") == 0
    valid = flagged(t).withColumns({c: F.when(good, F.col(c)) for c in ("ch1", "ch2")})
    return rounded(time_average(valid, "1 hour", KEYS, cols=["ch1", "ch2"]), "ch1", "ch2")


@query(
    "pipe_flag",
    with_(SIGNAL, FLAGGED, select="SELECT series, event_id, ts, flag FROM flagged"),
)
def pipe_flag(t: Tables):
    return zeroing.flag_quality(t.signal(), FLAGS).select("series", "event_id", "ts", "flag")


@query(
    "pipe_night_zero",
    with_(
        *NIGHT,
        select=f"SELECT series, event_id, idx, run_id, {rq_as(*_ZERO_COLS)} FROM night",
    ),
)
def pipe_night_zero(t: Tables):
    out = night(t).select("series", "event_id", "idx", "run_id", *_ZERO_COLS)
    return rounded(out, *_ZERO_COLS)


@query(
    "pipe_za_zero",
    with_(
        SIGNAL,
        FLAGGED,
        *ZA,
        select=f"SELECT series, event_id, idx, run_id, {rq_as(*_ZERO_COLS)} FROM za",
    ),
)
def pipe_za_zero(t: Tables):
    out = zero_air(t).select("series", "event_id", "idx", "run_id", *_ZERO_COLS)
    return rounded(out, *_ZERO_COLS)


def gas_flow(t: Tables):
    return t.signal().where(F.hour("ts").between(6, 19)).select(
        "ts", "event_id", (F.col("k") + 900).alias("gas_flow")
    )


FLOW = """flow AS (SELECT ts, event_id, k + 900 AS gas_flow, (k + 900) * 0.9e0 AS gas_flow_corr
  FROM signal WHERE hour(ts) BETWEEN 6 AND 19)"""


@query(
    "pipe_gas_flow",
    with_(
        SIGNAL,
        FLOW,
        select=f"""SELECT CAST(hour(ts) AS INTEGER) AS hour, {rq('avg(gas_flow_corr)')} AS gas_flow_corr
                   FROM flow GROUP BY 1
                   UNION ALL SELECT -1, {rq('avg(gas_flow_corr)')} FROM flow""",
    ),
)
def pipe_gas_flow(t: Tables):
    corrected = calibration.corrected_flow(gas_flow(t))
    overall = calibration.mean_flow(corrected).select(
        F.lit(-1).alias("hour"), F.col("gas_flow_mean").alias("gas_flow_corr")
    )
    return rounded(calibration.hourly_flow(corrected).unionByName(overall), "gas_flow_corr")


def _t(x: str) -> str:
    return f"TIMESTAMP '{x}'"


CAL = f"""cal AS (
  SELECT series, regime, {{cols}} FROM {{src}}, (VALUES {", ".join(
    f"({x.regime}, {_t(x.zero_from)}, {_t(x.zero_to)}, {_t(x.cal_from)}, {_t(x.cal_to)})"
    for x in REGIMES)}) w(regime, zf, zt, cf, ct)
  GROUP BY series, regime)"""
_CAL_COLS = ", ".join(
    f"avg(CASE WHEN ts > zf AND ts < zt THEN {c}_zeroed END) AS zero_{c}, "
    f"avg(CASE WHEN ts > cf AND ts < ct THEN {c}_zeroed END) AS std_{c}"
    for c in ("ch1", "ch2")
)
_LIQUID = "(VALUES {}) l(regime, lf1, lf2)".format(
    ", ".join(f"({x.regime}, {x.liquid_flow1!r}e0, {x.liquid_flow2!r}e0)" for x in REGIMES)
)


def _conc(lf: str, flow_col: str) -> str:
    return f"(0.01e0 / 1000 * {lf} / 1000 / 46 * 6.022e23 / (2.46e19 * {flow_col}) * 1e12)"


def _eff(flow_col: str) -> str:
    return f"(1 - exp(-7768.943e0 / {flow_col} - 0.116560784e0))"


def cal_ctes(src: str, p: str) -> list[str]:
    slopes = ", ".join(
        f"{_conc(f'lf{i}', f)} / (std_ch{i} - zero_ch{i}) AS slope_ch{i}{s}"
        for s, f in (("", "gas_flow_corr"), ("_constant", "mean_flow"))
        for i in (1, 2)
    )
    return [
        CAL.format(cols=_CAL_COLS, src=src).replace("cal AS", f"{p}_cal AS", 1),
        f"""{p}_factors AS (
          SELECT series, regime, CAST(hour AS INTEGER) AS hour, gas_flow_corr,
                 {_eff('gas_flow_corr')} AS efficiency, {_eff('mean_flow')} AS efficiency_constant,
                 {slopes}
          FROM {p}_cal JOIN {_LIQUID} USING (regime),
               (SELECT hour(ts) AS hour, avg(gas_flow_corr) AS gas_flow_corr FROM flow GROUP BY 1),
               (SELECT avg(gas_flow_corr) AS mean_flow FROM flow))""",
    ]


_FACTORS = [
    "gas_flow_corr", "efficiency", "efficiency_constant", "slope_ch1", "slope_ch2",
    "slope_ch1_constant", "slope_ch2_constant",
]


@query(
    "pipe_calibration",
    with_(
        *NIGHT,
        FLOW,
        *cal_ctes("night", "n"),
        select=f"SELECT series, regime, hour, {rq_as(*_FACTORS, digits=5)} FROM n_factors",
    ),
)
def pipe_calibration(t: Tables):
    out = calibration.calibration_factors(night(t), gas_flow(t), REGIMES, KEYS)
    return rounded(out.select("series", "regime", "hour", *_FACTORS), *_FACTORS, digits=5)


# One measured pair of liquid flows for all regimes, instead of each regime's own.
_ONE_PAIR = (5 / 27.73, 5 / 29.73)


@query(
    "pipe_calibration_one_flow",
    with_(
        *NIGHT,
        FLOW,
        *[
            c.replace(
                _LIQUID,
                "(SELECT regime, {!r}e0 AS lf1, {!r}e0 AS lf2 FROM {}) l".format(*_ONE_PAIR, _LIQUID),
            )
            for c in cal_ctes("night", "n")
        ],
        select=f"SELECT series, regime, hour, {rq_as(*_FACTORS, digits=5)} FROM n_factors",
    ),
)
def pipe_calibration_one_flow(t: Tables):
    same = [replace(x, liquid_flow1=_ONE_PAIR[0], liquid_flow2=_ONE_PAIR[1]) for x in REGIMES]
    out = calibration.calibration_factors(night(t), gas_flow(t), same, KEYS)
    return rounded(out.select("series", "regime", "hour", *_FACTORS), *_FACTORS, digits=5)


_CONSTANTS = ["efficiency_constant", "slope_ch1_constant", "slope_ch2_constant"]


def conc_ctes(src: str, p: str) -> list[str]:
    carried = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY series, regime ORDER BY ts, event_id "
        f"ROWS UNBOUNDED PRECEDING) AS {c}"
        for c in _CONSTANTS
    )
    ppt = "{0} / {2} - ({1} - {0} * (1 - {2}))"
    return [
        *cal_ctes(src, p),
        f"""{p}_rows AS (
          SELECT series, ts, event_id, flag, ch1_zeroed, ch2_zeroed, regime, efficiency,
                 slope_ch1, slope_ch2, {carried}
          FROM (SELECT *, CAST(hour(ts) AS INTEGER) AS hour,
                       {rule_case(REGIME_RULES, 'NULL')} AS regime FROM {src})
          LEFT JOIN {p}_factors USING (series, regime, hour) WHERE regime IS NOT NULL)""",
        f"""{p}_conc AS (
          SELECT series, event_id, flag, regime,
                 make_timestamp(((epoch_us(ts) - 1351200000 + 15000000) // 30000000) * 30000000) AS ts,
                 {ppt.format('ch1_zeroed * slope_ch1', 'ch2_zeroed * slope_ch2', 'efficiency')} AS hono,
                 {ppt.format('ch1_zeroed * slope_ch1_constant', 'ch2_zeroed * slope_ch2_constant',
                             'efficiency_constant')} AS hono_constant
          FROM {p}_rows)""",
    ]


@query(
    "pipe_concentration",
    with_(
        *NIGHT,
        FLOW,
        *conc_ctes("night", "n"),
        select=f"""SELECT series, event_id, ts, regime, flag, {rq_as('hono', 'hono_constant', digits=4)}
                   FROM n_conc""",
    ),
)
def pipe_concentration(t: Tables):
    out = calibration.concentrations(night(t), gas_flow(t), REGIMES, KEYS, keep_input=False)
    cols = ["hono", "hono_constant"]
    return rounded(
        out.select("series", "event_id", "ts", "regime", "flag", *cols), *cols, digits=4
    )


@query(
    "pipe_time_correct",
    """SELECT event_id, make_timestamp(((epoch_us(ts) - 1351200000 + 15000000) // 30000000) * 30000000) AS ts
       FROM events""",
)
def pipe_time_correct(t: Tables):
    return t.events.select("event_id", calibration.corrected_time("ts").alias("ts"))


SETTINGS = series.Settings(
    FLAGS, ZERO_AIR, BAD_NIGHTS, REGIMES, CUT, polluted=("2024-01-11", "2024-01-13")
)


def raw(t: Tables):
    return t.signal().select("series", "ts", "event_id", "ch1", "ch2")


def both_series(t: Tables):
    return series.calibrated(raw(t), gas_flow(t), KEYS, ORDER, SETTINGS)


def _valid(p: str, name: str) -> str:
    return f"""{p}_series AS (SELECT series, ts, CASE WHEN flag = 0 THEN hono END AS {name},
      CASE WHEN flag = 0 THEN hono_constant END AS {name}_constant FROM {p}_conc)"""


SERIES = [
    *NIGHT,
    *ZA,
    FLOW,
    *conc_ctes("night", "n"),
    *conc_ctes("za", "z"),
    _valid("n", "hono_night"),
    _valid("z", "hono_za"),
    """final AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-13'
                               THEN 'polluted' ELSE 'clean' END AS local_pollution
                 FROM n_series LEFT JOIN z_series USING (series, ts))""",
]
_HONO = ["hono_night", "hono_night_constant", "hono_za", "hono_za_constant"]


@query(
    "pipe_final_series",
    with_(
        *SERIES,
        select=f"""SELECT 'row' AS kind, series, ts, {rq_as(*_HONO, digits=4)}, local_pollution
                   FROM final
                   UNION ALL
                   SELECT 'hour', series, date_trunc('hour', ts),
                          {", ".join(rq(f"avg({c})", 4) for c in _HONO)}, NULL
                   FROM final GROUP BY series, date_trunc('hour', ts)""",
    ),
)
def pipe_final_series(t: Tables):
    night_part, za_part = both_series(t)
    rows = calibration.combined_series(night_part, za_part, KEYS, SETTINGS.polluted)
    moments = pairs.paired_moments(night_part, za_part, KEYS, _HONO[:2], _HONO[2:])
    hourly = pairs.paired_average(moments, "1 hour", KEYS, _HONO)
    both = rows.select(F.lit("row").alias("kind"), "*").unionByName(
        hourly.select(F.lit("hour").alias("kind"), "*"), allowMissingColumns=True
    )
    return rounded(both, *_HONO, digits=4)


_COMPARE = [
    f"{c}_{m}{p}" for c in ("ch1", "ch2") for m in ("night_", "") for p in ("zeroes", "baseline", "zeroed")
]


@query(
    "pipe_zero_compare",
    with_(
        *NIGHT,
        *ZA,
        "both_zero AS (SELECT series, ts, event_id, za.flag, "
        + ", ".join(
            f"night.{c}_zeroes AS {c}_night_zeroes, night.{c}_baseline AS {c}_night_baseline, "
            f"za.{c}_zeroes, za.{c}_baseline, "
            f"CASE WHEN za.flag = 0 THEN night.{c}_zeroed END AS {c}_night_zeroed, "
            f"CASE WHEN za.flag = 0 THEN za.{c}_zeroed END AS {c}_zeroed"
            for c in ("ch1", "ch2")
        )
        + " FROM night LEFT JOIN za USING (series, ts, event_id))",
        "grid AS (SELECT series, make_timestamp((epoch_us(ts) // 30000000) * 30000000) AS ts, "
        + ", ".join(f"avg({c}) AS {c}" for c in _COMPARE)
        + " FROM both_zero GROUP BY ALL)",
        select=" UNION ALL ".join(
            f"SELECT series, ts, '{c}' AS name, {rq(c)} AS value FROM grid" for c in _COMPARE
        ),
    ),
)
def pipe_zero_compare(t: Tables):
    compared = series.compare_zeroes(raw(t), KEYS, ORDER, SETTINGS)
    return rounded(comparison.zero_comparison_long(compared, KEYS, _COMPARE), "value")


_STATS = ", ".join(
    f"{rq(f'avg({c})', 4)} AS {c}_mean, {rq(f'stddev_samp({c})', 4)} AS {c}_sd, "
    f"{rq(f'stddev_samp({c}) / sqrt(count(*))', 4)} AS {c}_se"
    for c in _HONO
)


@query(
    "pipe_clean_diurnal",
    with_(
        *SERIES,
        select=f"""SELECT series, CAST(hour(ts) AS INTEGER) AS hour, {_STATS} FROM final
                   WHERE NOT (ts >= TIMESTAMP '2024-01-11' AND ts <= TIMESTAMP '2024-01-13 13:00:00')
                   GROUP BY ALL""",
    ),
)
def pipe_clean_diurnal(t: Tables):
    out = comparison.clean_diurnal(
        *both_series(t), KEYS, ("2024-01-11", "2024-01-13 13:00")
    )
    return rounded(out, *[f"{c}_{s}" for c in _HONO for s in ("mean", "sd", "se")], digits=4)


# Hourly site tables ------------------------------------------------------------------

_SITE = ["site"]


def _hourly(t: Tables):
    sig = t.signal().withColumnRenamed("series", "site")
    return time_average(sig, "1 hour", _SITE, cols=["value", "k"])


# Scales with a large prime below the bar keep means off exact rounding ties, as in ``signal``.


def nox(t: Tables):
    known = F.col("k") < 90
    return _hourly(t).select(
        "site",
        "ts",
        F.when(known, F.col("value") * 200 / 9973.0).alias("no_ppt"),
        F.when(known, F.col("k") * 3300 / 9973.0).alias("no2_ppt"),
    )


def hono(t: Tables):
    known, v, k = F.col("k") > 15, F.col("value"), F.col("k")
    scaled = {
        "hono_night": v * 500 / 9973.0,
        "hono_night_constant": v * 480 / 9973.0,
        "hono_za": k * 1100 / 9973.0,
        "hono_za_constant": k * 1000 / 9973.0,
    }
    return _hourly(t).select("site", "ts", *[F.when(known, x).alias(c) for c, x in scaled.items()])


def met(t: Tables):
    known, v, k = F.col("value") < 150, F.col("value"), F.col("k")
    scaled = {
        "ws": k * 800 / 9973.0,
        "wd": k * 36000 / 9973.0,
        "temp": k * 1000 / 9973.0 + 15,
        "rh": k * 2500 / 9973.0 + 60,
        "o3_ppb": v * 1400 / 9973.0,
        "co_ppb": v * 3300 / 9973.0 + 60,
        "co2_ppm": v * 1100 / 9973.0 + 410,
        "j_hono": F.when(k > 40, v * 1e-5),
        "jhono_calc": F.when(k > 30, v * 1.1e-5),
        "j_hno3": F.when(k > 50, v * 1e-8),
        "jhno3_calc": F.when(k > 25, v * 1.2e-8),
    }
    return _hourly(t).select("site", "ts", *[F.when(known, x).alias(c) for c, x in scaled.items()])


def sectors(t: Tables):
    north = F.when(F.col("k") > 10, F.col("k") * 9970 / 9973.0)
    return _hourly(t).select("site", "ts", north.alias("North.Atlantic"), (100 - north).alias("Sahara"))


def nitrate(t: Tables):
    sig = t.signal().withColumnRenamed("series", "site")
    daily = time_average(sig, "1 day", _SITE, cols=["value", "k"])
    return daily.select(
        "site", F.to_date("ts").alias("date"), F.when(F.col("k") < 51, F.col("value") * 100 / 9973.0).alias("nitrate")
    )


HOURLY = """hourly AS (SELECT series AS site, date_trunc('hour', ts) AS ts, avg(value) AS v, avg(k) AS k
  FROM signal GROUP BY ALL)"""
NOX = """nox AS (SELECT site, ts, CASE WHEN k < 90 THEN v * 200 / 9973e0 END AS no_ppt,
  CASE WHEN k < 90 THEN k * 3300 / 9973e0 END AS no2_ppt FROM hourly)"""
HONO = """hono AS (SELECT site, ts, v * 500 / 9973e0 AS hono_night, v * 480 / 9973e0 AS hono_night_constant,
  k * 1100 / 9973e0 AS hono_za, k * 1000 / 9973e0 AS hono_za_constant
  FROM (SELECT site, ts, CASE WHEN k > 15 THEN v END AS v, CASE WHEN k > 15 THEN k END AS k FROM hourly))"""
MET = """met AS (SELECT site, ts, k * 800 / 9973e0 AS ws, k * 36000 / 9973e0 AS wd, k * 1000 / 9973e0 + 15 AS temp,
  k * 2500 / 9973e0 + 60 AS rh, v * 1400 / 9973e0 AS o3_ppb, v * 3300 / 9973e0 + 60 AS co_ppb,
  v * 1100 / 9973e0 + 410 AS co2_ppm, CASE WHEN k > 40 THEN v * 1e-5 END AS j_hono,
  CASE WHEN k > 30 THEN v * 1.1e-5 END AS jhono_calc, CASE WHEN k > 50 THEN v * 1e-8 END AS j_hno3,
  CASE WHEN k > 25 THEN v * 1.2e-8 END AS jhno3_calc
  FROM (SELECT site, ts, CASE WHEN v < 150 THEN v END AS v, CASE WHEN v < 150 THEN k END AS k FROM hourly))"""
SECTORS = """sectors AS (SELECT site, ts, k * 9970 / 9973e0 AS north_atlantic, 100 - k * 9970 / 9973e0 AS sahara
  FROM (SELECT site, ts, CASE WHEN k > 10 THEN k END AS k FROM hourly))"""
NITRATE = """nitrate_daily AS (SELECT series AS site, date_trunc('day', ts) AS ts,
  CASE WHEN avg(k) < 51 THEN avg(value) * 100 / 9973e0 END AS nitrate FROM signal GROUP BY ALL)"""
RAD = """rad AS (SELECT site, ts, ws, wd, temp, rh, o3_ppb, co_ppb, co2_ppm,
  coalesce(jh, avg(jh) OVER (PARTITION BY site, hour(ts))) AS jhono,
  coalesce(jn, avg(jn) OVER (PARTITION BY site, hour(ts))) AS jhno3
  FROM (SELECT *, coalesce(j_hono, jhono_calc) AS jh, coalesce(j_hno3, jhno3_calc) AS jn FROM met))"""
MERGED = """merged AS (SELECT site, ts, no_ppt, no2_ppt, hono_night_constant AS hono_night,
  hono_za_constant AS hono_za, ws, wd, temp, rh, o3_ppb, co_ppb, co2_ppm, jhono, jhno3, north_atlantic, sahara,
  CASE WHEN wd BETWEEN 100 AND 340 OR ws <= 2 THEN 'Local pollution' ELSE 'Clean' END
    AS local_pollution,
  CAST(hour(ts) AS INTEGER) AS hour,
  CASE WHEN hour(ts) BETWEEN 8 AND 19 THEN 2e6 ELSE 0e0 END AS oh_molecules_cm3
  FROM nox LEFT JOIN hono USING (site, ts) LEFT JOIN rad USING (site, ts)
  LEFT JOIN sectors USING (site, ts))"""
MERGE = [SIGNAL, HOURLY, NOX, HONO, MET, SECTORS, RAD, MERGED]


def merged(t: Tables):
    return budget.merge_hourly(
        nox(t), hono(t), budget.gapfill_radiation(met(t), _SITE), clean_names(sectors(t)), _SITE
    )


@query(
    "pipe_radiation_gapfill",
    with_(
        SIGNAL,
        HOURLY,
        MET,
        RAD,
        select=f"""SELECT site, ts, {rq_as('ws', 'wd', 'temp')}, {rq('jhono * 1e3 / 0.997e0')} AS jhono_1e3,
                          {rq('jhno3 * 1e6 / 0.997e0')} AS jhno3_1e6 FROM rad""",
    ),
)
def pipe_radiation_gapfill(t: Tables):
    out = budget.gapfill_radiation(met(t), _SITE)
    return out.select(
        "site", "ts", *[r(c).alias(c) for c in ("ws", "wd", "temp")],
        r(F.col("jhono") * 1e3 / 0.997).alias("jhono_1e3"), r(F.col("jhno3") * 1e6 / 0.997).alias("jhno3_1e6"),
    )


_MERGE_COLS = ["no_ppt", "no2_ppt", "hono_night", "hono_za", "ws", "wd", "temp", "rh", "o3_ppb", "co_ppb",
               "co2_ppm", "north_atlantic", "sahara"]


@query(
    "pipe_merge_hourly",
    with_(
        *MERGE,
        select=f"""SELECT site, ts, hour, {rq_as(*_MERGE_COLS)}, local_pollution, oh_molecules_cm3
                   FROM merged""",
    ),
)
def pipe_merge_hourly(t: Tables):
    out = merged(t).select(
        "site", "ts", "hour", *_MERGE_COLS, "local_pollution", "oh_molecules_cm3"
    )
    return rounded(out, *_MERGE_COLS)


_LONG = ["hono_za", "hono_night", "no_ppt", "no2_ppt", "co_ppb", "o3_ppb", "co2_ppm"]


@query(
    "pipe_timeseries_table",
    with_(
        *MERGE,
        select=" UNION ALL ".join(
            f"""SELECT site, ts, '{c}' AS name, {rq(c)} AS value,
                       CASE WHEN ts >= TIMESTAMP '2024-01-11 05:00:00'
                             AND ts < TIMESTAMP '2024-01-13 13:00:00' THEN 1e0 ELSE 0e0 END
                         AS pollution_date
                FROM merged WHERE ts > TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-19'"""
            for c in _LONG
        ),
    ),
)
def pipe_timeseries_table(t: Tables):
    out = budget.timeseries_table(
        merged(t), _SITE, _LONG, ("2024-01-08", "2024-01-19"),
        ("2024-01-11 05:00", "2024-01-13 13:00"),
    )
    return rounded(out, "value")


def _sinks(src: str = "") -> str:
    return "(jhono + 6e-12 * oh_molecules_cm3 + kdep)"


_PSS = ["lifetime", "h", "hono_without_nitrate"]


@query(
    "pipe_pss_no_nitrate",
    with_(
        *MERGE,
        """life AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY site ORDER BY ts) AS lifetime
            FROM (SELECT *, CASE WHEN hour BETWEEN 11 AND 15 THEN 1 / nullif(jhono, 0) END AS raw
                  FROM merged WHERE ts > TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-19'))""",
        """rates AS (SELECT *, lifetime * 0.3e0 AS h, 3.3e-11 * pow((temp + 273.15e0) / 300, -0.3e0) AS kp,
                            0.01e0 / (lifetime * 0.3e0) AS kdep FROM life)""",
        f"""pss AS (SELECT *, kp * oh_molecules_cm3 * no_ppt * 2.46e7 AS production,
                   {_sinks()} * hono_night * 2.46e7 AS loss FROM rates)""",
        select=f"""SELECT site, ts, {rq('lifetime', 4)} AS lifetime, {rq('h', 4)} AS h,
                          {rq('kp * 1e11')} AS kp_1e11, {rq('kdep * 1e5')} AS kdep_1e5,
                          {rq('production / 1e4')} AS production_1e4, {rq('loss / 1e4')} AS loss_1e4,
                          {rq(f'production / {_sinks()} / 2.46e7')} AS hono_without_nitrate
                   FROM pss""",
    ),
)
def pipe_pss_no_nitrate(t: Tables):
    out = budget.budget_without_nitrate(
        merged(t), _SITE, "hono_night", ("2024-01-08", "2024-01-19")
    )
    return out.select(
        "site",
        "ts",
        r("lifetime", 4).alias("lifetime"),
        r("h", 4).alias("h"),
        r(F.col("kp") * 1e11).alias("kp_1e11"),
        r(F.col("kdep") * 1e5).alias("kdep_1e5"),
        r(F.col("production_without_nitrate") / 1e4).alias("production_1e4"),
        r(F.col("loss") / 1e4).alias("loss_1e4"),
        r("hono_without_nitrate").alias("hono_without_nitrate"),
    )


def with_nitrate(t: Tables):
    return budget.add_daily_nitrate(sequence(merged(t), _SITE, ["ts"]), nitrate(t), _SITE)


WITH_NITRATE = [
    *MERGE,
    NITRATE,
    """dn AS (SELECT *, nitrate * 1e-12 * 6.022e23 / 62.004e0 AS nm,
               nitrate * 1e-12 * 6.022e23 / 62.004e0 * 1e15 / 6.022e23 AS nn
        FROM (SELECT merged.*, last_value(n.nitrate IGNORE NULLS)
                     OVER (PARTITION BY merged.site ORDER BY merged.ts) AS nitrate
              FROM merged LEFT JOIN nitrate_daily n ON merged.site = n.site AND merged.ts = n.ts))""",
    f"""day AS (SELECT *, loss_night - production AS missing_night, loss_za - production AS missing_za,
               385.7e0 / (1 + 0.19e0 * nn) AS f_fit_a, 5.02e8 / (1 + 7.19e5 * nn) AS f_fit_b
        FROM (SELECT *, 3.3e-11 * oh_molecules_cm3 * no_ppt * 2.46e7 AS production,
                     {_sinks()} * hono_night * 2.46e7 AS loss_night,
                     {_sinks()} * hono_za * 2.46e7 AS loss_za
              FROM (SELECT *, 1 / nullif(jhono, 0) AS lifetime, 0.01e0 / (0.3e0 / nullif(jhono, 0)) AS kdep
                    FROM dn WHERE hour BETWEEN 11 AND 15)))""",
    """f AS (SELECT *, missing_night / nullif(jhno3 * nm, 0) AS f_calc_night,
                    missing_za / nullif(jhno3 * nm, 0) AS f_calc_za FROM day)""",
]


@query(
    "pipe_pss_with_nitrate",
    with_(
        *WITH_NITRATE,
        select=f"""SELECT site, ts, {rq('nitrate')} AS nitrate, {rq('nn')} AS nitrate_nmol_m3,
                          {rq('lifetime', 4)} AS lifetime, {rq('production / 1e4')} AS production_1e4,
                          {rq('loss_night / 1e4')} AS loss_1e4, {rq('missing_night / 1e4')} AS missing_1e4,
                          {rq('f_calc_night', 4)} AS f_calc, {rq_as('f_fit_a', 'f_fit_b', digits=5)}
                   FROM f""",
    ),
)
def pipe_pss_with_nitrate(t: Tables):
    out = budget.budget_with_nitrate(with_nitrate(t))
    return out.select(
        "site",
        "ts",
        r("nitrate").alias("nitrate"),
        r("nitrate_nmol_m3").alias("nitrate_nmol_m3"),
        r("lifetime", 4).alias("lifetime"),
        r(F.col("production_without_nitrate") / 1e4).alias("production_1e4"),
        r(F.col("loss") / 1e4).alias("loss_1e4"),
        r(F.col("missing_production") / 1e4).alias("missing_1e4"),
        r("f_calc", 4).alias("f_calc"),
        r("f_fit_a", 5).alias("f_fit_a"),
        r("f_fit_b", 5).alias("f_fit_b"),
    )


_CARRY = ["f_fit_a", "f_fit_b", "f_calc_night", "f_calc_za", "lifetime"]
DAILY = [
    *WITH_NITRATE,
    "df AS (SELECT site, date_trunc('day', ts) AS ts, "
    + ", ".join(f"avg({c}) AS {c}" for c in _CARRY)
    + " FROM f GROUP BY ALL)",
    "dd AS (SELECT dn.*, "
    + ", ".join(
        f"last_value(df.{c} IGNORE NULLS) OVER (PARTITION BY dn.site ORDER BY dn.ts) AS {c}"
        for c in _CARRY
    )
    + " FROM dn LEFT JOIN df ON dn.site = df.site AND dn.ts = df.ts)",
    """de AS (SELECT *, 0.01e0 / (lifetime * 0.3e0) AS kdep,
                     3.3e-11 * oh_molecules_cm3 * no_ppt * 2.46e7 AS production FROM dd)""",
    f"""daily AS (SELECT *, (production + jhno3 * nm * f_fit_a) / {_sinks()} / 2.46e7 AS hono_fit_a,
                 (production + jhno3 * nm * f_fit_b) / {_sinks()} / 2.46e7 AS hono_fit_b,
                 (production + jhno3 * nm) / {_sinks()} / 2.46e7 AS pss_factor1,
                 {_sinks()} * hono_night * 2.46e7 AS loss FROM de)""",
]
_MODELS = ["hono_fit_a", "hono_fit_b", "pss_factor1"]


@query(
    "pipe_daily_enhancement",
    with_(
        *DAILY,
        select=f"""SELECT site, ts, {rq_as('f_fit_a', 'f_fit_b', digits=5)},
                   {rq('f_calc_night', 4)} AS f_calc, {rq('lifetime', 4)} AS lifetime,
                   {rq('loss / 1e4')} AS loss_1e4, {rq_as(*_MODELS, digits=5)},
                   {rq('CASE WHEN hour BETWEEN 11 AND 15 THEN na END', 5)} AS nmb_fit_a,
                   {rq('CASE WHEN hour BETWEEN 11 AND 15 THEN nb END', 5)} AS nmb_fit_b
                   FROM daily JOIN (
                     SELECT site, 100 * sum(hono_fit_a - hono_night) / sum(hono_night) AS na,
                            100 * sum(hono_fit_b - hono_night) / sum(hono_night) AS nb
                     FROM daily GROUP BY site) USING (site)""",
    ),
)
def pipe_daily_enhancement(t: Tables):
    out = budget.daily_enhancement(with_nitrate(t), _SITE)
    names = ["f_fit_a", "f_fit_b", *_MODELS, "nmb_fit_a", "nmb_fit_b"]
    return out.select(
        "site",
        "ts",
        *[r(c, 5).alias(c) for c in names],
        r("f_calc", 4).alias("f_calc"),
        r("lifetime", 4).alias("lifetime"),
        r(F.col("loss") / 1e4).alias("loss_1e4"),
    )


_VARIANT = {
    "night": {"Measured": "hono_night", "Fit A": "hono_fit_a", "Fit B": "hono_fit_b"},
    "za": {"Measured": "hono_za", "Fit A": "hono_fit_a", "Fit B": "hono_fit_b"},
}


@query(
    "pipe_variant_compare",
    with_(
        *DAILY,
        select=" UNION ALL ".join(
            f"""SELECT site, ts, '{v}' AS name, '{q}' AS quantity, {rq(c, 5)} AS value,
                       {rq(f'f_calc_{v}', 4)} AS f_calc FROM daily"""
            for v, cols in _VARIANT.items()
            for q, c in cols.items()
        ),
    ),
)
def pipe_variant_compare(t: Tables):
    long = budget.variant_long(budget.variant_table(with_nitrate(t), _SITE), _SITE)
    return rounded(rounded(long, "value", digits=5), "f_calc", digits=4)


_NMB = {f"nmb_fit_{m}_{v}": (f"hono_fit_{m}", f"hono_{v}") for v in ("za", "night") for m in "ab"}
BIAS = "bias AS (SELECT site, " + ", ".join(
    f"100 * sum({m} - {o}) / sum({o}) AS {n}" for n, (m, o) in _NMB.items()
) + " FROM daily GROUP BY site)"
_WIDE = ["hono_night", "hono_za", "no_ppt", "no2_ppt", "ws", "wd", "temp", "rh", "o3_ppb", "co_ppb", "co2_ppm",
         "north_atlantic", "sahara", "nitrate"]


@query(
    "pipe_variant_table",
    with_(
        *DAILY,
        BIAS,
        select=f"""SELECT site, ts, hour, {rq_as(*_WIDE, digits=5)}, local_pollution, oh_molecules_cm3,
                   {rq('jhono * 1e3 / 0.997e0')} AS jhono_1e3, {rq('jhno3 * 1e6 / 0.997e0')} AS jhno3_1e6,
                   {rq('nm / 1e6')} AS nitrate_1e6, {rq('nn')} AS nitrate_nmol_m3,
                   {rq_as('f_calc_za', 'f_calc_night', digits=4)}, """
        + ", ".join(
            f"{rq(f'f_fit_{m}', 5)} AS f_fit_{m}_{v}, {rq(f'hono_fit_{m}', 5)} AS hono_fit_{m}_{v}"
            for v in ("za", "night")
            for m in "ab"
        )
        + ", "
        + ", ".join(f"{rq(f'CASE WHEN hour BETWEEN 11 AND 15 THEN {n} END', 5)} AS {n}" for n in _NMB)
        + " FROM daily JOIN bias USING (site)",
    ),
)
def pipe_variant_table(t: Tables):
    out = budget.variant_table(with_nitrate(t), _SITE)
    five = [*_WIDE, *_NMB, *[f"{c}_fit_{m}_{v}" for c in ("f", "hono") for v in ("za", "night") for m in "ab"]]
    out = out.select(
        "site", "ts", "hour", "local_pollution", "oh_molecules_cm3", *five, "f_calc_za", "f_calc_night",
        r(F.col("jhono") * 1e3 / 0.997).alias("jhono_1e3"),
        r(F.col("jhno3") * 1e6 / 0.997).alias("jhno3_1e6"),
        r(F.col("nitrate_molecules_cm3") / 1e6).alias("nitrate_1e6"),
        r("nitrate_nmol_m3").alias("nitrate_nmol_m3"),
    )
    return rounded(rounded(out, *five, digits=5), "f_calc_za", "f_calc_night", digits=4)


@query(
    "pipe_variant_bias",
    with_(*DAILY, BIAS, select=f"SELECT site, {rq_as(*_NMB, digits=5)} FROM bias"),
)
def pipe_variant_bias(t: Tables):
    out = budget.variant_bias(budget.variant_table(with_nitrate(t), _SITE), _SITE)
    return rounded(out, *_NMB, digits=5)


# Flow, air masses, step response -----------------------------------------------------


@query(
    "pipe_flow_vs_temperature",
    with_(
        SIGNAL,
        HOURLY,
        FLOW,
        """fh AS (SELECT date_trunc('hour', ts) AS ts, avg(gas_flow) AS gas_flow,
                         avg(gas_flow_corr) AS gas_flow_corr FROM flow GROUP BY 1)""",
        """m AS (SELECT date_trunc('hour', ts + INTERVAL 30 MINUTE) AS ts, value / 997e0 AS temp
                 FROM signal)""",
        select=f"SELECT ts, {rq_as('gas_flow', 'gas_flow_corr', 'temp')} FROM fh LEFT JOIN m USING (ts)",
    ),
)
def pipe_flow_vs_temperature(t: Tables):
    temperature = t.signal().select("ts", (F.col("value") / 997.0).alias("temp"))
    out = flow.flow_vs_temperature(gas_flow(t), temperature, [])
    return rounded(out, "gas_flow", "gas_flow_corr", "temp")


_MEASURED = ["during", "before"]


@query(
    "pipe_flow_calibration",
    with_(
        """long AS (SELECT p_size AS set_point, 'during' AS name, p_retailprice / 20 AS value FROM part
                    UNION ALL SELECT p_size, 'before', p_partkey / 40e0 FROM part)""",
        select=fit_sql("set_point", "value", "name", "long"),
    ),
)
def pipe_flow_calibration(t: Tables):
    check = t.part.select(
        F.col("p_size").alias("set_point"),
        (F.col("p_retailprice") / 20).alias("during"),
        (F.col("p_partkey") / 40).alias("before"),
    )
    return rounded(flow.flow_calibration(check, "set_point", _MEASURED), *FIT_COLS)


@query(
    "pipe_flow_by_hour",
    with_(
        SIGNAL,
        FLOW,
        "fl AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, gas_flow_corr FROM flow)",
        *five_number_ctes("fl", "gas_flow_corr", "hour"),
        select=f"SELECT hour, n, {rq_as(*FIVE)}, outliers FROM q JOIN b USING (hour)",
    ),
)
def pipe_flow_by_hour(t: Tables):
    table = gas_flow(t).withColumn("hour", F.hour("ts"))
    return rounded(flow.flow_by_hour(table, "event_id"), *FIVE)


@query(
    "pipe_lab_flow",
    with_(
        SIGNAL,
        """lab AS (SELECT series, date_trunc('minute', ts + INTERVAL 30 SECOND) AS ts,
                     TRY_CAST(CASE WHEN value < 20 THEN 'error' ELSE CAST(value AS VARCHAR) END AS DOUBLE)
                       AS volumetric_flow, k / 97e0 AS pressure FROM signal)""",
        select=f"""SELECT 'bucket' AS kind, series,
                          make_timestamp((epoch_us(ts) // 900000000) * 900000000) AS ts,
                          {rq('avg(volumetric_flow) / 997e0')} AS volumetric_flow,
                          {rq('avg(pressure)')} AS pressure FROM lab GROUP BY ALL
                   UNION ALL SELECT 'all', NULL, NULL, {rq('avg(volumetric_flow) / 997e0')}, NULL
                   FROM lab""",
    ),
)
def pipe_lab_flow(t: Tables):
    from strandline.operators.columns import to_double
    from strandline.operators.stats import global_means

    numbers = ["volumetric_flow", "pressure"]
    log = t.signal().select(
        "series",
        "ts",
        F.when(F.col("value") < 20, "error").otherwise(F.col("value").cast("string")).alias(
            "volumetric_flow"
        ),
        (F.col("k") / 97.0).cast("string").alias("pressure"),
    )
    buckets = flow.lab_flow(log, numbers, KEYS).select(F.lit("bucket").alias("kind"), "*")
    overall = global_means(to_double(log, numbers), ["volumetric_flow"]).select(
        F.lit("all").alias("kind"), "*"
    )
    out = buckets.unionByName(overall, allowMissingColumns=True)
    return rounded(
        out.withColumn("volumetric_flow", F.col("volumetric_flow") / 997.0), *numbers
    )


@query(
    "pipe_airmass_long",
    with_(
        SIGNAL,
        HOURLY,
        SECTORS,
        select=" UNION ALL ".join(
            f"""SELECT site, ts, '{name}' AS name, {rq(x)} AS value FROM sectors
                WHERE ts > TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-19'"""
            for name, x in (("North Atlantic", "north_atlantic"), ("Sahara", "sahara"))
        ),
    ),
)
def pipe_airmass_long(t: Tables):
    return rounded(
        airmass.airmass_long(sectors(t), _SITE, ("2024-01-07", "2024-01-19")), "value"
    )


@query(
    "pipe_nitrate_airmass",
    with_(
        SIGNAL,
        HOURLY,
        SECTORS,
        """n AS (
             SELECT series AS site, date_trunc('day', ts + INTERVAL 12 HOUR) AS ts, avg(value) / 997 AS nitrate
             FROM signal WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL
             UNION ALL
             SELECT series, date_trunc('day', ts), avg(k) / 97 FROM signal
             WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)""",
        """s AS (SELECT site, date_trunc('day', ts) AS ts, avg(north_atlantic) AS north_atlantic,
                        avg(sahara) AS sahara FROM sectors GROUP BY ALL)""",
        select=f"""SELECT site, ts, {rq_as('nitrate', 'north_atlantic', 'sahara', digits=5)}
                   FROM n FULL JOIN s USING (site, ts)""",
    ),
)
def pipe_nitrate_airmass(t: Tables):
    sig = t.signal().withColumnRenamed("series", "site")
    first = sig.where(between_open("ts", end="2024-01-16")).select(
        "site", "ts", (F.col("value") / 997).alias("nitrate_mg_m")
    )
    second = sig.where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).select(
        "site", "ts", (F.col("k") / 97).alias("nitrate")
    )
    out = airmass.nitrate_with_airmass(first, second, sectors(t), _SITE)
    path = fresh_path(t.spark, "nitrate")
    names = ["nitrate", "north_atlantic", "sahara"]
    files.write_csv(airmass.export_order(out, _SITE), path)
    back = files.read_series_csv(
        t.spark, path,
        "site string, ts string, nitrate double, north_atlantic double, sahara double",
        ["ts"], "ymd_hms",
    )
    return rounded(back.select("site", "ts", *names), *names, digits=5)


@query(
    "step_response_time",
    with_(
        SIGNAL,
        runs_cte("runs", "signal", night_case()),
        """ends AS (SELECT series, run_id, min(ts) AS start_ts, arg_min(ch1, idx) AS start_value,
                           arg_max(ch1, idx) AS end_value
                    FROM (SELECT * FROM runs WHERE ch1 IS NOT NULL AND run_id <> 0) GROUP BY ALL)""",
        """starts AS (SELECT series, run_id, min(ts) AS first_ts FROM runs WHERE run_id <> 0
                      GROUP BY ALL)""",
        """thr AS (SELECT *, start_value + 0.9e0 * (end_value - start_value) AS threshold
                   FROM starts LEFT JOIN ends USING (series, run_id))""",
        """hit AS (SELECT series, run_id, min(CASE WHEN CASE WHEN end_value < start_value
                            THEN ch1 <= threshold ELSE ch1 >= threshold END THEN ts END) AS crossed_ts
                   FROM runs JOIN thr USING (series, run_id) GROUP BY ALL)""",
        select=f"""SELECT series, run_id, {rq_as('start_value', 'end_value', 'threshold')},
                          first_ts AS start_ts, crossed_ts,
                          {rq('(epoch_us(crossed_ts) - epoch_us(first_ts)) / 1e6')} AS seconds
                   FROM thr JOIN hit USING (series, run_id)""",
    ),
)
def step_response_time(t: Tables):
    nights = zeroing.mark_nights(t.signal(), BAD_NIGHTS)
    out = zeroing.step_response(nights, "night_zero", "ch1", KEYS, ORDER)
    return rounded(out, "start_value", "end_value", "threshold", "seconds")
