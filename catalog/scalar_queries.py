"""Scalar functions on timestamps and numbers."""

from pyspark.sql import functions as F

from catalog.base import Tables, from_signal, query, r, rounded, rq, rq_as
from strandline.functions import chem, scalars, timefn


@query(
    "concat_datetime",
    "SELECT event_id, strftime(ts, '%d/%m/%Y') || ' ' || strftime(ts, '%H:%M') AS text FROM events",
)
def concat_datetime(t: Tables):
    return t.events.select(
        "event_id",
        timefn.concat_datetime(
            F.date_format("ts", "dd/MM/yyyy"), F.date_format("ts", "HH:mm")
        ).alias("text"),
    )


@query(
    "parse_datetime",
    """SELECT event_id, date_trunc('second', ts) AS dmy_hms, date_trunc('minute', ts) AS dmy_hm,
              ts AS ymd_hms, date_trunc('day', ts) AS ymd, date_trunc('minute', ts) AS mdy_hm,
              CASE WHEN day(ts) <= 12
                   THEN make_timestamp(year(ts), day(ts), month(ts), 0, 0, 0) END AS swapped
       FROM events""",
)
def parse_datetime(t: Tables):
    text = lambda pattern: F.date_format("ts", pattern)
    return t.events.select(
        "event_id",
        timefn.parse_datetime(text("dd.MM.yyyy HH:mm:ss"), "dmy_hms").alias("dmy_hms"),
        timefn.parse_datetime(text("d/M/yy H:mm"), "dmy_hm").alias("dmy_hm"),
        timefn.parse_datetime(text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "ymd_hms").alias("ymd_hms"),
        timefn.parse_datetime(text("yyyy/MM/dd"), "ymd").alias("ymd"),
        timefn.parse_datetime(text("M/d/yyyy HH:mm"), "mdy_hm").alias("mdy_hm"),
        timefn.parse_datetime(text("dd-MM-yyyy"), "mdy").alias("swapped"),
    )


@query("extract_hour", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def extract_hour(t: Tables):
    return t.events.select("event_id", timefn.extract_hour("ts").alias("hour"))


@query("extract_day", "SELECT event_id, CAST(day(ts) AS INTEGER) AS day FROM events")
def extract_day(t: Tables):
    return t.events.select("event_id", timefn.extract_day("ts").alias("day"))


_WIDTHS = {
    "half_minute": ("30 seconds", 30),
    "minute": ("1 minute", 60),
    "five_minutes": ("5 min", 300),
    "hour": ("1 hour", 3600),
    "day": ("1 day", 86400),
}


def _round_sql(width: int) -> str:
    us = width * 1_000_000
    return f"make_timestamp(((epoch_us(ts) + {us // 2}) // {us}) * {us})"


@query(
    "round_time",
    "SELECT event_id, "
    + ", ".join(f"{_round_sql(w)} AS {n}" for n, (_, w) in _WIDTHS.items())
    + " FROM events",
)
def round_time(t: Tables):
    return t.events.select(
        "event_id", *[timefn.round_time("ts", every).alias(n) for n, (every, _) in _WIDTHS.items()]
    )


@query(
    "shift_time",
    "SELECT event_id, make_timestamp(epoch_us(ts) - 1351200000) AS sampled FROM events",
)
def shift_time(t: Tables):
    return t.events.select("event_id", timefn.shift_time("ts", -22.52 * 60).alias("sampled"))


@query(
    "classify_case_when",
    from_signal(
        """SELECT event_id,
                  CASE WHEN wd BETWEEN 100 AND 340 THEN 'Local pollution'
                       WHEN ch1 <= 0.05 THEN 'Local pollution' ELSE 'Clean' END AS local_pollution,
                  CASE WHEN wd <= 90 THEN '< 90' WHEN wd > 90 AND wd < 100 THEN 'Between 90 and 100'
                       WHEN wd BETWEEN 100 AND 340 THEN 'Local pollution'
                       WHEN wd > 340 THEN '> 340' END AS wd_flag
           FROM (SELECT *, CASE WHEN ch2 IS NOT NULL THEN k * 3.6e0 END AS wd FROM signal)"""
    ),
)
def classify_case_when(t: Tables):
    from strandline.plans.budget import wind_sector

    df = t.signal().withColumn("wd", F.when(F.col("ch2").isNotNull(), F.col("k") * 3.6))
    wd = F.col("wd")
    label = scalars.first_match(
        [(wd.between(100, 340), "Local pollution"), (F.col("ch1") <= 0.05, "Local pollution")],
        "Clean",
    )
    return df.select("event_id", label.alias("local_pollution"), wind_sector(wd).alias("wd_flag"))


@query(
    "classify_ifelse",
    from_signal(
        """SELECT event_id, CASE WHEN ch1 IS NULL THEN NULL WHEN ch1 > 0.1 THEN 'polluted'
                                 ELSE 'clean' END AS label FROM signal"""
    ),
)
def classify_ifelse(t: Tables):
    return t.signal().select(
        "event_id", scalars.two_way(F.col("ch1") > 0.1, "polluted", "clean").alias("label")
    )


@query(
    "in_range",
    "SELECT p_partkey, p_size BETWEEN 11 AND 15 AS inside FROM part",
)
def in_range(t: Tables):
    return t.part.select("p_partkey", scalars.in_range("p_size", 11, 15).alias("inside"))


@query(
    "math_exp_pow_abs_sqrt",
    f"""SELECT p_partkey, {rq('1 - exp(-7768.943e0 / p_retailprice - 0.116560784e0)')} AS efficiency,
               {rq('pow(p_size, -0.3e0)')} AS power, {rq('abs(p_retailprice - 950)')} AS distance,
               {rq('sqrt(p_size)')} AS root FROM part""",
)
def math_exp_pow_abs_sqrt(t: Tables):
    out = t.part.select(
        "p_partkey",
        chem.sampling_efficiency("p_retailprice").alias("efficiency"),
        F.pow("p_size", F.lit(-0.3)).alias("power"),
        F.abs(F.col("p_retailprice") - 950).alias("distance"),
        F.sqrt("p_size").alias("root"),
    )
    return rounded(out, "efficiency", "power", "distance", "root")


@query(
    "round_half_even",
    "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half FROM lineitem",
)
def round_half_even(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", scalars.round_half_even(F.col("l_quantity") / 2).alias("half")
    )


@query(
    "unit_ppt_to_molecules",
    f"SELECT event_id, {rq('value * 2.46e7 / 1e6')} AS molecules_1e6 FROM events",
)
def unit_ppt_to_molecules(t: Tables):
    return t.events.select(
        "event_id", r(chem.ppt_to_molecules("value") / 1e6).alias("molecules_1e6")
    )


@query(
    "unit_molecules_to_ppt",
    f"SELECT event_id, {rq('value * 1e6 / 2.46e7')} AS ppt FROM events",
)
def unit_molecules_to_ppt(t: Tables):
    return t.events.select(
        "event_id", r(chem.molecules_to_ppt(F.col("value") * 1e6)).alias("ppt")
    )


@query(
    "unit_mass_to_molecules",
    "SELECT event_id, "
    + rq_as("molecules_1e10", "nmol_m3")
    + """ FROM (SELECT event_id, value * 1e-12 * 6.022e23 / 62.004e0 / 1e10 AS molecules_1e10,
                       value * 1e-12 * 6.022e23 / 62.004e0 * 1e15 / 6.022e23 AS nmol_m3
                FROM events)""",
)
def unit_mass_to_molecules(t: Tables):
    molecules = chem.nitrate_to_molecules("value")
    return t.events.select(
        "event_id",
        r(molecules / 1e10).alias("molecules_1e10"),
        r(chem.molecules_to_nmol(molecules)).alias("nmol_m3"),
    )
