"""Registry of the checked queries and the frames they share.

Every query reads whole tables.  ``signal`` views the event stream as a
two-channel instrument: one series per event type, values below a detection
limit missing.  Dividing by a prime keeps means off exact rounding ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import configure
from strandline.operators.intervals import Rule
from strandline.plans import campaign

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The test events fall in January 2024; the campaign's rules are moved there.
SHIFT_DAYS = -244
FLAGS = campaign.flag_rules(SHIFT_DAYS)
ZERO_AIR = campaign.zero_air_rules(SHIFT_DAYS)
BAD_NIGHTS = campaign.bad_night_rules(SHIFT_DAYS)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def signal(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("double")
        return self.events.select(
            F.col("event_type").alias("series"),
            "ts",
            "event_id",
            F.when(F.col("value") > 15, F.col("value") / 997.0).alias("ch1"),
            F.when(k < 90, k / 97.0).alias("ch2"),
            k.alias("k"),
            "value",
        )


SIGNAL = """signal AS (
  SELECT event_type AS series, ts, event_id,
         CASE WHEN value > 15 THEN value / 997e0 END AS ch1,
         CASE WHEN k < 90 THEN k / 97e0 END AS ch2, k, value
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events))"""

KEYS = ["series"]
ORDER = ["ts", "event_id"]
OVER = "(PARTITION BY series ORDER BY ts, event_id)"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def from_signal(select: str) -> str:
    return with_(SIGNAL, select=select)


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


def rq(x: str, digits: int = 6) -> str:
    """Rounded SQL value; adding zero turns a negative zero into zero."""
    return f"round({x}, {digits}) + 0e0"


def rq_as(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"{rq(c, digits)} AS {c}" for c in cols)


def rule_case(rules: list[Rule], default: str = "0", ts: str = "ts") -> str:
    arms = []
    for rule in rules:
        tests = []
        if rule.start:
            tests.append(f"{ts} > TIMESTAMP '{rule.start}'")
        if rule.end:
            tests.append(f"{ts} < TIMESTAMP '{rule.end}'")
        arms.append(f"WHEN {' AND '.join(tests)} THEN {rule.code}")
    return f"CASE {' '.join(arms)} ELSE {default} END"


def night_case(ts: str = "ts") -> str:
    return (
        f"CASE WHEN (hour({ts}) <= 4 OR hour({ts}) >= 21) "
        f"AND ({rule_case(BAD_NIGHTS, ts=ts)}) = 0 THEN 1 ELSE 0 END"
    )
