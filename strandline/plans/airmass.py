"""Air-mass sectors and daily nitrate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from strandline.functions.timefn import between_open, round_time
from strandline.operators.columns import clean_names, numeric_columns, rename_matching
from strandline.operators.joins import natural_full_join
from strandline.operators.reshape import sort_time, union_by_name, unpivot
from strandline.operators.resample import time_average


def airmass_long(
    sectors: DataFrame, keys: Sequence[str], window: tuple[str, str] = ("2024-09-07", "2024-09-19")
) -> DataFrame:
    """Sector shares of a window in long form, dots in names read as blanks."""
    named = rename_matching(sectors, r"\.", " ").where(between_open("ts", *window))
    return unpivot(named, [c for c in named.columns if c not in (*keys, "ts")], [*keys, "ts"])


def nitrate_with_airmass(
    record1: DataFrame, record2: DataFrame, sectors: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Daily nitrate of two records with the daily sectors, days of either side kept.

    The first record names its value ``nitrate_mg_m`` and is rounded to the
    nearest day before averaging.
    """
    first = record1.withColumn("ts", round_time("ts", "1 day"))
    first = time_average(first, "1 day", keys, cols=["nitrate_mg_m"]).withColumnsRenamed(
        {"nitrate_mg_m": "nitrate"}
    )
    second = time_average(record2, "1 day", keys, cols=["nitrate"])
    named = clean_names(sectors)
    daily = time_average(named, "1 day", keys, cols=numeric_columns(named, [*keys, "ts"]))
    return natural_full_join(union_by_name(first, second), daily)


def export_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sort_time(df, "ts", *keys)
