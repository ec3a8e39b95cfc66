"""Side-by-side tables of the zero methods and clean-air statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import drop_codes, keep_codes
from strandline.operators.reshape import unpivot
from strandline.operators.resample import time_average
from strandline.plans import pairs
from strandline.plans.calibration import pollution_label


def zero_comparison(both: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Anchors, baselines and zeroed signals of both methods, per row of ``zeroing.both_zeroes``.

    Zeroed signals are kept for unflagged rows only; ``period`` tells night
    from day.
    """
    chans = ("ch1", "ch2")
    parts = ("zeroes", "baseline", "zeroed")
    named = both.select(
        *keys, *order, *[F.col(f"night_{c}_{p}").alias(f"{c}_night_{p}") for p in parts for c in chans],
        "flag", *[drop_codes(c, "flag", [3]).alias(c) for c in chans],
        *[F.col(f"za_{c}_{p}").alias(f"{c}_{p}") for p in parts for c in chans],
    )
    masked = [f"{c}_{p}" for c in chans for p in ("zeroed", "night_zeroed")]
    hour = F.hour("ts")
    return named.withColumns({m: keep_codes(m, "flag", [0]) for m in masked}).withColumn(
        "period", F.when((hour <= 4) | (hour >= 21), "Nighttime").otherwise("Daytime")
    )


def zero_comparison_long(
    compared: DataFrame, keys: Sequence[str], columns: Sequence[str], every: str = "30 sec"
) -> DataFrame:
    """Averages on a fixed grid, in long form."""
    averaged = time_average(compared, every, keys, cols=columns)
    return unpivot(averaged, columns, [*keys, "ts"])


def clean_diurnal(
    night: DataFrame,
    zero_air: DataFrame,
    keys: Sequence[str],
    polluted: tuple[str, str] = ("2024-09-11", "2024-09-13 13:00"),
) -> DataFrame:
    """Mean, deviation and standard error by hour of day outside the polluted time.

    Statistics run over the joined rows of both series, which are not built.
    """
    left = [c for c in night.columns if c not in (*keys, "ts")]
    right = [c for c in zero_air.columns if c not in (*keys, "ts")]
    moments = pairs.paired_moments(night, zero_air, keys, left, right)
    clean = moments.where(pollution_label("ts", *polluted, closed=True) == "clean")
    return pairs.paired_hour_stats(clean, keys, [*left, *right])
