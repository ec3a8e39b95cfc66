"""Statistics of a many-to-many time join without building its rows.

After rounding, several rows of either series can share one time, and their
join holds every pair.  Means and deviations over those pairs only need, per
time, the moments of each side and the number of partners on the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.timefn import floor_time
from strandline.operators.joins import left_join, lookup_join


def _moments(df: DataFrame, on: Sequence[str], cols: Sequence[str], rows: str) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}__n"),
            F.avg(c).alias(f"{c}__mean"),
            (F.var_pop(c) * F.count(c)).alias(f"{c}__m2"),
        ]
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias(rows), *aggs)


def paired_moments(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_cols: Sequence[str],
    right_cols: Sequence[str],
) -> DataFrame:
    """One row per (keys, ts) with the moments over the rows of the left join."""
    on = [*keys, "ts"]
    both = left_join(
        _moments(left, on, left_cols, "__l"),
        _moments(right, on, right_cols, "__r"),
        on,
        null_safe=False,
    )
    partners = F.greatest(F.coalesce(F.col("__r"), F.lit(0)), F.lit(1))
    weight = dict.fromkeys(left_cols, partners) | dict.fromkeys(right_cols, F.col("__l"))
    scaled = {"pairs": F.col("__l") * partners}
    for c, w in weight.items():
        scaled |= {f"{c}__n": F.col(f"{c}__n") * w, f"{c}__m2": F.col(f"{c}__m2") * w}
    return both.withColumns(scaled).drop("__l", "__r")


def _pooled_mean(c: str) -> Column:
    n = F.col(f"{c}__n")
    return F.try_divide(F.sum(n * F.col(f"{c}__mean")), F.sum(n))


def paired_average(
    moments: DataFrame, every: str, keys: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Mean over all pairs per time bucket."""
    bucket = floor_time("ts", every)
    return moments.groupBy(*keys, bucket.alias("ts")).agg(*[_pooled_mean(c).alias(c) for c in cols])


def paired_hour_stats(moments: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean, deviation and standard error over all pairs by hour of day."""
    by = [*keys, "hour"]
    hourly = moments.withColumn("hour", F.hour("ts"))
    means = hourly.groupBy(*by).agg(*[_pooled_mean(c).alias(f"{c}_mean") for c in cols])
    centred = lookup_join(hourly, means, by)
    aggs = []
    for c in cols:
        n, off = F.col(f"{c}__n"), F.col(f"{c}__mean") - F.col(f"{c}_mean")
        squares = F.sum(F.col(f"{c}__m2") + n * off * off)
        total = F.sum(n)
        aggs += [
            F.max(f"{c}_mean").alias(f"{c}_mean"),
            F.sqrt(F.when(total > 1, squares / (total - 1))).alias(f"{c}_sd"),
        ]
    out = centred.groupBy(*by).agg(F.sum("pairs").alias("__pairs"), *aggs)
    return out.withColumns(
        {f"{c}_se": F.col(f"{c}_sd") / F.sqrt("__pairs") for c in cols}
    ).drop("__pairs")
