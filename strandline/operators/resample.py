"""Averages over time buckets and hour-of-day profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.timefn import floor_time
from strandline.operators.columns import numeric_columns


def vector_mean_degrees(direction: Column | str) -> Column:
    """Mean direction of unit vectors, in [0, 360)."""
    angle = F.radians(direction)
    mean = F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))))
    return F.pmod(mean + 360, F.lit(360.0))


def time_average(
    df: DataFrame,
    every: str,
    keys: Sequence[str] = (),
    ts: str = "ts",
    cols: Sequence[str] | None = None,
    wind: str | None = "wd",
) -> DataFrame:
    """Mean of every numeric column per time bucket, which is named by its start.

    Missing values are skipped, text columns dropped, and the column ``wind``
    (a direction in degrees) is averaged as a vector.
    """
    cols = list(cols or numeric_columns(df, exclude=[*keys, ts]))
    aggs = [
        (vector_mean_degrees(F.col(c)) if c == wind else F.avg(c)).alias(c) for c in cols
    ]
    bucket = floor_time(ts, every)
    return df.where(F.col(ts).isNotNull()).groupBy(*keys, bucket.alias(ts)).agg(*aggs)


def diurnal_profile(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Mean and 95 % interval by hour of day, one row per hour and variable.

    All variables are reduced in one pass before the result is made long.
    """
    aggs = []
    for c in cols:
        aggs += [
            F.avg(c).alias(f"__m_{c}"),
            F.stddev_samp(c).alias(f"__s_{c}"),
            F.count(c).alias(f"__n_{c}"),
        ]
    wide = df.groupBy(*keys, F.hour(ts).alias("hour")).agg(*aggs)
    half = {
        c: 1.96 * F.try_divide(F.col(f"__s_{c}"), F.sqrt(f"__n_{c}")) for c in cols
    }
    long = wide.select(
        *keys,
        "hour",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("variable"),
                        F.col(f"__m_{c}").alias("mean"),
                        (F.col(f"__m_{c}") - half[c]).alias("lower"),
                        (F.col(f"__m_{c}") + half[c]).alias("upper"),
                        F.col(f"__n_{c}").alias("n"),
                    )
                    for c in cols
                ]
            )
        ).alias("p"),
    )
    return long.select(*keys, "hour", "p.*")


#: 2^32 times the cumulative Poisson probabilities of mean 1, as eight hexadecimal digits.
POISSON = ("5e2d58d8", "bc5ab1b1", "eb715e1d", "fb239797", "ff1025f5", "ffd90f3b", "fffa8b71", "ffff540c", "ffffed1f")


def poisson_weight(row: Column, replicate: Column, seed: int) -> Column:
    """How often a bootstrap replicate draws a row: Poisson of mean 1, from a hash of seed, row and replicate."""
    draw = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), replicate.cast("string"))), 1, 8)
    return reduce(lambda a, b: a + b, [(draw >= F.lit(t)).cast("int") for t in POISSON])


def diurnal_bootstrap(
    df: DataFrame,
    col: str,
    row_id: str,
    keys: Sequence[str] = (),
    ts: str = "ts",
    replicates: int = 200,
    level: float = 0.95,
    seed: int = 1,
) -> DataFrame:
    """Mean by hour of day with a bootstrapped interval: ``hour``, ``mean``, ``lower``, ``upper``, ``n``.

    Each replicate draws every row a Poisson number of times, fixed by a hash of the row's id, so that
    a row has the same weights however the data are dealt out, and a replicate is two
    sums that combine before the shuffle.  The interval is made of quantiles of the
    replicates' means, of which there are ``replicates`` in a group, whatever its size.  Missing values are left out;
    a replicate that draws nothing has no mean.
    """
    by = [*keys, "hour"]
    known = df.where(F.col(col).isNotNull()).select(
        *keys, F.hour(ts).alias("hour"), F.col(row_id).alias("__row"), F.col(col).alias("__v")
    )
    drawn = known.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    weight = poisson_weight(F.col("__row"), F.col("__b"), seed)
    sums = (
        drawn.withColumn("__w", weight)
        .groupBy(*by, "__b")
        .agg(F.sum(F.col("__w") * F.col("__v")).alias("__s"), F.sum("__w").alias("__k"), F.sum("__v").alias("__all"), F.count("*").alias("n"))
    )
    tail = (1 - level) / 2
    mean = F.try_divide(F.col("__s"), F.col("__k").cast("double"))
    return sums.groupBy(*by).agg(
        (F.max_by("__all", -F.col("__b")) / F.max("n")).alias("mean"),
        F.percentile(mean, tail).alias("lower"),
        F.percentile(mean, 1 - tail).alias("upper"),
        F.max("n").alias("n"),
    )
