"""Aggregates: strict and lenient moments, conditional means, fits, quartiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.timefn import as_col, between_open
from strandline.operators.columns import numeric_columns
from strandline.operators.joins import lookup_join
from strandline.operators.ordered import row_index
from strandline.session import stage


def _complete(c: Column, value: Column) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), value)


def _if_strict(c: Column, value: Column, strict: bool | Column) -> Column:
    """``strict`` may be a column of the grouping, so that groups differ in it."""
    if isinstance(strict, Column):
        return F.when(strict, _complete(c, value)).otherwise(value)
    return _complete(c, value) if strict else value


def mean_of(c: Column | str, strict: bool | Column = False) -> Column:
    """Mean; with ``strict`` NULL as soon as one value is missing."""
    c = as_col(c)
    return _if_strict(c, F.avg(c), strict)


def sd_of(c: Column | str, strict: bool | Column = False) -> Column:
    """Sample standard deviation; NULL for fewer than two values."""
    c = as_col(c)
    return _if_strict(c, F.stddev_samp(c), strict)


def three_sd_of(c: Column | str, strict: bool | Column = False) -> Column:
    return sd_of(c, strict) * 3


def global_means(df: DataFrame, cols: Sequence[str], strict: bool = False) -> DataFrame:
    return df.agg(*[mean_of(c, strict).alias(c) for c in cols])


def group_mean_sd(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [mean_of(c).alias(f"{c}_mean"), three_sd_of(c).alias(f"{c}_3sd")]
    return df.groupBy(*keys).agg(*aggs)


def conditional_means(
    df: DataFrame,
    windows: Mapping[str, tuple[str, str]],
    cols: Sequence[str],
    keys: Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """Mean of each column inside each open time window, in one pass.

    Column ``<window>_<col>``; a window without values gives NULL.
    """
    aggs = [
        F.avg(F.when(between_open(ts, a, b), F.col(c))).alias(f"{name}_{c}")
        for name, (a, b) in windows.items()
        for c in cols
    ]
    return df.groupBy(*keys).agg(*aggs)


def hour_climatology(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = (),
    ts: str = "ts",
    strict: bool = False,
) -> DataFrame:
    return (
        df.withColumn("hour", F.hour(ts))
        .groupBy(*keys, "hour")
        .agg(*[mean_of(c, strict).alias(c) for c in cols])
    )


def fanout_stats(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None
) -> DataFrame:
    """``<col>_mean``, ``_sd`` and ``_se`` of every numeric column.

    The standard error divides by the root of all rows of the group, missing
    values included.
    """
    cols = list(cols or numeric_columns(df, exclude=keys))
    aggs = []
    for c in cols:
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_sd"),
            (F.stddev_samp(c) / F.sqrt(F.count(F.lit(1)))).alias(f"{c}_se"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def linear_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` with the usual coefficient table."""
    sums = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("__sxx"),
        F.regr_syy(y, x).alias("__syy"),
        F.regr_sxy(y, x).alias("__sxy"),
        F.regr_avgx(y, x).alias("__mx"),
    )
    rss = F.greatest(F.col("__syy") - F.col("slope") * F.col("__sxy"), F.lit(0.0))
    variance = F.when(F.col("n") > 2, F.try_divide(rss, F.col("n") - 2))
    slope_se = F.sqrt(F.try_divide(variance, F.col("__sxx")))
    intercept_se = F.sqrt(
        variance
        * (
            F.try_divide(F.lit(1.0), F.col("n"))
            + F.try_divide(F.col("__mx") * F.col("__mx"), F.col("__sxx"))
        )
    )
    return sums.select(
        *keys,
        "n",
        "slope",
        "intercept",
        "r2",
        F.sqrt(variance).alias("residual_se"),
        slope_se.alias("slope_se"),
        intercept_se.alias("intercept_se"),
        F.try_divide(F.col("slope"), slope_se).alias("slope_t"),
        F.try_divide(F.col("intercept"), intercept_se).alias("intercept_t"),
    )


def exact_quantiles(
    df: DataFrame, value: str, keys: Sequence[str], points: Mapping[str, float], tiebreak: str
) -> DataFrame:
    """Exact interpolated quantiles per group, from ranks over split groups.

    A group of any size is ranked across the cluster; only the one or two rows
    around each quantile take part in the final aggregate.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, value, tiebreak)
    ranked = row_index(known, keys, [value, tiebreak], out="__rank")
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    placed = lookup_join(ranked, sizes, list(keys))
    below = F.col("__rank") - 1
    aggs = [F.max("__n").alias("n")]
    near = F.lit(False)
    for name, p in points.items():
        at = (F.col("__n") - 1) * F.lit(float(p))
        near = near | below.isin(F.floor(at), F.ceil(at))
        low = F.max(F.when(below == F.floor(at), F.col(value)))
        high = F.max(F.when(below == F.ceil(at), F.col(value)))
        weight = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * weight).alias(name))
    return placed.where(near).groupBy(*keys).agg(*aggs)


def five_number(df: DataFrame, value: str, keys: Sequence[str], tiebreak: str) -> DataFrame:
    """Box-plot summary: quartiles, 1.5 IQR whiskers and number of outliers."""
    quartiles = stage(
        exact_quantiles(
            df, value, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75}, tiebreak
        ),
        "quartiles",
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    joined = lookup_join(df, quartiles, list(keys), "inner")
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    whiskers = joined.groupBy(*keys).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count(F.when(~inside, F.col(value))).alias("outliers"),
    )
    return lookup_join(quartiles, whiskers, list(keys))


def impute_group_mean(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], ts: str = "ts"
) -> DataFrame:
    """Replace missing values by the mean of the same hour of day and series.

    The means come from a partial aggregate and are looked up again; a window
    per group would put a whole (series, hour) group into one task.  Rows without
    a key or a time are a group of their own, as missing matches missing.
    """
    with_hour = df.withColumn("__hour", F.hour(ts))
    means = with_hour.groupBy(*keys, "__hour").agg(*[F.avg(c).alias(f"__avg_{c}") for c in cols])
    joined = lookup_join(with_hour, means, [*keys, "__hour"], null_safe=True)
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__avg_{c}")) for c in cols}).drop(
        "__hour", *[f"__avg_{c}" for c in cols]
    )
