"""Run tables and run midpoints on top of ``ordered.run_ids``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.joins import lookup_join
from strandline.operators.ordered import run_ids
from strandline.operators.stats import mean_of, three_sd_of


def run_length_encode(
    df: DataFrame, code: str, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """One row per run: number, value, length, first and last row, first and last time."""
    ts = order[0]
    return (
        run_ids(df, code, keys, order)
        .groupBy(*keys, "run_no")
        .agg(
            F.min(code).alias("value"),
            F.count(F.lit(1)).alias("length"),
            F.min("idx").alias("idx_start"),
            F.max("idx").alias("idx_end"),
            F.min(ts).alias("start_ts"),
            F.max(ts).alias("end_ts"),
        )
    )


def event_runs(runs: DataFrame, value: str = "value") -> DataFrame:
    """Keep the runs of a non-zero code."""
    return runs.where(F.col(value) != 0)


#: Row numbers that are made from one row at a time.
BLOCK = 1 << 16


def expand_runs(runs: DataFrame, keys: Sequence[str], id_col: str = "run_no") -> DataFrame:
    """One row per row number covered by a run.

    A run is cut into blocks first, which are dealt out: no array and no task
    grows with the length of a run.
    """
    first, last = F.col("idx_start"), F.col("idx_end")
    blocks = runs.select(
        *keys,
        F.col(id_col).alias("id"),
        "idx_start",
        "idx_end",
        F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))).alias("__block"),
    ).repartition(*keys, "id", "__block")
    low, high = F.col("__block") * BLOCK, F.col("__block") * BLOCK + (BLOCK - 1)
    return blocks.select(
        *keys, F.explode(F.sequence(F.greatest(first, low), F.least(last, high))).alias("idx"), "id"
    )


def run_averages(
    numbered: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    strict: bool | Column = False,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Mean, three-sigma and middle row of every event run.

    The middle is the mean row number of the run, rounded half to even.  With
    ``strict`` a single missing value leaves the whole run without a mean.
    ``extra`` aggregates are taken along in the same pass.
    """
    stats = []
    for c in cols:
        stats += [
            mean_of(c, strict).alias(f"{c}_zeroes"),
            three_sd_of(c, strict).alias(f"{c}_zero_3sd"),
        ]
    middle = F.bround((F.min("idx") + F.max("idx")) / F.lit(2.0), 0).cast("bigint")
    return (
        numbered.where(F.col("run_id") != 0)
        .groupBy(*keys, "run_id")
        .agg(*stats, middle.alias("idx"), F.count(F.lit(1)).alias("run_rows"), *extra)
    )


def midpoint_anchors(
    numbered: DataFrame, cols: Sequence[str], keys: Sequence[str], strict: bool = False
) -> DataFrame:
    """Put each event run's means on its middle row; other rows get NULL."""
    means = run_averages(numbered, cols, keys, strict).drop("run_id", "run_rows")
    return lookup_join(numbered, means, [*keys, "idx"])
