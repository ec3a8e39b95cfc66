"""Joins with the null and naming rules of the covered work.

None of the equi-joins carries a broadcast hint: Catalyst chooses from the table
sizes, and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.timefn import to_micros
from strandline.operators.ordered import fill_down, fill_up
from strandline.session import stage


def _join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    marked = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    joined = left.join(marked, cond, how)
    keys = {c: F.col(c) for c in on}
    if how in ("full", "right"):
        keys = {c: F.coalesce(F.col(c), F.col(f"__r_{c}")) for c in on}
    order = [*left.columns, *[c for c in right.columns if c not in on]]
    return joined.select(*[keys[c].alias(c) if c in keys else F.col(f"`{c}`") for c in order])


def _suffixed(
    left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str]
) -> tuple[DataFrame, DataFrame]:
    clash = [c for c in left.columns if c in right.columns and c not in on]
    if not clash:
        return left, right
    return (
        left.withColumnsRenamed({c: c + suffixes[0] for c in clash}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in clash}),
    )


def left_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    null_safe: bool = True,
    suffixes: tuple[str, str] = (".x", ".y"),
) -> DataFrame:
    """Left join on named keys; repeated matches fan out, clashing names get suffixes.

    Missing keys match missing keys unless ``null_safe`` is off, which suits
    keys known to be present and lets the join reuse an existing partitioning.
    """
    on = [on] if isinstance(on, str) else list(on)
    left, right = _suffixed(left, right, on, suffixes)
    if null_safe:
        return _join_null_safe(left, right, on, "left")
    return left.join(right, on, "left")


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column to join on")
    return shared


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return _join_null_safe(left, right, common_columns(left, right), "left")


def natural_full_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return _join_null_safe(left, right, common_columns(left, right), "full")


def left_join_chain(
    frames: Sequence[DataFrame], on: str | Sequence[str], null_safe: bool = True
) -> DataFrame:
    """Left-join every further table onto the first one."""
    return reduce(lambda a, b: left_join(a, b, on, null_safe), frames)


def lookup_join(
    df: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    null_safe: bool = False,
) -> DataFrame:
    """Join a derived lookup table with unique keys.

    The table is staged first, so that it is computed once and its real size
    decides between a broadcast and a shuffle join.  With ``null_safe`` missing
    keys match missing keys.
    """
    on = [on] if isinstance(on, str) else list(on)
    if not on:
        return with_scalars(df, dim)
    staged = stage(dim, "lookup")
    return _join_null_safe(df, staged, on, how) if null_safe else df.join(staged, on, how)


def with_scalars(df: DataFrame, one_row: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Add the values of a one-row aggregate to every row, as scalar subqueries."""
    names = list(names or one_row.columns)
    return df.withColumns({n: one_row.select(n).scalar() for n in names})


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    ts: str = "ts",
    direction: str = "backward",
    tolerance_s: float | None = None,
    tie: Sequence[str] = (),
    matched: str | None = None,
) -> DataFrame:
    """Every row of ``left`` with ``cols`` of the right-hand row nearest in time on one side of it.

    ``backward`` takes the last right-hand row at or before the time, ``forward`` the first at
    or after it; both only within ``tolerance_s`` seconds, if given.  The row is taken whole: its missing values are not
    looked for further away.  Of right-hand rows at one time the last by ``tie`` counts (the first, forward), which must
    tell them apart.  Rows without a time have no match; series keys must be present.  ``matched`` names a column for
    the time of the match.

    A merge, not an equi-join: both sides are one tagged union, range-split by (keys, time), and the right-hand row
    is carried from chunk to chunk.  A row meets one value, so nothing fans out, and a series with most of the rows is
    split like any other.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction {direction!r} is neither backward nor forward")
    clash = [c for c in cols if c in left.columns]
    if clash:
        raise ValueError(f"columns {clash} are on both sides")
    back = direction == "backward"
    found = F.struct(F.col(ts).alias("__at"), *[F.col(c) for c in cols])
    ties = [F.col(c).alias(f"__tie{k}") for k, c in enumerate(tie)]
    mine = left.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in left.columns])).select(
        *keys, ts, F.lit(1 if back else 0).alias("__side"), "__row"
    )
    theirs = right.where(F.col(ts).isNotNull()).select(
        *keys, ts, F.lit(0 if back else 1).alias("__side"), *ties, found.alias("__found")
    )
    both = mine.unionByName(theirs, allowMissingColumns=True)
    fill = fill_down if back else fill_up
    near = fill(both, ["__found"], keys, [ts, "__side", *[f"__tie{k}" for k in range(len(tie))]]).where("__row is not null")
    at = F.col("__found.__at")
    gap = (to_micros(ts) - to_micros(at)) if back else (to_micros(at) - to_micros(ts))
    holds = F.col(ts).isNotNull() & at.isNotNull()
    if tolerance_s is not None:
        holds = holds & (gap <= int(tolerance_s * 1_000_000))
    taken = {c: F.when(holds, F.col(f"__found.`{c}`")) for c in cols}
    if matched:
        taken[matched] = F.when(holds, at)
    return near.select("__row.*", *[v.alias(c) for c, v in taken.items()])
