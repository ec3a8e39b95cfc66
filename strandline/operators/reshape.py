"""Unions, long forms and sorted outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of all tables; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unpivot(
    df: DataFrame,
    values: Sequence[str],
    ids: Sequence[str] | None = None,
    name: str = "name",
    value: str = "value",
) -> DataFrame:
    """One row per value column, NULLs kept; ``ids`` default to all other columns."""
    keep = list(ids) if ids is not None else [c for c in df.columns if c not in set(values)]
    return df.unpivot(keep, list(values), name, value)


def unpivot_paired(
    df: DataFrame,
    ids: Sequence[str],
    variants: Mapping[str, Mapping[str, str]],
    variant: str = "name",
    quantity: str = "quantity",
    value: str = "value",
    along: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Long form of quantities measured in several variants.

    ``variants`` maps a variant to ``{quantity: column}``.  One generator emits
    exactly the wanted rows; unpivoting twice and keeping the matching names
    would build every pair of quantities first.  ``along`` maps a variant to
    ``{new column: column}`` whose values go with each of its rows.
    """
    cells = [
        F.struct(
            F.lit(v).alias(variant),
            F.lit(q).alias(quantity),
            F.col(c).cast("double").alias(value),
            *[F.col(x).cast("double").alias(name) for name, x in (along or {}).get(v, {}).items()],
        )
        for v, columns in variants.items()
        for q, c in columns.items()
    ]
    return df.select(*ids, F.explode(F.array(*cells)).alias("__cell")).select(*ids, "__cell.*")


def sort_time(df: DataFrame, *order: str) -> DataFrame:
    """Global time order, for output only."""
    return df.orderBy(*order)


def last_rows(df: DataFrame, order: Sequence[str], n: int = 6) -> DataFrame:
    """The ``n`` latest rows, taken per task before they are merged."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
