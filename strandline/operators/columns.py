"""Column selection, renaming, typing and derivation."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project(df: DataFrame, *keep: str, **renamed: str) -> DataFrame:
    """Select columns; ``new="old"`` renames on the way."""
    return df.select(*keep, *[F.col(f"`{old}`").alias(new) for new, old in renamed.items()])


def rename(df: DataFrame, **renamed: str) -> DataFrame:
    """``rename(df, new="old")`` keeps every other column and the order."""
    return df.withColumnsRenamed({old: new for new, old in renamed.items()})


def rename_matching(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    return df.toDF(*[re.sub(pattern, replacement, c) for c in df.columns])


def snake_case(names: Iterable[str]) -> list[str]:
    """Lower-case identifiers made of letters, digits and single underscores.

    ``%`` is spelt out, case changes split words, repeats get ``_2``, ``_3``.
    """
    seen: dict[str, int] = {}
    out = []
    for name in names:
        text = name.replace("%", "_percent_").replace("#", "_number_")
        text = re.sub(r"([a-z])([A-Z])", r"\1_\2", text)
        text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
        text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower() or "x"
        if text[0].isdigit():
            text = f"x{text}"
        seen[text] = seen.get(text, 0) + 1
        out.append(text if seen[text] == 1 else f"{text}_{seen[text]}")
    return out


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_case(df.columns))


def drop(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def span(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from ``first`` to ``last``, by position."""
    i, j = df.columns.index(first), df.columns.index(last)
    return df.columns[i : j + 1] if i <= j else df.columns[j : i + 1][::-1]


def everything_else(df: DataFrame, *named: str) -> list[str]:
    return [c for c in df.columns if c not in named]


def derive(df: DataFrame, *layers: Mapping[str, Column]) -> DataFrame:
    """Add columns layer by layer; a layer sees the columns of those before it."""
    for layer in layers:
        df = df.withColumns(dict(layer))
    return df


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def to_double(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Read columns as numbers; text that is no number gives NULL, as does NaN."""
    parsed = {c: F.col(f"`{c}`").try_cast("double") for c in names}
    return df.withColumns({c: F.when(~F.isnan(v), v) for c, v in parsed.items()})


def without_nan(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})
