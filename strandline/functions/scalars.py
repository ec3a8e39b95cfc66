"""Column functions for classification, masking, routing and rounding."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.timefn import as_col, stamp


def _value(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def first_match(arms: list[tuple[Column, Any]], default: Any = None) -> Column:
    """Value of the first arm whose condition is true; NULL counts as no match."""
    if not arms:
        return _value(default)
    out = F.when(arms[0][0], _value(arms[0][1]))
    for cond, value in arms[1:]:
        out = out.when(cond, _value(value))
    return out.otherwise(_value(default))


def two_way(cond: Column, yes: Any, no: Any) -> Column:
    """Two-way choice in which an unknown condition gives NULL, not ``no``."""
    return F.when(cond, _value(yes)).when(~cond, _value(no))


def mask_unless(cond: Column, value: Column | str) -> Column:
    """Keep the value where the condition holds, NULL elsewhere."""
    return F.when(cond, as_col(value))


def keep_codes(value: Column | str, flag: Column | str, codes: list[int]) -> Column:
    return F.when(as_col(flag).isin(codes), as_col(value))


def drop_codes(value: Column | str, flag: Column | str, codes: list[int]) -> Column:
    """NULL where the flag is one of ``codes`` or unknown."""
    return F.when(~as_col(flag).isin(codes), as_col(value))


def coalesce_fallback(*cols: Column | str) -> Column:
    return F.coalesce(*[as_col(c) for c in cols])


def split_at(value: Column | str, ts: Column | str, cut: str) -> tuple[Column, Column]:
    """(before, after) halves of a column; the row at the cut is in neither."""
    value, ts, cut = as_col(value), as_col(ts), stamp(cut)
    return F.when(ts < cut, value), F.when(ts > cut, value)


def round_half_even(x: Column | str, digits: int = 0) -> Column:
    return F.bround(as_col(x), digits)


def in_range(x: Column | str, low: Any, high: Any) -> Column:
    return as_col(x).between(low, high)


def null_if_nan(x: Column | str) -> Column:
    x = as_col(x)
    return F.when(~F.isnan(x), x)


def divide(num: Column | str, den: Column | str) -> Column:
    """Quotient that is NULL, not an error, where the denominator is zero."""
    return F.try_divide(as_col(num), as_col(den))
