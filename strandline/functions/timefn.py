"""Column functions on timestamps (TIMESTAMP_NTZ, read as UTC)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_MICROS = {
    "sec": 1_000_000,
    "second": 1_000_000,
    "min": 60_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def duration_micros(every: str) -> int:
    """``"30 sec"``, ``"15 min"``, ``"1 hour"``, ``"1 day"`` in microseconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", every.lower())
    if not m or m.group(2) not in _UNIT_MICROS:
        raise ValueError(f"unknown duration {every!r}")
    return int(m.group(1)) * _UNIT_MICROS[m.group(2)]


def to_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 on the wall clock; the session's zone plays no part."""
    since = as_col(ts).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("bigint")


def from_micros(us: Column) -> Column:
    seconds = (us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def concat_datetime(date: Column | str, time: Column | str) -> Column:
    return F.concat_ws(" ", as_col(date), as_col(time))


def parse_datetime(text: Column | str, layout: str) -> Column:
    """Read a date-time of known field order, whatever its separators.

    ``layout`` lists the fields, such as ``dmy_hms``, ``mdy_hm`` or ``ymd``.
    Two-digit years up to 68 fall in the 2000s. Text that does not hold
    exactly these fields, or no real date, gives NULL.
    """
    fields = layout.replace("_", "")
    if not re.fullmatch(r"(dmy|mdy|ymd)(hms?)?", fields):
        raise ValueError(f"unknown layout {layout!r}")
    text = as_col(text)
    numbers = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    # "date" fields are d, m, y; a second "m" is minutes
    names = ["day" if f == "d" else "month" if f == "m" else "year" for f in fields[:3]]
    names += [{"h": "hour", "m": "minute", "s": "second"}[f] for f in fields[3:]]
    at = {name: F.get(numbers, F.lit(i)) for i, name in enumerate(names)}

    whole = F.size(numbers) == len(names)
    second = F.lit("0")
    if "second" in at:
        fraction = text.rlike(r"\d\.\d{1,6}\D*$") & (F.size(numbers) == len(names) + 1)
        second = F.when(
            fraction, F.concat(at["second"], F.lit("."), F.get(numbers, F.lit(len(names))))
        ).otherwise(at["second"])
        whole = whole | fraction

    year = at["year"].try_cast("int")
    year = F.when(F.length(at["year"]) > 2, year).otherwise(
        F.when(year <= 68, year + 2000).otherwise(year + 1900)
    )
    zero = F.lit(0)
    stamp = F.try_make_timestamp_ntz(
        year,
        at["month"].try_cast("int"),
        at["day"].try_cast("int"),
        at["hour"].try_cast("int") if "hour" in at else zero,
        at["minute"].try_cast("int") if "minute" in at else zero,
        second.try_cast("decimal(16,6)"),
    )
    return F.when(whole, stamp)


def extract_hour(ts: Column | str) -> Column:
    return F.hour(as_col(ts))


def extract_day(ts: Column | str) -> Column:
    return F.dayofmonth(as_col(ts))


def floor_time(ts: Column | str, every: str) -> Column:
    width = F.lit(duration_micros(every))
    us = to_micros(ts)
    return from_micros(us - F.pmod(us, width))


def round_time(ts: Column | str, every: str) -> Column:
    """Nearest multiple of ``every``; a tie goes to the later one."""
    width = duration_micros(every)
    us = to_micros(ts) + F.lit(width // 2)
    return from_micros(us - F.pmod(us, F.lit(width)))


def shift_time(ts: Column | str, seconds: float) -> Column:
    """Move a timestamp by ``seconds`` (negative for earlier), to the microsecond."""
    return from_micros(to_micros(ts) + F.lit(round(seconds * 1_000_000)))


def stamp(text: str) -> Column:
    """Timestamp literal; a date alone means its midnight."""
    return F.lit(text).cast("timestamp_ntz")


def between_open(ts: Column | str, start: str | None = None, end: str | None = None) -> Column:
    """``start < ts < end``; a bound of None is open-ended."""
    return _bounds(ts, start, end, lambda t, s: t > s, lambda t, e: t < e)


def between_halfopen(ts: Column | str, start: str | None = None, end: str | None = None) -> Column:
    return _bounds(ts, start, end, lambda t, s: t >= s, lambda t, e: t < e)


def between_closed(ts: Column | str, start: str | None = None, end: str | None = None) -> Column:
    return _bounds(ts, start, end, lambda t, s: t >= s, lambda t, e: t <= e)


def _bounds(ts, start, end, low, high) -> Column:
    ts = as_col(ts)
    tests = []
    if start is not None:
        tests.append(low(ts, stamp(start)))
    if end is not None:
        tests.append(high(ts, stamp(end)))
    if not tests:
        return F.lit(True)
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]
