"""Settings of the September 2024 field campaign, and how to build such settings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from strandline.operators.intervals import Rule, moved, parse_rules
from strandline.sources.files import LogWindow

# Quality flags, "start | end | code", open bounds, first match
# wins (1 zero, 2 calibration, 3 issue, otherwise 0 good).
FLAG_TEXT = """
                 | 2024-09-06       | 3
2024-09-06 14:45 | 2024-09-06 15:28 | 1
2024-09-06 21:00 | 2024-09-06 21:29 | 1
2024-09-07 15:00 | 2024-09-07 17:00 | 3
2024-09-07 22:30 | 2024-09-07 23:15 | 1
2024-09-07 23:40 | 2024-09-08 10:45 | 3
2024-09-08 10:45 | 2024-09-08 11:45 | 1
2024-09-08 15:00 | 2024-09-08 16:00 | 3
2024-09-08 17:15 | 2024-09-08 18:40 | 1
2024-09-08 23:30 | 2024-09-09 00:15 | 1
2024-09-09 05:50 | 2024-09-09 13:15 | 3
2024-09-09 13:15 | 2024-09-09 13:50 | 1
2024-09-09 14:40 | 2024-09-09 18:15 | 2
2024-09-09 23:45 | 2024-09-10 00:25 | 1
2024-09-10 06:00 | 2024-09-10 06:40 | 1
2024-09-10 12:15 | 2024-09-10 13:00 | 1
2024-09-10 15:00 | 2024-09-10 17:00 | 3
2024-09-10 18:30 | 2024-09-10 19:15 | 1
2024-09-10 21:30 | 2024-09-11 14:45 | 3
2024-09-11 17:00 | 2024-09-11 18:45 | 3
2024-09-11 18:45 | 2024-09-11 19:25 | 1
2024-09-12 01:00 | 2024-09-12 01:45 | 1
2024-09-12 07:15 | 2024-09-12 08:15 | 1
2024-09-12 12:20 | 2024-09-12 14:30 | 3
2024-09-12 14:30 | 2024-09-12 15:10 | 1
2024-09-12 20:45 | 2024-09-12 21:20 | 1
2024-09-13 03:00 | 2024-09-13 03:40 | 1
2024-09-13 09:15 | 2024-09-13 10:00 | 1
2024-09-13 14:00 | 2024-09-13 16:00 | 2
2024-09-13 17:45 | 2024-09-13 18:50 | 1
2024-09-14 00:15 | 2024-09-14 01:00 | 1
2024-09-14 06:30 | 2024-09-14 08:17 | 1
2024-09-14 08:17 | 2024-09-14 10:15 | 2
2024-09-14 13:00 | 2024-09-14 13:45 | 1
2024-09-14 19:15 | 2024-09-14 19:55 | 1
2024-09-15 01:30 | 2024-09-15 02:15 | 1
2024-09-15 07:45 | 2024-09-15 08:30 | 1
2024-09-15 14:00 | 2024-09-15 14:51 | 1
2024-09-15 20:15 | 2024-09-15 21:00 | 1
2024-09-15 23:55 | 2024-09-16 16:40 | 3
2024-09-16 17:40 | 2024-09-16 18:30 | 1
2024-09-17 00:00 | 2024-09-17 00:40 | 1
2024-09-17 06:15 | 2024-09-17 06:55 | 1
2024-09-17 12:30 | 2024-09-17 13:15 | 1
2024-09-17 18:45 | 2024-09-17 19:25 | 1
2024-09-18 01:05 | 2024-09-18 01:41 | 1
2024-09-18 07:20 | 2024-09-18 08:03 | 1
2024-09-18 13:00 |                  | 1
"""

# Zero-air periods, "start | end | code" (codes 1 to 3 are the
# successive settings of the zero-air supply).
ZERO_AIR_TEXT = """
2024-09-05 17:45 | 2024-09-05 18:17 | 1
2024-09-06 14:55 | 2024-09-06 15:15 | 1
2024-09-06 21:10 | 2024-09-06 21:47 | 1
2024-09-07 16:30 | 2024-09-07 16:44 | 1
2024-09-07 22:40 | 2024-09-07 23:00 | 1
2024-09-08 05:00 | 2024-09-08 05:15 | 1
2024-09-08 11:15 | 2024-09-08 11:30 | 1
2024-09-08 17:28 | 2024-09-08 17:48 | 1
2024-09-08 23:45 | 2024-09-09 00:03 | 1
2024-09-09 05:58 | 2024-09-09 06:10 | 1
2024-09-09 13:25 | 2024-09-09 13:38 | 1
2024-09-09 17:40 | 2024-09-09 18:00 | 1
2024-09-09 23:55 | 2024-09-10 00:15 | 1
2024-09-10 06:10 | 2024-09-10 06:30 | 1
2024-09-10 12:25 | 2024-09-10 12:40 | 1
2024-09-11 00:56 | 2024-09-11 01:20 | 1
2024-09-11 07:12 | 2024-09-11 07:35 | 1
2024-09-11 13:50 | 2024-09-11 14:10 | 1
2024-09-11 13:47 | 2024-09-11 14:20 | 1
2024-09-11 17:25 | 2024-09-11 17:40 | 1
2024-09-11 18:55 | 2024-09-11 19:15 | 2
2024-09-12 01:15 | 2024-09-12 01:30 | 2
2024-09-12 07:29 | 2024-09-12 07:48 | 2
2024-09-12 14:45 | 2024-09-12 14:57 | 2
2024-09-12 21:00 | 2024-09-12 21:15 | 2
2024-09-13 03:15 | 2024-09-13 03:30 | 2
2024-09-13 09:30 | 2024-09-13 09:45 | 2
2024-09-13 18:20 | 2024-09-13 18:28 | 2
2024-09-14 00:25 | 2024-09-14 00:45 | 2
2024-09-14 06:40 | 2024-09-14 07:00 | 2
2024-09-14 08:17 | 2024-09-14 09:00 | 3
2024-09-14 13:10 | 2024-09-14 13:28 | 3
2024-09-14 19:35 | 2024-09-14 19:45 | 3
2024-09-15 01:43 | 2024-09-15 02:01 | 3
2024-09-15 07:57 | 2024-09-15 08:17 | 3
2024-09-15 14:15 | 2024-09-15 14:33 | 3
2024-09-15 20:30 | 2024-09-15 20:47 | 3
2024-09-16 17:55 | 2024-09-16 18:15 | 3
2024-09-17 00:13 | 2024-09-17 00:30 | 3
2024-09-17 06:28 | 2024-09-17 06:44 | 3
2024-09-17 12:43 | 2024-09-17 13:01 | 3
2024-09-17 19:00 | 2024-09-17 19:17 | 3
2024-09-18 01:17 | 2024-09-18 01:35 | 3
2024-09-18 07:35 | 2024-09-18 07:50 | 3
2024-09-18 13:15 | 2024-09-18 13:32 | 3
"""

# Nights whose data must not serve as a zero.
BAD_NIGHT_TEXT = """
2024-09-11 20:00 | 2024-09-12 05:00 | 1
"""

# Valid part of each raw log, open bounds.
LOG_WINDOWS = [
    LogWindow("old_inlet_water_sep05.dat", "2024-09-05 17:45", "2024-09-05 20:15"),
    LogWindow("reagents01.dat", None, "2024-09-06 15:28"),
    LogWindow("reagents02.dat", None, "2024-09-06 21:30"),
    LogWindow("water_sep07.dat", "2024-09-07 16:15", None),
]

# Scalar settings.
TRANSPORT_DELAY_S = 22.52 * 60
STANDARD_CONC = 1000 / 100000
FLOW_CORRECTION = 0.9
NIGHT_LAST_HOUR = 4
NIGHT_FIRST_HOUR = 21
DAYTIME_HOURS = (11, 15)
OH_HOURS = (8, 19)
ANCHOR_CUTOVER = "2024-09-16 02:00"
BASELINE_CUTOVER = "2024-09-16"


@dataclass(frozen=True)
class Regime:
    """A calibration period: validity, zero and standard windows, flows."""

    regime: int
    start: str | None
    end: str | None
    zero_from: str
    zero_to: str
    cal_from: str
    cal_to: str
    liquid_flow1: float
    liquid_flow2: float
    conc_cal: float = STANDARD_CONC


# Calibration regimes with the liquid flows of the zero-air run.
REGIMES = [
    Regime(
        0, None, "2024-09-11",
        "2024-09-09 14:53", "2024-09-09 15:05", "2024-09-09 15:47", "2024-09-09 16:04",
        5 / 26.55, 5 / 27.48,
    ),
    Regime(
        1, "2024-09-11", "2024-09-14 08:17",
        "2024-09-13 14:22", "2024-09-13 14:35", "2024-09-13 15:05", "2024-09-13 15:23",
        5 / 26.55, 5 / 27.48,
    ),
    Regime(
        2, "2024-09-14 08:17", None,
        "2024-09-14 08:17", "2024-09-14 09:00", "2024-09-14 09:17", "2024-09-14 09:35",
        5 / 27.73, 5 / 29.73,
    ),
]


def flag_rules(shift_days: int = 0) -> list[Rule]:
    return parse_rules(FLAG_TEXT, shift_days)


def zero_air_rules(shift_days: int = 0) -> list[Rule]:
    return parse_rules(ZERO_AIR_TEXT, shift_days)


def bad_night_rules(shift_days: int = 0) -> list[Rule]:
    return parse_rules(BAD_NIGHT_TEXT, shift_days)


def regime_rules(regimes: Sequence[Regime]) -> list[Rule]:
    return [Rule(r.start, r.end, r.regime) for r in regimes]


def regimes(shift_days: int = 0, liquid_flows: tuple[float, float] | None = None) -> list[Regime]:
    """The campaign's regimes, moved by whole days, optionally with one pair of flows."""
    out = []
    for r in REGIMES:
        times = [moved(t, shift_days) for t in (r.zero_from, r.zero_to, r.cal_from, r.cal_to)]
        flows = liquid_flows or (r.liquid_flow1, r.liquid_flow2)
        out.append(
            Regime(
                r.regime, moved(r.start, shift_days), moved(r.end, shift_days), *times, *flows,
                r.conc_cal,
            )
        )
    return out
