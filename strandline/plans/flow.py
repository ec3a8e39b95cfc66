"""Gas-flow checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from strandline.functions.timefn import round_time
from strandline.operators.columns import to_double
from strandline.operators.joins import left_join
from strandline.operators.reshape import unpivot
from strandline.operators.resample import time_average
from strandline.operators.stats import five_number, linear_fit
from strandline.plans.calibration import corrected_flow

# Fixed value: hours of the day shown in the flow summary.
FLOW_HOURS = (6, 19)


def flow_long(gas_flow: DataFrame) -> DataFrame:
    """Measured and corrected flow in long form."""
    return unpivot(corrected_flow(gas_flow), ["gas_flow", "gas_flow_corr"])


def flow_by_hour(flow_with_hour: DataFrame, tiebreak: str) -> DataFrame:
    """Box-plot summary of the corrected flow for the hours of interest."""
    day = flow_with_hour.where(flow_with_hour["hour"].between(*FLOW_HOURS))
    return five_number(corrected_flow(day), "gas_flow_corr", ["hour"], tiebreak)


def flow_vs_temperature(gas_flow: DataFrame, met: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hourly mean flow with the temperature record rounded to the hour."""
    hourly = time_average(
        corrected_flow(gas_flow), "1 hour", keys, cols=["gas_flow", "gas_flow_corr"]
    )
    temperature = met.withColumn("ts", round_time("ts", "1 hour")).select(*keys, "ts", "temp")
    return left_join(hourly, temperature, [*keys, "ts"])


def flow_calibration(check: DataFrame, setpoint: str, measured: Sequence[str]) -> DataFrame:
    """Line of each measured flow on the setpoint."""
    long = unpivot(check, measured, [setpoint])
    return linear_fit(long, setpoint, "value", ["name"])


def lab_flow(log: DataFrame, numbers: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Laboratory log: numbers read leniently, minutes rounded, 15-minute means."""
    clean = to_double(log, numbers).withColumn("ts", round_time("ts", "1 minute"))
    return time_average(clean, "15 min", keys, cols=numbers)
