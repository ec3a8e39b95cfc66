"""Gas flow, calibration factors by regime, and mixing ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.chem import (
    sampling_efficiency,
    standard_mixing_ratio,
    two_channel_ppt,
)
from strandline.functions.scalars import keep_codes
from strandline.functions.timefn import (
    between_closed,
    between_halfopen,
    between_open,
    round_time,
    shift_time,
)
from strandline.operators.intervals import micros, regime_of
from strandline.operators.joins import left_join, lookup_join, with_scalars
from strandline.operators.stats import conditional_means, hour_climatology, mean_of
from strandline.plans import campaign
from strandline.plans.campaign import Regime
from strandline.session import stage


def corrected_flow(gas_flow: DataFrame) -> DataFrame:
    return gas_flow.withColumn("gas_flow_corr", F.col("gas_flow") * campaign.FLOW_CORRECTION)


def mean_flow(flow: DataFrame) -> DataFrame:
    """One row with the overall mean; a single missing value makes it NULL."""
    return flow.agg(mean_of("gas_flow_corr", strict=True).alias("gas_flow_mean"))


def hourly_flow(flow: DataFrame) -> DataFrame:
    return hour_climatology(flow, ["gas_flow_corr"], strict=True)


def calibration_means(
    zeroed: DataFrame, regimes: Sequence[Regime], keys: Sequence[str]
) -> DataFrame:
    """Zero and standard signal of both channels, one row per series and regime.

    One pass serves every regime, and the scan is cut to the span of the windows.
    """
    windows = {}
    for r in regimes:
        windows[f"z{r.regime}"] = (r.zero_from, r.zero_to)
        windows[f"c{r.regime}"] = (r.cal_from, r.cal_to)
    first = min((a for a, _ in windows.values()), key=micros)
    last = max((b for _, b in windows.values()), key=micros)
    channels = ["ch1_zeroed", "ch2_zeroed"]
    wide = conditional_means(
        zeroed.where(between_open("ts", first, last)), windows, channels, keys
    )
    rows = [
        F.struct(
            F.lit(r.regime).alias("regime"),
            F.lit(r.conc_cal).alias("conc_cal"),
            F.lit(r.liquid_flow1).alias("liquid_flow1"),
            F.lit(r.liquid_flow2).alias("liquid_flow2"),
            *[F.col(f"z{r.regime}_{c}").alias(f"cal_zero_{c[:3]}") for c in channels],
            *[F.col(f"c{r.regime}_{c}").alias(f"cal_{c[:3]}") for c in channels],
        )
        for r in regimes
    ]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def _slopes(flow: str, suffix: str) -> dict:
    return {
        f"slope_ch{i}{suffix}": F.try_divide(
            standard_mixing_ratio("conc_cal", f"liquid_flow{i}", flow),
            F.col(f"cal_ch{i}") - F.col(f"cal_zero_ch{i}"),
        )
        for i in (1, 2)
    }


def calibration_factors(
    zeroed: DataFrame, gas_flow: DataFrame, regimes: Sequence[Regime], keys: Sequence[str]
) -> DataFrame:
    """Factors per series, regime and hour with a measured flow.

    Efficiency and slopes come twice: from the flow of that hour, and (suffix
    ``_constant``) from the overall mean flow.
    """
    flow = corrected_flow(gas_flow)
    means = with_scalars(calibration_means(zeroed, regimes, keys), mean_flow(flow))
    # every (series, regime) row meets every hour of the 24-row flow table
    hours = hourly_flow(flow).agg(F.collect_list(F.struct("hour", "gas_flow_corr")).alias("h"))
    spread = with_scalars(means, hours).withColumn("h", F.explode("h")).select("*", "h.*")
    return spread.withColumns(
        {
            "efficiency": sampling_efficiency("gas_flow_corr"),
            "efficiency_constant": sampling_efficiency("gas_flow_mean"),
            **_slopes("gas_flow_corr", ""),
            **_slopes("gas_flow_mean", "_constant"),
        }
    ).drop("h")


def concentrations(
    zeroed: DataFrame,
    gas_flow: DataFrame,
    regimes: Sequence[Regime],
    keys: Sequence[str],
    delay_s: float = campaign.TRANSPORT_DELAY_S,
    keep_input: bool = True,
) -> DataFrame:
    """Mixing ratios of both flow models at corrected times, rows in a regime only.

    ``zeroed`` is read for the factors and for the rows; ``keep_input`` stages it first, which
    is not worth it where it is a few lookups away from a staged table.

    Hours without a measured flow have no hourly factors.  The constant ones
    carry over from earlier rows of the regime, so they begin with the first
    row of a covered hour; that instant is an aggregate, no ordered scan.
    """
    zeroed = stage(zeroed, "zeroed") if keep_input else zeroed
    rows = regime_of(zeroed, campaign.regime_rules(regimes)).withColumn("hour", F.hour("ts"))
    flow = corrected_flow(gas_flow)
    hourly = hourly_flow(flow).withColumnsRenamed({"gas_flow_corr": "__flow"}).withColumn(
        "__covered", F.lit(True)
    )
    with_flow = lookup_join(rows, hourly, "hour")
    begins = with_flow.groupBy(*keys, "regime").agg(
        F.min(F.when(F.col("__covered"), F.col("ts"))).alias("__begin")
    )
    means = with_scalars(calibration_means(zeroed, regimes, keys), mean_flow(flow))
    factors = begins.join(means, [*keys, "regime"], "left").withColumns(
        {
            "efficiency_constant": sampling_efficiency("gas_flow_mean"),
            **_slopes("gas_flow_mean", "_constant"),
        }
    )
    joined = lookup_join(with_flow, factors, [*keys, "regime"]).withColumns(
        {"efficiency": sampling_efficiency("__flow"), **_slopes("__flow", "")}
    )
    begun = F.col("ts") >= F.col("__begin")
    constants = ["efficiency_constant", "slope_ch1_constant", "slope_ch2_constant"]
    joined = joined.withColumns({c: F.when(begun, F.col(c)) for c in constants})
    scaled = joined.withColumns(
        {
            f"ch{i}_ppt{s}": F.col(f"ch{i}_zeroed") * F.col(f"slope_ch{i}{s}")
            for s in ("", "_constant")
            for i in (1, 2)
        }
    )
    result = scaled.withColumns(
        {
            "hono": two_channel_ppt("ch1_ppt", "ch2_ppt", "efficiency"),
            "hono_constant": two_channel_ppt(
                "ch1_ppt_constant", "ch2_ppt_constant", "efficiency_constant"
            ),
            "ts": corrected_time("ts", delay_s),
        }
    )
    return result.drop(
        "__flow", "__covered", "__begin", "gas_flow_mean", "conc_cal", "liquid_flow1",
        "liquid_flow2", "cal_zero_ch1", "cal_zero_ch2", "cal_ch1", "cal_ch2",
    )


def corrected_time(ts: str, delay_s: float = campaign.TRANSPORT_DELAY_S):
    """Sampling time: the transport delay earlier, on the 30 s grid."""
    return round_time(shift_time(ts, -delay_s), "30 seconds")


def valid_series(conc: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Mixing ratios of unflagged rows as ``<name>`` and ``<name>_constant``."""
    return conc.select(
        *keys,
        "ts",
        keep_codes("hono", "flag", [0]).alias(name),
        keep_codes("hono_constant", "flag", [0]).alias(f"{name}_constant"),
    )


def combined_series(
    night: DataFrame,
    zero_air: DataFrame,
    keys: Sequence[str],
    polluted: tuple[str, str] = ("2024-09-11", "2024-09-13"),
) -> DataFrame:
    """Night and zero-air results side by side with a pollution label.

    Several rows may round to one time; they fan out and are kept.
    """
    joined = left_join(night, zero_air, [*keys, "ts"], null_safe=False)
    return joined.withColumn("local_pollution", pollution_label("ts", *polluted))


def pollution_label(ts: str, start: str, end: str, closed: bool = False):
    inside = (between_closed if closed else between_halfopen)(ts, start, end)
    return F.when(inside, "polluted").when(~inside, "clean")
