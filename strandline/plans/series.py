"""From raw channels to calibrated series: the whole chain in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.intervals import Rule
from strandline.plans import calibration, campaign, comparison, zeroing
from strandline.plans.campaign import Regime
from strandline.plans.zeroing import Cutover
from strandline.session import stage


@dataclass(frozen=True)
class Settings:
    """Everything the chain needs to know besides the data."""

    flags: Sequence[Rule] = field(default_factory=campaign.flag_rules)
    zero_air: Sequence[Rule] = field(default_factory=campaign.zero_air_rules)
    bad_nights: Sequence[Rule] = field(default_factory=campaign.bad_night_rules)
    regimes: Sequence[Regime] = field(default_factory=campaign.regimes)
    cutover: Cutover = Cutover()
    delay_s: float = campaign.TRANSPORT_DELAY_S
    polluted: tuple[str, str] = ("2024-09-11", "2024-09-13")


def zeroed_both(
    raw: DataFrame, keys: Sequence[str], order: Sequence[str], settings: Settings
) -> DataFrame:
    """Rows zeroed by night values (``night_``) and by zero air (``za_``); they are put in order and numbered once."""
    flagged = zeroing.flag_quality(raw, settings.flags)
    return zeroing.both_zeroes(flagged, keys, order, settings.bad_nights, settings.zero_air, settings.cutover)


def calibrated(
    raw: DataFrame,
    gas_flow: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    settings: Settings,
) -> tuple[DataFrame, DataFrame]:
    """Night and zero-air mixing ratios of the unflagged rows.

    Both are series of one table, told apart by one more key, so that factors come from one pass.
    """
    both = zeroed_both(raw, keys, order, settings)
    names = {"hono_night": "night_", "hono_za": "za_"}
    each = [
        F.struct(F.lit(name).alias("__method"), *[F.col(f"{p}{c}_zeroed").alias(f"{c}_zeroed") for c in ("ch1", "ch2")])
        for name, p in names.items()
    ]
    long = both.select(*keys, *order, "flag", F.explode(F.array(*each)).alias("__m")).select(*keys, *order, "flag", "__m.*")
    conc = calibration.concentrations(
        long, gas_flow, settings.regimes, [*keys, "__method"], settings.delay_s, keep_input=False
    )
    valid = stage(calibration.valid_series(conc, [*keys, "__method"], "__v"), "series")
    night, zero_air = (
        valid.where(F.col("__method") == name).select(
            *keys, "ts", F.col("__v").alias(name), F.col("__v_constant").alias(f"{name}_constant")
        )
        for name in names
    )
    return night, zero_air


def process(
    raw: DataFrame,
    gas_flow: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    settings: Settings | None = None,
) -> DataFrame:
    """Calibrated series of both zero methods from ``raw`` (keys, order, ch1, ch2)."""
    settings = settings or Settings()
    night, zero_air = calibrated(raw, gas_flow, keys, order, settings)
    return calibration.combined_series(night, zero_air, keys, settings.polluted)


def compare_zeroes(
    raw: DataFrame, keys: Sequence[str], order: Sequence[str], settings: Settings | None = None
) -> DataFrame:
    """Anchors, baselines and zeroed channels of both methods, row by row."""
    return comparison.zero_comparison(zeroed_both(raw, keys, order, settings or Settings()), keys, order)
