"""Column functions of the measurement formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.timefn import as_col

# Physical constants and fitted coefficients of the method.
AVOGADRO = 6.022e23
AIR_MOLECULES_CM3 = 2.46e19
NITRITE_MOLAR_MASS = 46.0
NITRATE_MOLAR_MASS = 62.004
UPTAKE_SLOPE = 7768.943
UPTAKE_OFFSET = 0.116560784
K_OH_NO = 3.3e-11
K_OH_HONO = 6e-12
DEPOSITION_CM_S = 0.01
TRANSPORT_VELOCITY = 0.3
OH_DAYTIME = 2e6
# (numerator, coefficient of nitrate in nmol m-3) of two published fits
ENHANCEMENT_FIT_A = (385.7, 0.19)
ENHANCEMENT_FIT_B = (5.02e8, 7.19e5)

_PPT = AIR_MOLECULES_CM3 * 1e-12


def two_channel_ppt(ch1: Column | str, ch2: Column | str, efficiency: Column | str) -> Column:
    """Mixing ratio from signal and interference channel at a sampling efficiency."""
    ch1, ch2, eff = as_col(ch1), as_col(ch2), as_col(efficiency)
    carried_over = ch1 * (F.lit(1.0) - eff)
    return F.try_divide(ch1, eff) - (ch2 - carried_over)


def detection_limit(
    sd3_1: Column | str, sd3_2: Column | str, slope1: Column | str, slope2: Column | str
) -> Column:
    """Combined detection limit of both channels from three-sigma zeros."""
    return F.hypot(as_col(sd3_1) * as_col(slope1), as_col(sd3_2) * as_col(slope2))


def ppt_to_molecules(x: Column | str) -> Column:
    return as_col(x) * F.lit(_PPT)


def molecules_to_ppt(x: Column | str) -> Column:
    return as_col(x) / F.lit(_PPT)


def nitrate_to_molecules(mass: Column | str) -> Column:
    """Nitrate in ug m-3 as molecules cm-3."""
    return as_col(mass) * F.lit(1e-12 * AVOGADRO / NITRATE_MOLAR_MASS)


def molecules_to_nmol(molecules: Column | str) -> Column:
    return as_col(molecules) * F.lit(1e15 / AVOGADRO)


def sampling_efficiency(flow: Column | str) -> Column:
    exponent = F.try_divide(F.lit(-UPTAKE_SLOPE), as_col(flow)) - F.lit(UPTAKE_OFFSET)
    return F.lit(1.0) - F.exp(exponent)


def standard_mixing_ratio(
    conc_cal: Column | str, liquid_flow: Column | str, gas_flow: Column | str
) -> Column:
    """Mixing ratio (ppt) equivalent to a liquid standard at given flows."""
    moles_per_min = as_col(conc_cal) / 1000 * as_col(liquid_flow) / 1000 / NITRITE_MOLAR_MASS
    molecules = moles_per_min * F.lit(AVOGADRO)
    return F.try_divide(molecules, as_col(gas_flow) * F.lit(_PPT))


def oh_no_rate(temp_c: Column | str) -> Column:
    """Rate of OH + NO at a temperature in Celsius."""
    return F.lit(K_OH_NO) * F.pow((as_col(temp_c) + 273.15) / 300, F.lit(-0.3))


def deposition_rate(lifetime: Column | str) -> Column:
    """Deposition over the height mixed within one lifetime."""
    return F.try_divide(F.lit(DEPOSITION_CM_S), as_col(lifetime) * F.lit(TRANSPORT_VELOCITY))


def enhancement(fit: tuple[float, float], nitrate_nmol: Column | str) -> Column:
    return F.try_divide(F.lit(fit[0]), F.lit(1.0) + F.lit(fit[1]) * as_col(nitrate_nmol))


def normalised_mean_bias(model: Column | str, obs: Column | str, na_rm: bool = True) -> Column:
    """Aggregate ``100 * sum(model - obs) / sum(obs)``.

    With ``na_rm`` the top skips incomplete pairs and the bottom only missing
    observations; without it any missing pair makes the result NULL.
    """
    model, obs = as_col(model), as_col(obs)
    bias = F.try_divide(F.sum(model - obs), F.sum(obs)) * 100
    if na_rm:
        return bias
    return F.when(F.count(model - obs) == F.count(F.lit(1)), bias)
