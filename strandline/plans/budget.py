"""Merging of the hourly series and the steady-state budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import chem
from strandline.functions.scalars import coalesce_fallback, first_match
from strandline.functions.timefn import between_halfopen, between_open
from strandline.operators.joins import left_join, left_join_chain, lookup_join
from strandline.operators.ordered import fill_down
from strandline.operators.reshape import unpivot, unpivot_paired
from strandline.operators.resample import time_average
from strandline.operators.stats import impute_group_mean
from strandline.plans import campaign
from strandline.session import stage

# Labels of wind sectors and pollution.
LOCAL = "Local pollution"
CLEAN = "Clean"


def gapfill_radiation(met: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Photolysis rates: measured, else calculated, else the mean of that hour."""
    filled = met.withColumns(
        {
            "jhono": coalesce_fallback("j_hono", "jhono_calc"),
            "jhno3": coalesce_fallback("j_hno3", "jhno3_calc"),
        }
    ).drop("j_hono", "jhono_calc", "j_hno3", "jhno3_calc")
    return impute_group_mean(filled, ["jhono", "jhno3"], keys)


def merge_hourly(
    nox: DataFrame, hono: DataFrame, met: DataFrame, air_masses: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Left-join the hourly series onto the nitrogen oxides and label the rows.

    The constant-flow results replace the hourly-flow ones.  Keys and times are
    present (rows without either join nothing), so the joins go by plain equality
    and reuse the partitioning of the aggregates they get.
    """
    joined = left_join_chain([nox, hono, met, air_masses], [*keys, "ts"], null_safe=False)
    polluted = first_match(
        [(F.col("wd").between(100, 340), LOCAL), (F.col("ws") <= 2, LOCAL)], CLEAN
    )
    hour = F.hour("ts")
    labelled = joined.withColumns(
        {
            "local_pollution": polluted,
            "hour": hour,
            "oh_molecules_cm3": F.when(
                hour.between(*campaign.OH_HOURS), chem.OH_DAYTIME
            ).otherwise(0.0),
        }
    )
    return labelled.drop("hono_night", "hono_za").withColumnsRenamed(
        {"hono_night_constant": "hono_night", "hono_za_constant": "hono_za"}
    )


def timeseries_table(
    merged: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    window: tuple[str, str] = ("2024-09-08", "2024-09-19"),
    event: tuple[str, str] = ("2024-09-11 05:00", "2024-09-13 13:00"),
) -> DataFrame:
    """Hourly long table of a window, with event flag; text labels drop out."""
    inside = between_halfopen("ts", *event)
    wd = F.col("wd")
    part = merged.where(between_open("ts", *window)).withColumns(
        {
            "pollution_date": F.when(inside, 1).when(~inside, 0),
            "wd_flag": wind_sector(wd),
        }
    )
    hourly = time_average(part, "1 hour", keys, cols=[*values, "pollution_date"])
    return unpivot(hourly, values, [*keys, "ts", "pollution_date"])


def wind_sector(wd):
    return first_match(
        [
            (wd <= 90, "< 90"),
            ((wd > 90) & (wd < 100), "Between 90 and 100"),
            ((wd >= 100) & (wd <= 340), LOCAL),
            (wd > 340, "> 340"),
        ]
    )


def _daytime():
    return F.col("hour").between(*campaign.DAYTIME_HOURS)


def _sinks():
    return F.col("jhono") + F.col("oh_molecules_cm3") * chem.K_OH_HONO + F.col("kdep")


def _steady_state(production):
    return F.try_divide(chem.molecules_to_ppt(production), _sinks())


def budget_without_nitrate(
    merged: DataFrame,
    keys: Sequence[str],
    obs: str = "hono_night",
    window: tuple[str, str] = ("2024-09-08", "2024-09-19"),
) -> DataFrame:
    """Gas-phase budget with the daytime lifetime carried on to the next day.

    Of rows at the same time the one with the longest lifetime is carried on, whatever their order.
    """
    part = merged.where(between_open("ts", *window)).withColumn("hour", F.hour("ts"))
    lifetime = F.when(_daytime(), F.try_divide(F.lit(1.0), F.col("jhono")))
    carried = fill_down(part.withColumn("lifetime", lifetime), ["lifetime"], keys, ["ts", "lifetime"])
    return carried.withColumns(
        {
            "h": F.col("lifetime") * chem.TRANSPORT_VELOCITY,
            "kp": chem.oh_no_rate("temp"),
            "kdep": chem.deposition_rate("lifetime"),
        }
    ).withColumns(
        {
            "production_without_nitrate": F.col("kp")
            * F.col("oh_molecules_cm3")
            * chem.ppt_to_molecules("no_ppt"),
            "loss": _sinks() * chem.ppt_to_molecules(obs),
        }
    ).withColumn("hono_without_nitrate", _steady_state(F.col("production_without_nitrate")))


def add_daily_nitrate(merged: DataFrame, nitrate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily nitrate onto the hourly table: joined at midnight, then carried on.

    Rows at the same time get the same value, so their order plays no part; a day has one row.
    Given a sequenced table the result is one too, and later fills on it do not
    sort again: the daily tables have one row per series and day.
    """
    daily = nitrate.select(
        *keys, F.col("date").cast("timestamp_ntz").alias("ts"), F.col("nitrate")
    )
    joined = fill_down(left_join(merged, daily, [*keys, "ts"], null_safe=False), ["nitrate"], keys, ["ts"])
    return joined.withColumn(
        "nitrate_molecules_cm3", chem.nitrate_to_molecules("nitrate")
    ).withColumn("nitrate_nmol_m3", chem.molecules_to_nmol("nitrate_molecules_cm3"))


def _source_and_loss(df: DataFrame, obs: Mapping[str, str]) -> DataFrame:
    production = F.lit(chem.K_OH_NO) * F.col("oh_molecules_cm3") * chem.ppt_to_molecules("no_ppt")
    df = df.withColumns(
        {
            "h": F.col("lifetime") * chem.TRANSPORT_VELOCITY,
            "kdep": chem.deposition_rate("lifetime"),
            "production_without_nitrate": production,
        }
    )
    df = df.withColumns(
        {f"loss{s}": _sinks() * chem.ppt_to_molecules(c) for s, c in obs.items()}
    )
    return df.withColumns(
        {
            f"missing_production{s}": F.col(f"loss{s}") - F.col("production_without_nitrate")
            for s in obs
        }
    )


def budget_with_nitrate(
    with_nitrate: DataFrame, obs: Mapping[str, str] | None = None
) -> DataFrame:
    """Daytime budget: missing production and the enhancement it asks for.

    ``obs`` maps a suffix to an observation column.  Several observations share
    one pass, since only the loss depends on them.
    """
    obs = obs or {"": "hono_night"}
    day = with_nitrate.where(_daytime()).withColumn(
        "lifetime", F.try_divide(F.lit(1.0), F.col("jhono"))
    )
    day = _source_and_loss(day, obs)
    available = F.col("jhno3") * F.col("nitrate_molecules_cm3")
    return day.withColumns(
        {
            **{
                f"f_calc{s}": F.try_divide(F.col(f"missing_production{s}"), available)
                for s in obs
            },
            "f_fit_a": chem.enhancement(chem.ENHANCEMENT_FIT_A, "nitrate_nmol_m3"),
            "f_fit_b": chem.enhancement(chem.ENHANCEMENT_FIT_B, "nitrate_nmol_m3"),
        }
    )


def daily_enhancement(
    with_nitrate: DataFrame, keys: Sequence[str], obs: Mapping[str, str] | None = None
) -> DataFrame:
    """Daily mean enhancement factors, carried over all hours, and modelled series.

    The bias of each model is taken over all rows of a series and shown in the
    daytime hours.
    """
    obs = obs or {"": "hono_night"}
    with_nitrate = stage(with_nitrate, "nitrate")  # read for the daily means and for the rows
    factors = ["f_fit_a", "f_fit_b", *[f"f_calc{s}" for s in obs], "lifetime"]
    daily = time_average(budget_with_nitrate(with_nitrate, obs), "1 day", keys, cols=factors)
    joined = fill_down(left_join(with_nitrate, daily, [*keys, "ts"], null_safe=False), factors, keys, ["ts"])
    budget = _source_and_loss(joined, obs)
    nitrate = F.col("jhno3") * F.col("nitrate_molecules_cm3")
    base = F.col("production_without_nitrate")
    models = budget.withColumns(
        {
            "hono_fit_a": _steady_state(base + nitrate * F.col("f_fit_a")),
            "hono_fit_b": _steady_state(base + nitrate * F.col("f_fit_b")),
            "pss_factor1": _steady_state(base + nitrate),
        }
    )
    models = stage(models, "models")  # read for the bias and for the rows
    biases = [f"nmb_{m}{s}" for s in obs for m in ("fit_a", "fit_b")]
    nmb = models.groupBy(*keys).agg(
        *[
            chem.normalised_mean_bias(f"hono_{m}", c).alias(f"nmb_{m}{s}")
            for s, c in obs.items()
            for m in ("fit_a", "fit_b")
        ]
    )
    joined = lookup_join(models, nmb, list(keys))
    return joined.withColumns({b: F.when(_daytime(), F.col(b)) for b in biases})


def variant_table(with_nitrate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Budget against both observed series, in export order.

    Weather, trace gases, photolysis rates, air masses and the pollution label
    stand between the nitrogen oxides and the budget, as in the merged table.  The
    modelled series do not depend on the observation, so both variants come from
    one pass over the data.  Each variant's biases close the row (daytime hours).
    """
    both = daily_enhancement(with_nitrate, keys, {"_night": "hono_night", "_za": "hono_za"})
    given = with_nitrate.columns
    site = given[given.index("ws") : given.index("local_pollution") + 1]
    return both.select(
        *keys,
        "ts",
        "hour",
        "hono_night",
        "hono_za",
        "no_ppt",
        "no2_ppt",
        *site,
        "oh_molecules_cm3",
        "nitrate",
        "nitrate_molecules_cm3",
        "nitrate_nmol_m3",
        *[F.col(f"f_fit_{m}").alias(f"f_fit_{m}_{v}") for v in ("za", "night") for m in "ab"],
        "f_calc_za",
        "f_calc_night",
        *[F.col(f"hono_fit_{m}").alias(f"hono_fit_{m}_{v}") for v in ("za", "night") for m in "ab"],
        *[f"nmb_fit_{m}_{v}" for v in ("za", "night") for m in "ab"],
    )


def variant_bias(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean bias of each model against each observed series, per series key."""
    biases = [f"nmb_fit_{m}_{v}" for v in ("za", "night") for m in "ab"]
    return table.groupBy(*keys).agg(*[F.avg(b).alias(b) for b in biases])


def variant_long(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Measured and modelled series of both variants, one row per value, with the variant's factor."""
    columns = {
        v: {
            "Measured": f"hono_{v}",
            "Fit A": f"hono_fit_a_{v}",
            "Fit B": f"hono_fit_b_{v}",
        }
        for v in ("night", "za")
    }
    along = {v: {"f_calc": f"f_calc_{v}"} for v in columns}
    return unpivot_paired(table, [*keys, "ts"], columns, along=along)
