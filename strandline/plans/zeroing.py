"""Quality flags and zero subtraction by night values or by zero air."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import drop_codes, keep_codes
from strandline.functions.timefn import stamp
from strandline.operators.intervals import Rule, flag_by_rules
from strandline.operators.ordered import CHUNK, POS, around, number_runs, run_ids, sequence
from strandline.operators.runs import run_averages
from strandline.plans import campaign
from strandline.session import stage


@dataclass(frozen=True)
class Cutover:
    """When the anchors change segment, and when the baseline does."""

    anchors: str = campaign.ANCHOR_CUTOVER
    baseline: str = campaign.BASELINE_CUTOVER


def flag_quality(df: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Add ``flag``: 0 good, 1 zero, 2 calibration, 3 issue."""
    return flag_by_rules(df, rules if rules is not None else campaign.flag_rules(), "flag")


def mark_nights(df: DataFrame, bad_nights: Sequence[Rule] | None = None) -> DataFrame:
    """Add ``night_zero``: 1 in the night hours of nights fit to serve as zero."""
    rules = bad_nights if bad_nights is not None else campaign.bad_night_rules()
    hour = F.hour("ts")
    night = (hour <= campaign.NIGHT_LAST_HOUR) | (hour >= campaign.NIGHT_FIRST_HOUR)
    marked = flag_by_rules(df, rules, "__bad")
    return marked.withColumn(
        "night_zero", F.when(night & (F.col("__bad") == 0), 1).otherwise(0)
    ).drop("__bad")


@dataclass(frozen=True)
class Method:
    """A way to find zeroes: runs of ``code``, over channels as ``mask`` leaves them.

    Its columns begin with ``name``.  ``strict``: one gap voids the anchor of a run.
    """

    name: str
    code: str
    strict: bool
    mask: Callable[[str], Column] = F.col


def anchored_baseline(
    df: DataFrame,
    code: str,
    keys: Sequence[str],
    order: Sequence[str],
    strict: bool,
    cutover: Cutover,
    channels: Sequence[str] = ("ch1", "ch2"),
) -> DataFrame:
    """Anchor every run of ``code`` at its middle row and subtract the line between (see ``anchored_baselines``)."""
    return anchored_baselines(df, [Method("", code, strict)], keys, order, cutover, channels)


def anchored_baselines(
    df: DataFrame,
    methods: Sequence[Method],
    keys: Sequence[str],
    order: Sequence[str],
    cutover: Cutover,
    channels: Sequence[str] = ("ch1", "ch2"),
) -> DataFrame:
    """Zero the channels by several methods at once, side by side in the rows.

    Every run of a method's code has an anchor at its middle row, and the line between anchors is subtracted.
    Anchors before and after ``cutover.anchors`` are joined up separately, the
    earlier line held constant back to the start, the later one on to the end.
    ``cutover.baseline`` then picks the line for each row, so rows between the
    two instants use the later line, which is NULL ahead of its first anchor.

    The rows are put in order and numbered once for all methods.  All anchors come from runs, so the
    neighbours of a row follow from the run it is in or behind: they are found in one table
    of the runs of all methods, and a lookup by (series, runs begun) takes them to the
    rows.  The rows are neither scanned nor sorted again for the interpolation.
    """
    ts = order[0]
    numbered = number_runs(df, {f"{m.name}__": m.code for m in methods}, keys, order).drop(POS, CHUNK)
    cut = stamp(cutover.anchors)
    # idx rises with time: the middle row lies before the cut if it is not past
    # the last row that does
    sides = [
        F.max(F.when(F.col(ts) < cut, F.col("idx"))).alias("__last_early"),
        F.min(F.when(F.col(ts) > cut, F.col("idx"))).alias("__first_late"),
    ]
    each = [
        F.struct(
            F.lit(m.name).alias("__method"), F.col(f"{m.name}__run_id").alias("run_id"), *[m.mask(c).alias(c) for c in channels]
        )
        for m in methods
    ]
    events = numbered.select(
        *keys, ts, "idx", F.explode(F.filter(F.array(*each), lambda e: e["run_id"] != 0)).alias("__e")
    ).select(*keys, ts, "idx", "__e.*")
    strict = F.col("__method").isin([m.name for m in methods if m.strict])
    runs = run_averages(events, channels, [*keys, "__method"], strict, sides)
    halves = {"1": F.col("__last_early") >= F.col("idx"), "2": F.col("__first_late") <= F.col("idx")}
    lookup = _neighbours(runs, halves, [*keys, "__method"], channels)

    out = numbered
    for m in methods:
        begun = f"{m.name}__begun"
        mine = lookup.where(F.col("__method") == m.name).drop("__method").withColumnRenamed("__begun", begun)
        out = out.join(mine, [*keys, begun], "left").withColumnRenamed(f"{m.name}__run_id", f"{m.name}run_id")
        out = _zeroed(out, m, cutover, ts, list(halves), channels).drop(begun, *[c for c in mine.columns if c not in keys])
    return out


def _zeroed(
    near: DataFrame, m: Method, cutover: Cutover, ts: str, halves: Sequence[str], channels: Sequence[str]
) -> DataFrame:
    """The method's anchors, lines, baselines and zeroed channels from the anchors around each row."""
    run_id = F.col(f"{m.name}run_id")
    ahead_of_middle = (run_id != 0) & (F.col("idx") < F.col("__mid"))
    at_middle = (run_id != 0) & (F.col("idx") == F.col("__mid"))
    ends, lines, baselines, zeroed = {}, {}, {}, {}
    early = F.col(ts) < stamp(cutover.baseline)
    for c in channels:
        own = f"{m.name}{c}"
        for part in ("zeroes", "zero_3sd"):
            ends[f"{own}_{part}"] = F.when(at_middle, F.col(f"__{c}_{part}"))
        for half in halves:
            name = f"{c}_{half}"
            p = F.when(ahead_of_middle, F.col(f"__pb_{name}")).otherwise(F.col(f"__p_{name}"))
            q = F.when(ahead_of_middle, F.col(f"__n_{name}")).otherwise(F.col(f"__na_{name}"))
            ends |= {f"__p_{name}": p, f"__q_{name}": q}
            p, q = F.col(f"__p_{name}"), F.col(f"__q_{name}")
            slope = F.try_divide(q["v"] - p["v"], (q["x"] - p["x"]).cast("double"))
            line = F.when(F.col("idx") == p["x"], p["v"]).otherwise(
                p["v"] + slope * (F.col("idx") - p["x"])
            )
            lines[f"{own}_zeroes_inter{half}"] = F.coalesce(line, (q if half == "1" else p)["v"])
        baselines[f"{own}_baseline"] = F.when(early, F.col(f"{own}_zeroes_inter1")).otherwise(
            F.col(f"{own}_zeroes_inter2")
        )
        zeroed[f"{own}_zeroed"] = m.mask(c) - F.col(f"{own}_baseline")
    out = near.withColumns(ends).withColumns(lines).withColumns(baselines).withColumns(zeroed)
    return out.drop(*[f"__q_{c}_{half}" for c in channels for half in halves])


def _neighbours(
    runs: DataFrame, halves: dict[str, Column], keys: Sequence[str], channels: Sequence[str]
) -> DataFrame:
    """Known anchors around each run, keyed by the number of runs begun; staged.

    For every channel and half: ``__p`` the last anchor up to the run's own,
    ``__pb`` the last before it, ``__n`` the next from its own on, ``__na`` the
    next after it.  Key 0 stands for the rows ahead of the first run.
    """
    anchors = {}
    for c in channels:
        for half, inside in halves.items():
            anchors[f"{c}_{half}"] = F.when(
                inside & F.col(f"{c}_zeroes").isNotNull(),
                F.struct(F.col("idx").alias("x"), F.col(f"{c}_zeroes").alias("v")),
            )
    table = around(runs.withColumns(anchors), list(anchors), keys, ["run_id"])
    # The first run also stands for the rows ahead of it: nothing is known before, its own anchor comes next.
    begun = F.when(F.col("run_id") == 1, F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).otherwise(F.array("run_id"))
    table = table.withColumn("__begun", F.explode(begun))
    ahead = F.col("__begun") == 0

    def own(name: str, other: Column | None = None) -> Column:
        return (F.when(~ahead, F.col(name)) if other is None else F.when(ahead, other).otherwise(F.col(name))).alias(name)

    around_it = [own(f"__{side}_{n}") for n in anchors for side in ("p", "pb", "n")]
    after = [own(f"__na_{n}", F.col(f"__n_{n}")) for n in anchors]
    stats = [F.when(~ahead, F.col(f"{c}_{part}")).alias(f"__{c}_{part}") for c in channels for part in ("zeroes", "zero_3sd")]
    return stage(
        table.select(*keys, "__begun", F.when(~ahead, F.col("idx")).alias("__mid"), *stats, *around_it, *after), "anchors"
    )


def night_zero(
    flagged: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bad_nights: Sequence[Rule] | None = None,
    cutover: Cutover = Cutover(),
) -> DataFrame:
    """Subtract a baseline through the means of the nights; gaps are skipped."""
    masked = flagged.withColumns(
        {c: keep_codes(c, "flag", [0, 2]) for c in ("ch1", "ch2")}
    )
    nights = mark_nights(masked, bad_nights)
    return anchored_baseline(nights, "night_zero", keys, order, False, cutover)


def zero_air_zero(
    flagged: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    zero_rules: Sequence[Rule] | None = None,
    cutover: Cutover = Cutover(),
) -> DataFrame:
    """Subtract a baseline through the zero-air periods; one gap voids an anchor."""
    rules = zero_rules if zero_rules is not None else campaign.zero_air_rules()
    masked = flagged.withColumns({c: drop_codes(c, "flag", [3]) for c in ("ch1", "ch2")})
    return anchored_baseline(
        flag_by_rules(masked, rules, "zeroing"), "zeroing", keys, order, True, cutover
    )


def both_zeroes(
    flagged: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bad_nights: Sequence[Rule] | None = None,
    zero_rules: Sequence[Rule] | None = None,
    cutover: Cutover = Cutover(),
) -> DataFrame:
    """Both methods in one pass: columns of ``night_zero`` begin with ``night_``, those of ``zero_air_zero`` with ``za_``.

    The channels themselves stay as they are.
    """
    rules = zero_rules if zero_rules is not None else campaign.zero_air_rules()
    coded = flag_by_rules(mark_nights(flagged, bad_nights), rules, "zeroing")
    methods = [
        Method("night_", "night_zero", False, lambda c: keep_codes(c, "flag", [0, 2])),
        Method("za_", "zeroing", True, lambda c: drop_codes(c, "flag", [3])),
    ]
    return anchored_baselines(coded, methods, keys, order, cutover)


def step_response(
    df: DataFrame,
    code: str,
    channel: str,
    keys: Sequence[str],
    order: Sequence[str],
    share: float = 0.9,
    plateaus: tuple[float, float] | None = None,
) -> DataFrame:
    """Time each event run takes to make ``share`` of its step.

    The step goes from the first to the last known value of the run, or between
    the two given plateaus.  ``threshold`` is where the share is reached, and
    ``seconds`` counts from the first row of the run to the first row past it.
    """
    ts = order[0]
    runs = stage(
        run_ids(sequence(df, keys, order), code, keys, order)
        .where(F.col("run_id") != 0)
        .select(*keys, "run_id", ts, "idx", channel),
        "steps",
    )
    known = F.when(F.col(channel).isNotNull(), F.col("idx"))
    ends = runs.groupBy(*keys, "run_id").agg(
        F.min(ts).alias("start_ts"),
        F.min_by(channel, known).alias("start_value"),
        F.max_by(channel, known).alias("end_value"),
    )
    if plateaus is not None:
        ends = ends.withColumns(
            {"start_value": F.lit(float(plateaus[0])), "end_value": F.lit(float(plateaus[1]))}
        )
    change = F.col("end_value") - F.col("start_value")
    ends = stage(ends.withColumn("threshold", F.col("start_value") + change * share), "plateaus")
    bounds = ends.select(*keys, "run_id", "start_value", "end_value", "threshold")
    falling = F.col("end_value") < F.col("start_value")
    passed = F.when(falling, F.col(channel) <= F.col("threshold")).otherwise(
        F.col(channel) >= F.col("threshold")
    )
    crossed = (
        runs.join(bounds, [*keys, "run_id"])
        .groupBy(*keys, "run_id")
        .agg(F.min(F.when(passed, F.col(ts))).alias("crossed_ts"))
    )
    seconds = (F.unix_micros(F.col("crossed_ts").cast("timestamp"))
               - F.unix_micros(F.col("start_ts").cast("timestamp"))) / F.lit(1e6)
    return ends.join(crossed, [*keys, "run_id"]).withColumn("seconds", seconds)
