"""Operators on row order, split so that one long series uses the whole cluster.

``sequence`` range-partitions the rows by (series, time, tie-break), sorts each
partition and stages the result with two columns: ``_pos``, a number that rises
in that order, and ``_chunk``, the partition a row fell in.  A series that holds
most of the data, or one crowded day, is simply cut into more chunks.  Each
operator below then

1. scans inside (series, chunk),
2. reduces every chunk to one summary row,
3. scans the summary table along the chunks of each series, and
4. joins the carried value back on (series, chunk).

The summary has one row per series and chunk.  The join keys equal the window
keys, so step 4 moves no data rows again.  Look-ahead uses a descending window:
a frame that ends at "unbounded following" is recomputed for every row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.timefn import as_col, to_micros
from strandline.session import stage

POS = "_pos"
CHUNK = "_chunk"
_CHUNK_BITS = 33  # monotonically_increasing_id() keeps the partition above these


def sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stage ``df`` in (keys, order) order with ``_pos`` and ``_chunk``.

    ``order`` must be total within a series (end it with a tie-break), and the
    keys must be present; rows without a time come last.  ``strandline.chunks`` sets the number of chunks;
    without it adaptive execution sizes them from the data.  A sequenced frame
    may be filtered and extended with columns before it is used again.
    """
    if POS in df.columns:
        return df
    spark = df.sparkSession
    checked = df.withColumns(
        {
            k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"series key {k} is NULL")))
            .otherwise(F.col(k))
            for k in keys
        }
    )
    fixed = spark.conf.get("strandline.chunks", None)
    by = [*keys, *[F.col(c).asc_nulls_last() for c in order]]
    ranged = checked.repartitionByRange(*([int(fixed)] if fixed else []), *by)
    ranked = ranged.sortWithinPartitions(*by).withColumn(POS, F.monotonically_increasing_id())
    return stage(
        ranked.withColumn(CHUNK, F.shiftright(POS, _CHUNK_BITS).cast("int")), "sequence"
    )


def _finish(out: DataFrame, given: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    return out.drop(*drop, *([] if POS in given.columns else [POS, CHUNK]))


def _rows(keys: Sequence[str], forward: bool = True):
    by = F.col(POS) if forward else F.col(POS).desc()
    return Window.partitionBy(*keys, CHUNK).orderBy(by)


def _running(keys: Sequence[str], forward: bool = True):
    return _rows(keys, forward).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _chunks(keys: Sequence[str], forward: bool = True):
    return Window.partitionBy(*keys).orderBy(F.col(CHUNK) if forward else F.col(CHUNK).desc())


def _earlier_chunks(keys: Sequence[str], forward: bool = True):
    return _chunks(keys, forward).rowsBetween(Window.unboundedPreceding, -1)


def _carry(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(summary, [*keys, CHUNK], "left")


def _offset(column: str, keys: Sequence[str]) -> Column:
    return F.coalesce(F.sum(column).over(_earlier_chunks(keys)), F.lit(0))


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "idx"
) -> DataFrame:
    """Number the rows of each series 1, 2, ... in time order.

    A freshly sequenced frame needs no window over its rows: ``_pos`` is dense
    inside a chunk, so one lookup of the chunk's offset numbers them all.
    """
    fresh = POS not in df.columns
    seq = sequence(df, keys, order)
    summary = seq.groupBy(*keys, CHUNK).agg(
        F.count(F.lit(1)).alias("__n"), F.min(POS).alias("__first")
    )
    carry = summary.select(
        *keys, CHUNK, F.col("__first"), _offset("__n", keys).alias("__off")
    )
    if fresh:
        local: Column = F.col(POS) - F.col("__first") + 1
        rows = seq
    else:
        local = F.col("__rn")
        rows = seq.withColumn("__rn", F.row_number().over(_rows(keys)))
    numbered = _carry(rows, carry, keys).withColumn(out, (local + F.col("__off")).cast("bigint"))
    return _finish(numbered, df, ["__rn", "__first", "__off"])


def _fill(df, cols, keys, order, forward: bool) -> DataFrame:
    seq = sequence(df, keys, order)
    pick = F.max_by if forward else F.min_by
    edges = seq.groupBy(*keys, CHUNK).agg(
        *[pick(c, F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"__edge_{c}") for c in cols]
    )
    before = _earlier_chunks(keys, forward)
    carry = edges.select(
        *keys, CHUNK, *[F.last(f"__edge_{c}", True).over(before).alias(f"__in_{c}") for c in cols]
    )
    running = _running(keys, forward)
    rows = seq.withColumns({c: F.last(c, True).over(running) for c in cols})
    filled = _carry(rows, carry, keys).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"__in_{c}")) for c in cols}
    )
    return _finish(filled, df, [f"__in_{c}" for c in cols])


def fill_down(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Carry the last known value of each column forward within its series."""
    return _fill(df, list(cols), keys, order, True)


def fill_up(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Carry the next known value of each column back within its series."""
    return _fill(df, list(cols), keys, order, False)


def cumulative_sum(
    df: DataFrame, col: str, keys: Sequence[str], order: Sequence[str], out: str
) -> DataFrame:
    """Running total over the series; missing values add nothing."""
    seq = sequence(df, keys, order)
    totals = seq.groupBy(*keys, CHUNK).agg(F.sum(col).alias("__sum"))
    carry = totals.select(*keys, CHUNK, F.sum("__sum").over(_earlier_chunks(keys)).alias("__in"))
    rows = seq.withColumn("__run", F.sum(col).over(_running(keys)))
    total = F.when(
        F.col("__run").isNotNull() | F.col("__in").isNotNull(),
        F.coalesce("__run", F.lit(0)) + F.coalesce("__in", F.lit(0)),
    )
    return _finish(_carry(rows, carry, keys).withColumn(out, total), df, ["__run", "__in"])


def run_ids(
    df: DataFrame,
    code: str,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "run_id",
    run_no: str = "run_no",
    idx: str = "idx",
    begun: str | None = None,
) -> DataFrame:
    """Number the maximal runs of equal ``code`` within each series.

    ``run_no`` counts all runs, ``out`` only those whose code is not zero (rows
    of other runs get 0), and ``idx`` is the row number.  A run ends where the
    code changes, never at a gap in time.  ``begun`` names a column for the
    number of non-zero runs that have begun so far.
    """
    seq = sequence(df, keys, order)
    here = _rows(keys)
    event = F.coalesce(F.col(code) != 0, F.lit(False))
    rows = seq.withColumn("__rn", F.row_number().over(here)).withColumn(
        "__new",
        (F.col("__rn") > 1) & ~F.lag(code).over(here).eqNullSafe(F.col(code)),
    )
    rows = rows.withColumns(
        {
            "__runs": F.sum(F.col("__new").cast("bigint")).over(_running(keys)),
            "__events": F.sum((F.col("__new") & event).cast("bigint")).over(_running(keys)),
        }
    )
    rows = stage(rows.drop("__new"), "runs")  # summarised and joined: scan the runs once
    summary = rows.groupBy(*keys, CHUNK).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max("__runs").alias("__runs"),
        F.max("__events").alias("__events"),
        F.min_by(code, "__rn").alias("__head"),
        F.max_by(code, "__rn").alias("__tail"),
    )
    along = _chunks(keys)
    head_new = F.lag("__n").over(along).isNull() | ~F.lag("__tail").over(along).eqNullSafe(
        F.col("__head")
    )
    head_event = F.coalesce(F.col("__head") != 0, F.lit(False))
    summary = summary.withColumn("__head_new", head_new).withColumns(
        {
            "__b": F.col("__head_new").cast("bigint"),
            "__be": (F.col("__head_new") & head_event).cast("bigint"),
        }
    )
    summary = summary.withColumns(
        {"__all_r": F.col("__runs") + F.col("__b"), "__all_e": F.col("__events") + F.col("__be")}
    )
    carry = summary.select(
        *keys,
        CHUNK,
        _offset("__n", keys).alias("__off"),
        (_offset("__all_r", keys) + F.col("__b")).alias("__r0"),
        (_offset("__all_e", keys) + F.col("__be")).alias("__e0"),
    )
    numbered = _carry(rows, stage(carry, "carry"), keys).withColumns(
        {
            idx: (F.col("__rn") + F.col("__off")).cast("bigint"),
            run_no: F.col("__runs") + F.col("__r0"),
            out: F.when(event, F.col("__events") + F.col("__e0")).otherwise(F.lit(0)),
        }
    )
    if begun:
        numbered = numbered.withColumn(begun, F.col("__events") + F.col("__e0"))
    return _finish(
        numbered, df, ["__rn", "__runs", "__events", "__off", "__r0", "__e0"]
    )


def number_runs(
    df: DataFrame, codes: Mapping[str, str], keys: Sequence[str], order: Sequence[str], idx: str = "idx"
) -> DataFrame:
    """Row numbers, and the event runs of several codes, from one scan.

    For every name in ``codes`` (name: code column) ``<name>run_id`` numbers the runs of a
    code that is not zero (0 in other rows), and ``<name>begun`` counts those begun so far.
    What a chunk hands on is one composite state: its rows, and for every code the runs
    it begins, its first and its last code.  States of neighbouring chunks merge into
    that of both, so all codes share one summary row for each series and chunk.  The result is staged.
    """
    seq = sequence(df, keys, order)
    here, running, along = _rows(keys), _running(keys), _chunks(keys)
    events = {p: F.coalesce(F.col(c) != 0, F.lit(False)) for p, c in codes.items()}
    rows = seq.withColumn("__rn", F.row_number().over(here))
    new = {f"__new_{p}": (F.col("__rn") > 1) & ~F.lag(c).over(here).eqNullSafe(F.col(c)) & events[p] for p, c in codes.items()}
    rows = rows.withColumns(new).withColumns({f"__e_{p}": F.sum(F.col(f"__new_{p}").cast("bigint")).over(running) for p in codes})
    state = [F.count(F.lit(1)).alias("__n")]
    for p, c in codes.items():
        state += [
            F.max(f"__e_{p}").alias(f"__e_{p}"), F.min_by(c, "__rn").alias(f"__head_{p}"), F.max_by(c, "__rn").alias(f"__tail_{p}")
        ]
    summary = rows.groupBy(*keys, CHUNK).agg(*state)
    begins = {
        f"__b_{p}": (
            (F.lag("__n").over(along).isNull() | ~F.lag(f"__tail_{p}").over(along).eqNullSafe(F.col(f"__head_{p}")))
            & F.coalesce(F.col(f"__head_{p}") != 0, F.lit(False))
        ).cast("bigint")
        for p in codes
    }
    summary = summary.withColumns(begins).withColumns({f"__e_{p}": F.col(f"__e_{p}") + F.col(f"__b_{p}") for p in codes})
    offsets = [(_offset(f"__e_{p}", keys) + F.col(f"__b_{p}")).alias(f"__e0_{p}") for p in codes]
    carry = stage(summary.select(*keys, CHUNK, _offset("__n", keys).alias("__off"), *offsets), "carry")
    out = {idx: (F.col("__rn") + F.col("__off")).cast("bigint")}
    for p in codes:
        begun = F.col(f"__e_{p}") + F.col(f"__e0_{p}")
        out |= {f"{p}begun": begun, f"{p}run_id": F.when(events[p], begun).otherwise(F.lit(0))}
    numbered = _carry(rows.drop(*new), carry, keys).withColumns(out)
    return stage(_finish(numbered, df, ["__rn", "__off", *[f"__e_{p}" for p in codes], *[f"__e0_{p}" for p in codes]]), "numbered")


def around(df: DataFrame, cols: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each column the known values next to a row: up to it (``__p_``), before it (``__pb_``), from it on
    (``__n_``) and after it (``__na_``), from one scan and one summary."""
    seq = sequence(df, keys, order)
    known = {c: F.when(F.col(c).isNotNull(), F.col(POS)) for c in cols}
    edges = seq.groupBy(*keys, CHUNK).agg(
        *[F.max_by(c, known[c]).alias(f"__t_{c}") for c in cols], *[F.min_by(c, known[c]).alias(f"__h_{c}") for c in cols]
    )
    carry = edges.select(
        *keys,
        CHUNK,
        *[F.last(f"__t_{c}", True).over(_earlier_chunks(keys)).alias(f"__in_{c}") for c in cols],
        *[F.last(f"__h_{c}", True).over(_earlier_chunks(keys, False)).alias(f"__out_{c}") for c in cols],
    )
    found = {}
    for c in cols:
        for to, back, forward in (("__p_", "__pb_", True), ("__n_", "__na_", False)):
            before = _rows(keys, forward).rowsBetween(Window.unboundedPreceding, -1)
            found |= {f"{to}{c}": F.last(c, True).over(_running(keys, forward)), f"{back}{c}": F.last(c, True).over(before)}
    rows = _carry(seq.withColumns(found), carry, keys).withColumns(
        {name: F.coalesce(F.col(name), F.col(f"__{'in' if name.startswith('__p') else 'out'}_{name.split('_', 3)[3]}")) for name in found}
    )
    return _finish(rows, df, [f"__{side}_{c}" for side in ("in", "out") for c in cols])


def _known(x: Column, v: Column) -> Column:
    return F.when(v.isNotNull(), F.struct(x.alias("x"), v.alias("v")))


def interpolate_linear(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str],
    by: str | None = None,
    extend: dict[str, str] | None = None,
    out: dict[str, str] | None = None,
) -> DataFrame:
    """Fill gaps on the line between the known neighbours of each column.

    The line runs over row positions, or over the timestamp or number ``by``.
    Rows before the first and after the last known value stay NULL, unless
    ``extend[col]`` is ``"down"`` or ``"up"``: then the last (first) known value
    goes on in that direction.  ``out`` maps columns to new names.
    """
    out, extend, cols = out or {}, extend or {}, list(cols)
    fresh = POS not in df.columns
    seq = sequence(df, keys, order)

    # local position, and the shift that turns it into one along the series
    shift = F.lit(0)
    if by is not None:
        is_time = dict(seq.dtypes)[by].startswith("timestamp")
        rows = seq.withColumn("__x", to_micros(by) if is_time else as_col(by))
    elif fresh:
        rows = seq.withColumn("__x", F.col(POS))
        shift = _offset("__n", keys) - F.col("__first")
    else:
        rows = seq.withColumn("__x", F.row_number().over(_rows(keys)).cast("bigint"))
        shift = _offset("__n", keys)

    edges = []
    for c in cols:
        known_at = F.when(F.col(c).isNotNull(), F.col(POS))
        for side, pick in (("t", F.max_by), ("h", F.min_by)):
            edges += [
                pick("__x", known_at).alias(f"__{side}x_{c}"),
                pick(c, known_at).alias(f"__{side}v_{c}"),
            ]
    summary = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__first"), *edges)
        .withColumn("__shift", shift)
    )

    def edge(side: str, c: str) -> Column:
        return _known(F.col(f"__{side}x_{c}") + F.col("__shift"), F.col(f"__{side}v_{c}"))

    carry = summary.select(
        *keys,
        CHUNK,
        "__shift",
        *[F.last(edge("t", c), True).over(_earlier_chunks(keys)).alias(f"__p_{c}") for c in cols],
        *[
            F.last(edge("h", c), True).over(_earlier_chunks(keys, False)).alias(f"__q_{c}")
            for c in cols
        ],
    )
    point = {c: _known(F.col("__x"), F.col(c)) for c in cols}
    rows = rows.withColumns(
        {f"__l_{c}": F.last(point[c], True).over(_running(keys)) for c in cols}
    ).withColumns({f"__r_{c}": F.last(point[c], True).over(_running(keys, False)) for c in cols})
    joined = _carry(rows, carry, keys)

    def moved(name: str) -> Column:
        p = F.col(name)
        return _known(p["x"] + F.col("__shift"), p["v"])

    neighbours, results, drops = {}, {}, ["__x", "__shift"]
    x = F.col("__x") + F.col("__shift")
    for c in cols:
        neighbours[f"__p_{c}"] = F.coalesce(moved(f"__l_{c}"), F.col(f"__p_{c}"))
        neighbours[f"__q_{c}"] = F.coalesce(moved(f"__r_{c}"), F.col(f"__q_{c}"))
        p, q = F.col(f"__p_{c}"), F.col(f"__q_{c}")
        slope = F.try_divide(q["v"] - p["v"], (q["x"] - p["x"]).cast("double"))
        value = F.coalesce(F.col(c), p["v"] + slope * (x - p["x"]))
        if extend.get(c) == "down":
            value = F.coalesce(value, p["v"])
        elif extend.get(c) == "up":
            value = F.coalesce(value, q["v"])
        results[out.get(c, c)] = value
        drops += [f"__p_{c}", f"__q_{c}", f"__l_{c}", f"__r_{c}"]
    return _finish(joined.withColumns(neighbours).withColumns(results), df, drops)
