"""Attach codes from prioritised time rules, such as flags and regimes.

Rules overlap, the first one that holds wins, and their bounds are open.  They
are a list in code or a table of any size.  Either is flattened into steps: instants, each
with the rule that holds from there on.  A table is flattened in parallel, without
a group per series: bounds are numbered per series, every rule covers a logarithmic number of
dyadic nodes of that numbering, a node keeps its first rule, and a step takes the
first of the nodes above it.

The data then looks for the last step at or before its time.  Up to ``WHOLE`` steps for all series
are part of the expression, and no join is made.  More steps, and
those that name series, are an index of equal depth: buckets of equally many steps and a
sorted array of the instants at which the buckets begin.  A row finds its bucket there, joins
that one row, and searches on inside.  No time, however crowded with rules, has a larger bucket.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.timefn import to_micros
from strandline.operators.joins import lookup_join
from strandline.operators.ordered import row_index
from strandline.session import stage

_BEFORE, _AFTER = -(1 << 62), 1 << 62  # beyond every timestamp
#: Most steps that become a CASE.
FEW = 256
#: Most steps that are put into the expression as an array, and steps of a bucket up to a million in all (as a power of two).
WHOLE, DEPTH = 2048, 10
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass(frozen=True)
class Rule:
    """``code`` holds for ``start < ts < end``; None leaves that side unbounded."""

    start: str | None
    end: str | None
    code: int
    series: str | None = None


def micros(text: str) -> int:
    moment = datetime.fromisoformat(text)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return (moment - _EPOCH) // timedelta(microseconds=1)


def parse_rules(text: str, shift_days: int = 0) -> list[Rule]:
    """Rules from lines ``start | end | code``; an empty side is unbounded."""
    rules = []
    for line in text.strip().splitlines():
        start, end, code = (part.strip() for part in line.split("|"))
        rules.append(Rule(moved(start, shift_days), moved(end, shift_days), int(code)))
    return rules


def moved(text: str | None, shift_days: int) -> str | None:
    if not text:
        return None
    moment = datetime.fromisoformat(text) + timedelta(days=shift_days)
    return moment.isoformat(sep=" ")


Span = tuple[int, int, int, int]  # from (inclusive), to (exclusive), priority, code
Step = tuple[int, int | None, int | None]  # instant, priority and code that hold from there on


def _flatten(rules: Iterable[Span]) -> list[Step]:
    """Steps with the priority and code of the first rule that holds."""
    edges: dict[int, list[tuple[int, int, int]]] = {}
    for lo, hi, prio, code in rules:
        if lo < hi:
            edges.setdefault(lo, []).append((prio, hi, code))
            edges.setdefault(hi, [])
    active: list[tuple[int, int, int]] = []
    steps: list[Step] = []
    for at in sorted(edges):
        for entry in edges[at]:
            heapq.heappush(active, entry)
        while active and active[0][1] <= at:
            heapq.heappop(active)
        prio, code = (active[0][0], active[0][2]) if active else (None, None)
        if not steps or steps[-1][1:] != (prio, code):
            steps.append((at, prio, code))
    return steps


def _steps_of_list(rules: Sequence[Rule]) -> dict[str | None, list[Step]]:
    by_series: dict[str | None, list[Span]] = {}
    for prio, rule in enumerate(rules):
        lo = _BEFORE if rule.start is None else micros(rule.start) + 1
        hi = _AFTER if rule.end is None else micros(rule.end)
        by_series.setdefault(rule.series, []).append((lo, hi, prio, rule.code))
    return {name: _flatten(mine) for name, mine in by_series.items()}


def _listed(spark: SparkSession, steps: dict[str, list[Step]]) -> DataFrame:
    rows = [(name, n, *step) for name, mine in steps.items() for n, step in enumerate(mine)]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = ["__for", "__n", "__at", "__prio", "__code"]
    columns = zip(*rows) if rows else [[]] * 5
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names))


def _steps_of_table(rules: DataFrame) -> DataFrame:
    """Rules (``__for``, ``__prio``, ``__lo``, ``__hi``, ``__code``) as staged steps, numbered from 0 per series.

    With n bounds in a series, rule [a, b) covers at most two dyadic nodes of each
    level, and step i lies below one node of each.  Every key is (series, level, node) or
    (series, instant), so no series is gathered in one place.
    """
    rules = stage(rules.where("__lo < __hi"), "rules")
    ends = rules.select("__for", F.explode(F.array("__lo", "__hi")).alias("__at")).distinct()
    numbered = row_index(ends, ["__for"], ["__at"], "__n").withColumn("__n", F.col("__n") - 1)
    bounds = stage(numbered, "bounds")
    levels = int(bounds.agg(F.max("__n")).first()[0] or 0).bit_length()

    def end(of: str, name: str) -> DataFrame:
        return bounds.select("__for", F.col("__at").alias(of), F.col("__n").alias(name))

    spans = rules.join(end("__lo", "__a"), ["__for", "__lo"]).join(end("__hi", "__b"), ["__for", "__hi"])
    left, right = "shiftright(__a + shiftleft(1L, k) - 1, k)", "shiftright(__b, k)"
    odd = "if({0} < {1} and {2} % 2 = 1, struct(k as level, {3} as node), null)"
    nodes = f"""explode(flatten(transform(sequence(0, {levels}), k -> filter(array(
        {odd.format(left, right, left, left)}, {odd.format(left, right, right, right + " - 1")}), x -> x is not null))))"""
    covered = (
        spans.select("__for", "__prio", "__code", F.expr(nodes).alias("__of"))
        .groupBy("__for", F.col("__of.level").alias("__level"), F.col("__of.node").alias("__node"))
        .agg(F.min(F.struct("__prio", "__code")).alias("__first"))
    )
    above = bounds.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn(
        "__node", F.expr("shiftright(__n, __level)")
    )
    found = above.join(covered, ["__for", "__level", "__node"], "left").groupBy("__for", "__n", "__at")
    return stage(found.agg(F.min("__first").alias("__first")).select("__for", "__n", "__at", "__first.*"), "steps")


def _constant(values: Sequence[int | None], kind: str = "bigint") -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def _search(rows: DataFrame, values: Column, most: int, out: str) -> DataFrame:
    """Add ``out``: the place (from 0) of the last of the sorted ``values`` at or before ``__us``, -1 if none.

    ``most`` bounds their number; each turn halves what is left.
    """
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))])
    place = F.aggregate(
        halves, F.lit(-1), lambda at, k: at + F.when(F.get(values, at + k) <= F.col("__us"), k).otherwise(0)
    )
    return rows.withColumn(out, place)


def _take(rows: DataFrame, arrays: dict[str, Column], most: int, tag: str) -> DataFrame:
    """Search in ``arrays["__at"]`` and add the priority and code found there."""
    found = _search(rows, arrays["__at"], most, "__place")
    return found.withColumns({f"{c}{tag}": F.get(arrays[c], F.col("__place")) for c in ("__prio", "__code")}).drop("__place")


def _in_expression(rows: DataFrame, steps: Sequence[Step], ts: str, tag: str) -> DataFrame:
    if len(steps) > FEW:
        at, prio, code = zip(*steps)
        return _take(rows, {"__at": _constant(at), "__prio": _constant(prio, "int"), "__code": _constant(code, "int")}, len(steps), tag)
    at = f"cast(`{ts}` as timestamp_ntz)"

    def arm(step: Step, value: int | None) -> str:
        moment = (_EPOCH + timedelta(microseconds=max(step[0], micros("0001-01-01")))).strftime("%Y-%m-%d %H:%M:%S.%f")
        begun = f"{at} is not null" if step[0] == _BEFORE else f"{at} >= timestamp_ntz'{moment.zfill(26)}'"
        return f"when {begun} then {'null' if value is None else value}"

    def chosen(k: int) -> Column:
        arms = " ".join(arm(s, s[k]) for s in reversed(steps) if s[0] < _AFTER)
        return F.expr(f"cast(case {arms} end as int)") if arms else F.lit(None).cast("int")

    return rows.withColumns({f"__prio{tag}": chosen(1), f"__code{tag}": chosen(2)})


def _in_index(rows: DataFrame, steps: DataFrame, last: int, series: str | None, tag: str) -> DataFrame:
    """Look up in an index of equal depth; ``last``: the largest step number of a series."""
    depth = max(DEPTH, (last.bit_length() + 1) // 2)
    fields = [F.col(f"__s.{c}").alias(f"__x{c}") for c in ("__at", "__prio", "__code")]
    buckets = (
        steps.groupBy("__for", F.shiftright("__n", depth).cast("int").alias("__bucket"))
        .agg(F.array_sort(F.collect_list(F.struct("__at", "__prio", "__code"))).alias("__s"))
        .select("__for", "__bucket", *fields)
    )
    begins = steps.where(F.col("__n").bitwiseAND(F.lit((1 << depth) - 1)) == 0)
    n_buckets = (last >> depth) + 1
    if series is None:
        edges = [r[0] for r in begins.select("__at").orderBy("__at").collect()]  # one for each 2 ** depth steps
        placed, on = _search(rows, _constant(edges), n_buckets, "__bucket"), ["__bucket"]
        buckets = buckets.drop("__for")
    else:
        placed, on = rows.withColumn("__for", F.col(series).cast("string")), ["__for", "__bucket"]
        if n_buckets == 1:
            placed = placed.withColumn("__bucket", F.lit(0))
        else:
            edges = begins.groupBy("__for").agg(F.array_sort(F.collect_list("__at")).alias("__edges"))
            placed = _search(lookup_join(placed, edges, "__for"), F.col("__edges"), n_buckets, "__bucket").drop("__edges")
    joined = lookup_join(placed, buckets, on)
    arrays = {c: F.col(f"__x{c}") for c in ("__at", "__prio", "__code")}
    return _take(joined, arrays, min(last + 1, 1 << depth), tag).drop("__for", "__bucket", *[f"__x{c}" for c in arrays])


def _of_table(rows: DataFrame, rules: DataFrame, series: str | None, ts: str, tag: str) -> DataFrame:
    steps = _steps_of_table(rules)
    n, last = steps.agg(F.count("*"), F.coalesce(F.max("__n"), F.lit(0))).first()
    if series is None and n <= WHOLE:
        return _in_expression(rows, [tuple(r) for r in steps.orderBy("__at").select("__at", "__prio", "__code").collect()], ts, tag)
    return _in_index(rows, steps, last, series, tag)


def _of_list(rows: DataFrame, steps: dict[str | None, list[Step]], series: str | None, ts: str, tag: str) -> DataFrame:
    if series is None and len(steps[None]) <= WHOLE:
        return _in_expression(rows, steps[None], ts, tag)
    mine = {k or "": v for k, v in steps.items()}
    return _in_index(rows, _listed(rows.sparkSession, mine), max(map(len, mine.values())) - 1, series, tag)


def flag_by_rules(
    df: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    out: str = "flag",
    ts: str = "ts",
    default: int | None = 0,
    series: str | None = None,
) -> DataFrame:
    """Add the code of the first rule that holds at ``ts``, else ``default``.

    ``rules`` is a list, or a table with columns ``prio``, ``start``, ``end``, ``code``
    and, if rules name series, ``series``; a NULL bound leaves that side open, a
    NULL series means every series, and the smallest ``prio`` wins.  A rule with a
    series applies to that series only (column ``series`` of ``df``).
    """
    is_table = isinstance(rules, DataFrame)
    if is_table:
        plain = rules.select(
            (F.col("series").cast("string") if "series" in rules.columns else F.lit(None).cast("string")).alias("__for"),
            F.coalesce(to_micros("start") + 1, F.lit(_BEFORE)).alias("__lo"),
            F.coalesce(to_micros("end"), F.lit(_AFTER)).alias("__hi"),
            F.col("prio").cast("int").alias("__prio"),
            F.col("code").cast("int").alias("__code"),
        )
        named, general = "series" in rules.columns, True
        own, shared = plain.where("__for is not null"), plain.where("__for is null").withColumn("__for", F.lit(""))
    else:
        steps = _steps_of_list(rules)
        named, general = any(k is not None for k in steps), None in steps
        own, shared = {k: v for k, v in steps.items() if k is not None}, {None: steps.get(None, [])}
    if named and series is None:
        raise ValueError("rules name series; say which column holds them")

    look, found = (_of_table if is_table else _of_list), []
    marked = df.withColumn("__us", to_micros(ts))
    if named:
        marked = look(marked, own, series, ts, "1")
        found.append("1")
    if general:
        marked = look(marked, shared, None, ts, "2")
        found.append("2")
    code = F.lit(None).cast("int")
    if len(found) == 2:
        own = F.col("__prio2").isNull() | (F.col("__prio1") < F.col("__prio2"))
        code = F.when(own & F.col("__prio1").isNotNull(), F.col("__code1")).otherwise(F.col("__code2"))
    elif found:
        code = F.col(f"__code{found[0]}")
    if default is not None:
        code = F.coalesce(code, F.lit(default))
    drops = ["__us", *[f"__{c}{t}" for t in found for c in ("prio", "code")]]
    return marked.withColumn(out, code).drop(*drops)


def regime_of(
    df: DataFrame,
    regimes: Sequence[Rule] | DataFrame,
    out: str = "regime",
    ts: str = "ts",
    series: str | None = None,
) -> DataFrame:
    """Keep the rows inside some regime, labelled with it; rows on a bound vanish."""
    return flag_by_rules(df, regimes, out, ts, default=None, series=series).where(
        F.col(out).isNotNull()
    )
