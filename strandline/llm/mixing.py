"""Mixing sources to target weights by histograms over hash buckets.

A document's hash decides how often the mix takes it: one more copy below the
threshold of its source.  Thresholds are nested: a larger budget takes whatever a
smaller one takes.  They are found without sorting: words are summed by source and
hash bucket, the bucket in which a budget ends is refined by its next hash bits,
and only its rows are read again.  All sums are combined before the shuffle, so a
source with most of the rows costs no more than a small one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import stage
from strandline.operators.joins import left_join, lookup_join
from strandline.operators.ordered import cumulative_sum, row_index

#: Hash bits, and those that one histogram tells apart.
BITS, LEVEL = 60, 12


def words(text: str) -> Column:
    """Number of words, which are parted by space and by the characters 9 to 13; NULL has none."""
    marked = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def hashed(key: str) -> Column:
    """60 bits of the key's MD5, which other engines have as well."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size, place) with ``target``.

    Weights repeat along ``place`` (from 1).  All targets make ``share`` of all sizes,
    by weight; none is above ``most`` times its source's size, and what is cut off goes
    to the others by weight, until none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    top = F.col("source_size") * F.lit(float(most))
    table = sources.withColumn("weight", weight)
    size, part = table.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = rest = float(share) * float(size or 0)
    while part:
        # The level rest / part only rises, so what was cut off before is so again.
        above = F.col("weight") * F.lit(rest) / F.lit(part) > top
        cut, free = table.agg(F.sum(F.when(above, top)), F.sum(F.when(~above, F.col("weight")))).first()
        if (budget - (cut or 0.0), free) == (rest, part):
            return table.withColumn("target", F.least(top, F.col("weight") * F.lit(rest) / F.lit(part))).drop("weight")
        rest, part = budget - (cut or 0.0), free
    return table.withColumn("target", top).drop("weight")


def _boundary(rows: DataFrame, plan: DataFrame, shift: int) -> DataFrame:
    """Per source the bucket (``prefix``: hash without its last ``shift`` bits) in which its budget ends,
    what of the budget is left there, and how many rows it holds."""
    histogram = rows.groupBy("source", F.shiftright("hash", shift).alias("prefix")).agg(
        F.sum("size").alias("here"), F.count("*").alias("rows")
    )
    along = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = histogram.withColumn("upto", F.sum("here").over(along))
    left = left_join(summed, plan.select("source", "left"), "source")
    ends = (F.col("upto") > F.col("left")) & (F.col("upto") - F.col("here") <= F.col("left"))
    return left.filter(ends).select("source", "prefix", (F.col("left") - F.col("upto") + F.col("here")).alias("left"), "rows")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row: id, source, size (words), source_size, target (of its source), copies and taken (size * copies).

    Sources in code-point order, NULL last, have the weights in turn.  A source whose
    target is r times its size takes every document floor(r) times, and once more those
    whose hash (of the id) is below its threshold.  The row on the threshold is taken if
    that brings the sum nearer to the target; rows with equal hashes count in order of size and id,
    and rows that repeat both count one by one.  NULL and empty texts have size 0 and are taken as
    often as their hash says, for no words.  Other columns are not looked at.  An empty table
    gives an empty result.
    """
    sized = stage(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"),
            hashed(id_col).alias("hash"),
        ),
        "sized",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = stage(row_index(stage(sources, "sources"), [], ["source"], "place"), "places")
    target = targets(ranked, weights, share, most)
    whole = F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0).cast("long"))
    left = F.col("target") - F.col("whole") * F.col("source_size")
    plan = stage(target.withColumn("whole", whole).withColumn("left", left), "targets")

    shift = BITS - LEVEL
    rows, bound = sized, stage(_boundary(sized, plan, shift), "boundary")
    while True:
        on = bound.select("source", F.col("prefix"), F.col("left").alias("budget"))
        inside = left_join(rows.drop("budget", "prefix"), on, "source")
        rows = stage(inside.filter(F.shiftright("hash", shift) == F.col("prefix")), "inside")
        if shift == 0 or (bound.agg(F.max("rows")).first()[0] or 0) <= 1:
            break
        shift -= LEVEL
        bound = stage(_boundary(rows, bound, shift), "boundary")

    edges = left_join(plan, bound.select("source", "prefix"), "source")
    marked = lookup_join(sized, edges, "source", null_safe=True)
    bucket = F.shiftright("hash", shift)
    # No bucket ends the budget: it holds the whole source (or nothing, where there is none).
    below = F.when(F.col("prefix").isNull(), F.col("left") >= F.col("source_size")).otherwise(bucket < F.col("prefix"))
    apart = marked.filter(F.col("prefix").isNull() | (bucket != F.col("prefix"))).withColumn("more", below)
    numbered = left_join(rows, plan, "source")
    upto = cumulative_sum(numbered, "size", ["place"], ["hash", "size", "id"], "upto")
    on_edge = upto.withColumn("more", F.col("upto") - F.col("size") / 2 < F.col("budget"))
    copies = (F.col("whole") + F.col("more").cast("long")).alias("copies")
    columns = [F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies]
    both = apart.select(*columns).unionByName(on_edge.select(*columns))
    return both.withColumn("taken", F.col("size") * F.col("copies"))


def sql() -> str:
    """The same by sorting all rows of a source."""
    return r"""WITH RECURSIVE sized AS (
      SELECT doc_id, source, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS hash,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
      FROM documents),
    sources AS (
      SELECT source, sum(size)::DOUBLE AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
      FROM sized GROUP BY source),
    levels(rest, part) AS (
      SELECT 1.5::DOUBLE * sum(source_size), sum(weight) FROM sources
      UNION
      SELECT (SELECT 1.5::DOUBLE * sum(source_size) FROM sources)
               - coalesce(sum(2 * source_size) FILTER (weight * rest / part > 2 * source_size), 0),
             sum(weight) FILTER (NOT weight * rest / part > 2 * source_size)
      FROM levels, sources GROUP BY rest, part),
    target AS (
      SELECT source, source_size, least(2 * source_size, weight * rest / part) AS target
      FROM sources, (SELECT * FROM levels ORDER BY rest / part DESC NULLS LAST LIMIT 1)),
    rated AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM target),
    cut AS (
      SELECT s.doc_id, s.size, r.source_size, r.target, r.whole,
             sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash, s.size, s.doc_id NULLS LAST ROWS UNBOUNDED PRECEDING)
               - s.size / 2 < r.target - r.whole * r.source_size AS more
      FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (size * (whole + more::INT))::BIGINT AS taken
    FROM cut"""
