"""Connected components of a table of links, by alternating star contraction.

Each round replaces a vertex's larger neighbours' links by links to the smallest
vertex it knows (large star), then does the same with the smaller neighbours
(small star).  Minima are taken with partial aggregation; rounds end when the set
of links stays the same.  Every round is written to the shared folder, so that
plans stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import stage


def _minima(links: DataFrame) -> DataFrame:
    """u, v, and m: the smallest of u's neighbours and itself."""
    least = stage(links.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    return links.join(least, "u")


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _minima(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    met = _minima(down)
    return (
        met.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(met.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v: long) to (u, root): every vertex that has a link, with the smallest it can reach."""
    links = stage(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links"
    )
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = None
    while True:
        now = tuple(links.agg(F.count("*"), mark).first())
        if now == before:
            break
        before = now
        links = stage(_small(stage(_large(links), "large")), "small")
    roots = links.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return links.select("u", F.col("v").alias("root")).unionByName(roots)
