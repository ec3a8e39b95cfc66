"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each level groups narrow keys (partial counts before the shuffle, so a group of
any size costs one row per task) and keeps the keys that occur twice.  The next
level looks only at rows whose key survived.  Survivors are known to every task
through a bit filter of constant size: a false positive is hashed for nothing,
and the last level compares SHA-256 and length, so that it changes no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import bit_filter, mark_members, stage, text_of

#: Characters of the prefix that the second level hashes.
PREFIX = 256


def _twice(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def find_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, prefix: int = PREFIX
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; NULL counts as empty.  Of equal texts the row
    with the largest id stays (a NULL id is the smallest); of rows that repeat
    both text and id exactly one stays.  ``text_sha256`` is NULL for texts that
    an earlier level proved unique, unless ``digest_all``.  Other columns of
    ``docs`` are not looked at.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    size = F.octet_length("__text").alias("__size")
    lengths = bit_filter(_twice(rows.select(size), "__size"), "__size")

    level1 = mark_members(rows.select("__id", "__text", size), lengths, [F.col("__size")], "__alike")
    head = F.when(F.col("__alike"), F.xxhash64(F.substring("__text", 1, prefix))).alias("__head")
    level2 = level1.select("__id", "__text", "__size", head)
    heads = bit_filter(
        _twice(level2.filter("__head is not null").select("__size", "__head"), "__size", "__head"), "__size", "__head"
    )

    marked = mark_members(level2, heads, [F.col("__size"), F.col("__head")], "__maybe")
    full = F.sha2("__text", 256)
    hashed = stage(
        marked.select(
            "__id",
            "__size",
            "__maybe",
            (full if digest_all else F.when(F.col("__maybe"), full)).alias("__sha"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        "exact-rows",
    )
    groups = stage(
        hashed.filter("__maybe")
        .groupBy("__size", "__sha")
        .agg(F.count("*").alias("__n"), F.max(F.struct("__id", "__row")).alias("__keep"))
        .filter("__n > 1"),
        "exact-groups",
    )
    alone = hashed.filter("not __maybe").select(
        F.col("__id").alias(id_col),
        F.col("__id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )
    grouped = (
        hashed.filter("__maybe")
        .join(groups, ["__size", "__sha"], "left")
        .select(
            F.col("__id").alias(id_col),
            F.when(F.col("__n").isNull(), F.col("__id")).otherwise(F.col("__keep.__id")).alias("keep_id"),
            F.coalesce("__n", F.lit(1).cast("long")).alias("group_size"),
            (F.col("__n").isNull() | (F.col("__row") == F.col("__keep.__row"))).alias("kept"),
            F.col("__sha").alias("text_sha256"),
        )
    )
    return alone.unionByName(grouped)


def drop_rows(docs: DataFrame, dropped: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """``docs`` without the rows whose keys are in ``dropped``.

    A bit filter on the id lets nearly all other rows pass without a shuffle;
    only possible members meet ``dropped`` in a join.
    """
    bits = bit_filter(dropped, id_col)
    marked = mark_members(docs, bits, [F.col(id_col)], "__maybe")
    on = F.lit(True)
    right = dropped.select(*[F.col(k).alias(f"__r_{k}") for k in keys])
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    clear = marked.filter("not __maybe").drop("__maybe")
    checked = marked.filter("__maybe").drop("__maybe").join(right, on, "left_anti")
    return clear.select(*docs.columns).unionByName(checked.select(*docs.columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts (see ``find_copies``)."""
    found = stage(
        find_copies(docs, id_col, text_col).filter("group_size > 1").select(id_col, "text_sha256", "kept"),
        "exact-decisions",
    )
    # Rows that repeat text and id are told apart by nothing: one of them stays.
    gone = found.groupBy(id_col, "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    gone = stage(gone.filter("not kept or n > 1"), "exact-gone")
    sha = "__sha"
    bits = bit_filter(gone, id_col)
    marked = mark_members(docs, bits, [F.col(id_col)], "__maybe")
    clear = marked.filter("not __maybe").drop("__maybe")
    maybe = marked.filter("__maybe").drop("__maybe").withColumn(sha, F.sha2(text_of(text_col), 256))
    right = gone.select(F.col(id_col).alias("__r_id"), F.col("text_sha256").alias("__r_sha"), F.col("kept").alias("__r_kept"))
    joined = maybe.join(right, maybe[id_col].eqNullSafe(F.col("__r_id")) & (F.col(sha) == F.col("__r_sha")), "left")
    stay = joined.filter("__r_sha is null").select(*docs.columns)
    one = joined.filter("__r_kept").dropDuplicates([id_col, sha]).select(*docs.columns)
    return clear.select(*docs.columns).unionByName(stay).unionByName(one)
