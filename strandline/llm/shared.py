"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import configure, fresh_path

#: Texts that travel to a Python worker at once; they may be long.
BATCH = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the library, and small batches for Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return configure(spark)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder, compressed, and read it back.

    The written table outlives lost executors, is counted by the optimizer at
    its true size, and fixes whatever a recomputation could number differently.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str) -> Column:
    """The text column with NULL as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Bits of a filter.  A constant: what is broadcast stays at 8 MB whatever the
#: data.  A crowded filter lets more rows through and never drops one.
FILTER_BITS = 1 << 26
_CHUNK = 32768


def _slot(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def bit_filter(df: DataFrame, *keys: str) -> DataFrame:
    """A hashed bit set of the keys, as at most 2048 rows of 4 KB."""
    slot = _slot([F.col(k) for k in keys])
    return (
        df.select(slot.alias("slot"))
        .groupBy((F.col("slot") / _CHUNK).cast("int").alias("__chunk"))
        .agg(F.bitmap_construct_agg(F.col("slot") % _CHUNK).alias("__bits"))
    )


def mark_members(df: DataFrame, bits: DataFrame, keys: list[Column], flag: str) -> DataFrame:
    """Add ``flag``: false if the keys are certainly not in the filter."""
    df = df.withColumn("__slot", _slot(keys))
    chunk = (F.col("__slot") / _CHUNK).cast("int")
    joined = df.withColumn("__chunk", chunk).join(F.broadcast(bits), "__chunk", "left")
    at = (F.col("__slot") % _CHUNK).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(__byte, int(__slot % 8)) & 1")
    return (
        joined.withColumn("__byte", byte)
        .withColumn(flag, F.coalesce(bit == 1, F.lit(False)))
        .drop("__slot", "__chunk", "__bits", "__byte")
    )


def sampled(df: DataFrame, key: Column, want: int, of: int) -> DataFrame:
    """The ``want`` rows with the least hashes of ``key``, of ``of`` rows in all.

    Rows that are surely not among them go before the sort, so that what meets
    in its last task is about ``want`` rows and not ``want`` from every task.
    """
    hashed = F.xxhash64(key)
    share = (1.2 * want + 1000) / max(1, of)
    if share < 1:
        df = df.filter(hashed < F.lit(int(share * 2**64) - 2**63))
    return df.orderBy(hashed, key).limit(want)
