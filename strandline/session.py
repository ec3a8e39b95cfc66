"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on: UTC wall clock and adaptive execution.

    ANSI mode is left on; divisions and casts that may fail use ``try_*``.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # also where the rows are grouped again afterwards: a hot key is worth one more shuffle
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    _share_package(spark)
    return spark


def _share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Executors on other machines need it installed, or shipped with ``--py-files``.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])


def shared_root(spark: SparkSession) -> str:
    """Folder for staged tables that all executors share.

    ``spark.checkpoint.dir`` of the session, else a folder in its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged").rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/strandline/{app}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage in a way that survives the loss of executors, keeps
    column pruning for the readers, and gives Catalyst the true size of the
    table, so that it broadcasts a small one and shuffles a large one.
    """
    if is_staged(df):
        return df
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._strandline_staged = True
    return staged


def is_staged(df: DataFrame) -> bool:
    return getattr(df, "_strandline_staged", False)
