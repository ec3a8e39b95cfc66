import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from strandline import configure

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    configure(session)
    # several chunks even on tiny data, so that every carry between chunks is used
    session.conf.set("strandline.chunks", "5")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    from tools.check_catalog import duck as connect

    return connect(SF)


@pytest.fixture
def series(spark):
    """Build a frame (series, ts, n, <columns>) with one row per minute and series."""

    def build(columns: dict, name: str = "a", start: str = "2024-09-10 00:00:00", step: str = "1 minute"):
        import datetime as dt

        from pyspark.sql import functions as F

        base = dt.datetime.fromisoformat(start)
        unit = {"1 minute": 60, "1 hour": 3600}[step]
        size = len(next(iter(columns.values())))
        rows = [
            (name, base + dt.timedelta(seconds=unit * i), i, *[v[i] for v in columns.values()])
            for i in range(size)
        ]
        kind = {int: "int", float: "double", str: "string"}
        ddl = "series string, ts timestamp, n int, " + ", ".join(
            f"{c} {kind[next((type(x) for x in v if x is not None), float)]}"
            for c, v in columns.items()
        )
        df = spark.createDataFrame(rows, ddl)
        return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    return build
