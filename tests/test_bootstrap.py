"""Bootstrapped hour-of-day intervals: weights, partitioning, and nearness to normal theory."""

from pyspark.sql import functions as F

from strandline.operators.resample import diurnal_bootstrap, diurnal_profile, poisson_weight


def test_weights_are_poisson(spark):
    w = spark.range(20_000).select(poisson_weight(F.col("id"), F.lit(3), 1).alias("w"))
    r = w.agg(F.avg("w"), F.var_samp("w"), F.avg((F.col("w") == 0).cast("double"))).first()
    assert abs(r[0] - 1) < 0.03 and abs(r[1] - 1) < 0.05 and abs(r[2] - 0.3679) < 0.02


def test_any_partitioning_gives_the_same(spark):
    hour = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id % 5))")
    df = spark.range(3000).select(
        "id", hour.alias("ts"), F.when(F.col("id") % 7 > 0, F.sin("id") * 3 + F.col("id") % 5).alias("v"), F.lit("x").alias("n")
    )
    found = []
    for parts in (1, 7, 40):
        out = diurnal_bootstrap(df.repartition(parts), "v", "id", replicates=60).orderBy("hour").collect()
        found.append([(r.hour, r.n, *(round(x, 9) for x in (r["mean"], r.lower, r.upper))) for r in out])
    assert found[0] == found[1] == found[2] and len(found[0]) == 5
    normal = {r.hour: r for r in diurnal_profile(df, ["v"]).collect()}
    for hour, n, mean, lower, upper in found[0]:
        own = normal[hour]
        assert n == own.n and abs(mean - own["mean"]) < 1e-9 and lower < mean < upper
        assert 0.6 < (upper - lower) / (own.upper - own.lower) < 1.4


def test_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(1, "2024-01-01 05:00:00", None), (2, "2024-01-01 06:00:00", 2.0)], "id int, t string, v double")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert [(r.hour, r["mean"], r.lower, r.upper, r.n) for r in diurnal_bootstrap(df, "v", "id").collect()] == [(6, 2.0, 2.0, 2.0, 1)]
    assert diurnal_bootstrap(df.limit(0), "v", "id").count() == 0
