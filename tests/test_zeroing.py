"""One scan for several codes against a scan for each, over many chunks."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.ordered import around, number_runs, run_ids
from strandline.plans import zeroing
from strandline.plans.zeroing import Cutover, Method

KEYS, ORDER = ["series"], ["ts", "n"]


def frame(spark, n, seed):
    r = random.Random(seed)
    state = {"a": [0, 0], "b": [1, 0]}
    rows = []
    for i in range(n):
        s = r.choice("aab")
        for k in (0, 1):
            if r.random() < (0.1, 0.4)[k]:
                state[s][k] = r.choice([0, 0, 1, 2, None])
        rows.append((s, f"2024-09-{15 + i * 3 // n:02d} {i % 24:02d}:00:00", i, *state[s], r.choice([None, 1.0, 2.5, 4.0]), r.random(), r.choice([0, 0, 1, 2, 3])))
    df = spark.createDataFrame(rows, "series string, t string, n int, x int, y int, ch1 double, ch2 double, flag int")
    return df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")


def test_runs_of_two_codes(spark):
    df = frame(spark, 400, 1)
    both = {r.n: r for r in number_runs(df, {"p_": "x", "q_": "y"}, KEYS, ORDER).collect()}
    for name, code in (("p_", "x"), ("q_", "y")):
        for r in run_ids(df, code, KEYS, ORDER, begun="begun").collect():
            mine = both[r.n]
            assert (mine.idx, mine[f"{name}run_id"], mine[f"{name}begun"]) == (r.idx, r.run_id, r.begun)


def test_values_around(spark):
    df = frame(spark, 200, 2)
    got = around(df, ["ch1"], KEYS, ORDER).orderBy("series", "ts", "n").collect()
    for s in "ab":
        rows = [r for r in got if r.series == s]
        known = [(i, r.ch1) for i, r in enumerate(rows) if r.ch1 is not None]
        for i, r in enumerate(rows):
            def last(pairs):
                return pairs[-1][1] if pairs else None

            assert r["__p_ch1"] == last([k for k in known if k[0] <= i])
            assert r["__pb_ch1"] == last([k for k in known if k[0] < i])
            assert r["__n_ch1"] == last([k for k in reversed(known) if k[0] >= i])
            assert r["__na_ch1"] == last([k for k in reversed(known) if k[0] > i])


@pytest.mark.parametrize("seed", [3, 4])
def test_methods_side_by_side(spark, seed):
    """Two methods in one pass give what each gives alone."""
    df, cut = frame(spark, 500, seed), Cutover("2024-09-16 02:00", "2024-09-16")
    methods = [Method("p_", "x", False), Method("q_", "y", True)]
    both = {r.n: r for r in zeroing.anchored_baselines(df, methods, KEYS, ORDER, cut).collect()}
    for m in methods:
        for r in zeroing.anchored_baseline(df, m.code, KEYS, ORDER, m.strict, cut).collect():
            for c in ("ch1", "ch2"):
                for part in ("zeroes", "zero_3sd", "zeroes_inter1", "zeroes_inter2", "baseline", "zeroed"):
                    a, b = both[r.n][f"{m.name}{c}_{part}"], r[f"{c}_{part}"]
                    assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_no_event(spark):
    df = frame(spark, 50, 5).withColumn("x", F.lit(0))
    out = zeroing.anchored_baselines(df, [Method("", "x", False)], KEYS, ORDER, Cutover())
    assert out.where("ch1_baseline is not null or run_id <> 0").count() == 0 and out.count() == 50
