"""Physical plans hold nothing that a large cluster would choke on."""

import pytest

from catalog.registry import QUERIES

ORDERED = [
    "row_index", "run_ids", "run_length_encode", "fill_down", "fill_up", "cumulative_sum",
    "interpolate_linear", "interpolate_by_regime", "run_midpoint_anchor", "fill_within_regime",
    "pipe_night_zero", "pipe_za_zero", "agg_five_number",
]
JOINED = [
    "interval_flag_join", "regime_join", "mask_by_flag", "left_join_natural", "full_join_natural",
    "impute_group_mean", "pipe_concentration", "pipe_daily_enhancement", "scalar_cross_join",
    "broadcast_dim_join", "step_response_time",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans_of(monkeypatch):
    """All plans of a query: those of the tables it stages on the way, and the last one."""
    from pyspark.sql.readwriter import DataFrameWriter

    staged, write = [], DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        staged.append(plan_of(self._df))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)

    def collect(build) -> list[str]:
        staged.clear()
        last = build()
        return [*staged, plan_of(last)]

    return collect


@pytest.mark.parametrize("name", ORDERED + JOINED)
def test_no_unbounded_operator(spark, sf_dir, plans_of, name):
    for plan in plans_of(lambda: QUERIES[name](spark, sf_dir)):
        for word in ("Cartesian", "NestedLoop", "BatchEvalPython", "ArrowEval", "MapInPandas"):
            assert word not in plan
        # no frame that is recomputed for every row
        assert "currentrow$(), unboundedfollowing$()" not in plan


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_scans_are_split(spark, sf_dir, plans_of, name):
    plans = plans_of(lambda: QUERIES[name](spark, sf_dir))
    assert len(plans) > 1
    assert not any("SinglePartition" in plan for plan in plans)


def test_a_staged_single_partition_is_seen(spark, plans_of):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from strandline.session import stage

    df = spark.range(9).withColumn("n", F.row_number().over(Window.orderBy("id")))
    assert any("SinglePartition" in plan for plan in plans_of(lambda: stage(df)))


def test_hourly_merge_shuffles_each_table_once(spark, sf_dir):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["pipe_merge_hourly"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # one for each of four tables; three for the hour means, which are a broadcast where that is allowed
    assert plan.count("Exchange hashpartitioning") <= 7


def test_rule_lookup_moves_no_data(spark, sf_dir):
    plan = plan_of(QUERIES["interval_flag_join"](spark, sf_dir))
    assert "Join" not in plan
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_carry_join_reuses_the_window_partitioning(spark, sf_dir):
    from catalog.base import KEYS, ORDER, Tables
    from strandline.operators.ordered import fill_down, sequence

    frame = sequence(Tables(spark, sf_dir).signal(), KEYS, ORDER)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(fill_down(frame, ["ch1"], KEYS, ORDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan
    rows_side = plan.split("SortMergeJoin")[1].split("Window [last(__edge")[0]
    assert rows_side.count("Exchange hashpartitioning(series") <= 2


def test_time_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["filter_time_open"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in plan
    narrow = plan_of(QUERIES["project_select"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in narrow


def test_averages_combine_before_the_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["valid_hourly_means"](spark, sf_dir))
    assert plan.count("HashAggregate") == 2 and "partial_avg" in plan


def test_stage_table_prunes_days(spark, sf_dir):
    from catalog.base import Tables
    from strandline.session import fresh_path
    from strandline.sources.files import read_stage_table, write_stage_table

    path = fresh_path(spark, "days")
    write_stage_table(Tables(spark, sf_dir).signal().select("series", "ts", "ch1"), path)
    part = read_stage_table(spark, path, "2024-01-10", "2024-01-11")
    assert "PartitionFilters: [isnotnull(day" in plan_of(part)
    assert part.select("day").distinct().count() == 2
