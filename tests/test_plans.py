"""Plans of the registered queries: what must be pushed down, pre-aggregated or avoided."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from assayer.catalogue import DOMAINS
from assayer.operators import gold
from assayer.operators import silver as sv
from assayer.operators.staging import stage_events
from assayer.plans import bindings
from assayer.sources.files import append_bronze, scan_source

WRITES = {"append_bronze", "fanout_bronze", "full_refresh", "medallion_run", "stream_ingest", "stream_upsert_latest",
          "stream_replay_dedup"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bronze(spark, tmp_path_factory, sf_dir):
    path = str(tmp_path_factory.mktemp("bronze") / "crm")
    bindings.bronze(spark, sf_dir, "crm").write.parquet(path)
    return spark.read.schema(DOMAINS["crm"].schema).parquet(path)


@pytest.mark.parametrize("name", sorted(set(spark_entry.queries()) - WRITES))
def test_no_cross_join_no_python_and_no_single_task_sort(spark, sf_dir, name):
    text = plan(spark_entry.queries()[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text


def test_latest_keeps_one_row_per_key_before_the_shuffle(bronze):
    text = plan(sv.silver(stage_events(bronze, "2024-02-01"), DOMAINS["crm"]))
    assert re.search(r"WindowGroupLimit .*Final[\s\S]*Exchange hashpartitioning[\s\S]*WindowGroupLimit .*Partial", text)


def test_hot_key_shuffles_one_row_per_task(spark):
    """A third of the rows share a key, another third has none."""
    rows = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"),
        F.col("id").alias("v"),
    )
    best = sv.latest(rows, "k", [F.col("v").desc()])
    found = {r.k: r.v for r in best.filter("k IS NULL OR k = 'hot'").collect()}
    assert found == {None: 29_999, "hot": 29_997}
    assert best.count() == 10_002


def test_incremental_bound_reaches_the_scan(bronze):
    stored = bronze.filter("ingested_at < '2024-01-20'")
    text = plan(sv.incremental_filter(bronze, stored))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(ingested_at,2024-01-19", text)


def test_incremental_read_skips_whole_days(spark, bronze, tmp_path):
    append_bronze(bronze, str(tmp_path / "t"), DOMAINS["crm"].schema, by_day=True)
    rows = scan_source(spark, str(tmp_path / "t"), DOMAINS["crm"].schema)
    fresh = sv.incremental_filter(rows, bronze.filter("ingested_at < '2024-01-20'"))
    assert re.search(r"PartitionFilters: \[[^\]]*ingest_date#\d+ >= 2024-01-19", plan(fresh))
    assert fresh.count() == bronze.filter("ingested_at >= '2024-01-20'").count()


def test_marts_read_only_their_columns_and_aggregate_before_the_shuffle(spark, bronze, tmp_path):
    sv.silver(stage_events(bronze, "2024-02-01"), DOMAINS["crm"]).write.parquet(str(tmp_path / "s"))
    mart = gold.conversion(gold.dashboard_opportunities(spark.read.parquet(str(tmp_path / "s")), "2024-01-31"), "agent")
    text = plan(mart)
    assert "ReadSchema: struct<opportunity_id:string,stage:string,agent_id:string,value:double>" in text
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_normalising_stays_in_generated_code(spark, bronze):
    view = gold.dashboard_opportunities(
        bronze.select("*", F.lit(None).cast("timestamp").alias("staged_at"))
        .withColumns({"updated_at": F.lit(None).cast("timestamp"), "expected_close_date": F.lit(None).cast("date")}),
        "2024-01-31",
    )
    lines = [line for line in plan(view).splitlines() if "Project" in line]
    assert lines and all(re.match(r"\s*(:|\+|-| )*\*\(\d+\) Project", line) for line in lines)


def test_upsert_leaves_keyless_rows_out_of_the_join(spark, tmp_path):
    rows = spark.range(100).select(F.when(F.col("id") > 30, F.col("id").cast("string")).alias("k"), "id")
    rows.write.parquet(str(tmp_path / "t"))
    target = spark.read.parquet(str(tmp_path / "t"))
    text = plan(sv.upsert_latest(target, target.limit(5), "k"))
    assert "LeftAnti" in text and "PushedFilters: [IsNull(k)]" in text and "PushedFilters: [IsNotNull(k)]" in text


def test_message_is_parsed_once(spark, sf_dir):
    text = plan(spark_entry.queries()["require_fields"](spark, sf_dir))
    assert text.count("from_json") == 1


def test_monitor_counts_without_a_key(spark, tmp_path):
    spark.range(9).selectExpr("id", "timestamp_micros(id) AS ingested_at", "timestamp_micros(id) AS staged_at").write.parquet(
        str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    text = plan(gold.event_monitor({"fraud": stored, "seat": stored}))
    assert "Exchange hashpartitioning" not in text and text.count("HashAggregate(keys=[]") == 4
    assert "ReadSchema: struct<ingested_at:timestamp,staged_at:timestamp>" in text
