"""One batch run: silver, then gold, then metrics and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import DOMAINS, MONITORS, Domain
from ..operators import gold, quality
from ..operators.silver import ingested_after, silver
from ..operators.staging import stage_events
from ..operators.volumes import table_volumes
from ..sources.files import child_names, conform, materialize_all, overwrite_table
from ..sources.tables import UpsertTable
from .adhoc import named_views, register_views
from .checks import STAGING_RULES, full_report

# Fixed value: models that run at the same time.
PARALLEL_MODELS = 4
VIEWS = ("dashboard_opportunities", "stale_opportunities")
# Marts whose volume or schema is watched from run to run.
VOLUME_WATCHED = ("dashboard_opportunities", "opportunities_by_stage", "conversion_by_agent", "conversion_by_product")
SCHEMA_WATCHED = ("dashboard_opportunities", "opportunities_by_stage")
SERIES = ["table_name", "column_name", "metric"]


def silver_table(spark: SparkSession, root: str, domain: Domain) -> UpsertTable:
    return UpsertTable(spark, f"{root}/silver/{domain.name}", domain.key)


def run_silver(
    spark: SparkSession,
    bronze: Callable[[str], DataFrame],
    root: str,
    run_id: int,
    staged_at: datetime | str,
    domains: Iterable[str] = tuple(DOMAINS),
    compact_every: int = 8,
) -> None:
    """Bring every silver table up to date with the bronze rows ingested since its last run.

    The ingestion bound comes from what earlier writes observed, and the staging rules are observed on the rows of this run while they
    are written, so neither stored silver nor older bronze is read for them. The outcome of the rules is kept with the run.
    """

    def refresh(name: str) -> tuple[str, dict[str, int | None]]:
        domain = DOMAINS[name]
        table = silver_table(spark, root, domain)
        if table.folded(run_id):
            return name, {}
        fresh = conform(ingested_after(bronze(name), table.bound_before(run_id)), domain.schema)
        rules = {rule: F.count_if(F.col(domain.sk if rule == "row_hash" else rule).isNull()) for rule in STAGING_RULES}
        seen = table.write_batch(silver(stage_events(fresh, staged_at), domain), run_id, rules=rules)
        table.compact_if_worth(compact_every)
        table.remove_folded()
        return name, seen

    # The tables are independent; several at once keep the executors busy between the small ones.
    with ThreadPoolExecutor(PARALLEL_MODELS) as pool:
        seen = dict(pool.map(refresh, domains))
    lines = [(f"staging.{name}", f"not_null:{rule}", found[rule]) for name, found in seen.items() if found for rule in STAGING_RULES]
    if lines:
        report = spark.createDataFrame(lines, "table_name string, check_name string, failures bigint")
        report.withColumn("severity", F.lit("error")).coalesce(1).write.mode("overwrite").parquet(f"{root}/dq_staging/run_id={run_id}")


def staging_outcome(spark: SparkSession, root: str, run_id: int) -> DataFrame:
    """What the staging rules found on the rows of a run, as report lines."""
    path = f"{root}/dq_staging/run_id={run_id}"
    return spark.read.parquet(path).select("check_name", "table_name", "severity", "failures")


def stored_silver(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The silver tables under ``root`` as they are now."""
    return {name: silver_table(spark, root, d).read() for name, d in DOMAINS.items()}


def gold_models(rows: Mapping[str, DataFrame], as_of: date | str) -> dict[str, DataFrame]:
    """All twelve gold relations over the given silver tables."""
    opportunities = gold.dashboard_opportunities(rows["crm"], as_of)
    models = {
        "dashboard_opportunities": opportunities,
        "stale_opportunities": gold.stale_opportunities(opportunities),
        "opportunities_by_stage": gold.opportunities_by_stage(opportunities),
        "conversion_by_agent": gold.conversion(opportunities, "agent"),
        "conversion_by_product": gold.conversion(opportunities, "product"),
        "booking_overview": gold.booking_overview(rows["booking"]),
        "customer_overview": gold.customer_overview(rows["customer"]),
    }
    for monitor, names in MONITORS.items():
        models[f"{monitor}_event_monitor"] = gold.event_monitor({n: rows[n] for n in names})
    return models


def run_gold(
    spark: SparkSession, root: str, as_of: date | str, rows: Mapping[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Rebuild the gold tables; the two date-dependent relations stay views.

    ``rows`` are silver tables read before, so that a run merges each of them once. The views users query stand on the
    stored tables, not on these copies.
    """
    stored = gold_models(stored_silver(spark, root), as_of)
    models = stored if rows is None else gold_models(rows, as_of)

    def rebuild(name: str) -> None:
        overwrite_table(models[name], f"{root}/gold/{name}")

    tables = [name for name in models if name not in VIEWS]
    with ThreadPoolExecutor(PARALLEL_MODELS) as pool:
        list(pool.map(rebuild, tables))
    kept = {n: spark.read.parquet(f"{root}/gold/{n}") for n in tables}
    register_views(named_views({n: stored[n] if n in VIEWS else kept[n] for n in models}))
    return {n: models[n] if n in VIEWS else kept[n] for n in models}


def run_metrics(spark: SparkSession, root: str, models: dict[str, DataFrame], run_id: int, run_at: datetime | str):
    """Keep row counts, column metrics and schemas of this run for the monitors of later runs."""
    counts = table_volumes(models).select(
        "table_name",
        F.lit("").alias("column_name"),
        F.lit("row_count").alias("metric"),
        F.col("row_count").cast("double").alias("value"),
    )
    columns = quality.column_metrics(models["dashboard_opportunities"], ["value"]).select(
        F.lit("dashboard_opportunities").alias("table_name"), "column_name", "metric", "value"
    )
    run = counts.unionByName(columns).withColumn("run_at", F.lit(run_at).cast("timestamp"))
    run.coalesce(1).write.mode("overwrite").parquet(f"{root}/dq_metrics/run_id={run_id}")
    # One row for each series stands for its whole past, so a run costs the same however long the history.
    now = quality.moments(spark.read.parquet(f"{root}/dq_metrics/run_id={run_id}"), SERIES)
    state = quality.merge_moments(moments_before(spark, root, run_id), now, SERIES)
    state.coalesce(1).write.mode("overwrite").parquet(f"{root}/dq_moments/run_id={run_id}")
    schemas = {name: quality.schema_snapshot(models[name]) for name in SCHEMA_WATCHED}
    kept = gold.tagged_union(schemas, "table_name", "column_name", "data_type")
    kept.coalesce(1).write.mode("overwrite").parquet(f"{root}/dq_schemas/run_id={run_id}")


def history(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/dq_metrics")


def _last_run_before(spark: SparkSession, folder: str, run_id: int) -> int | None:
    runs = [int(n.partition("=")[2]) for n in child_names(spark, folder) if n.startswith("run_id=")]
    return max((n for n in runs if n < run_id), default=None)


def moments_before(spark: SparkSession, root: str, run_id: int) -> DataFrame:
    """Moments of every watched series over all runs before one."""
    schema = "table_name string, column_name string, metric string, n bigint, mean double, squares double"
    last = _last_run_before(spark, f"{root}/dq_moments", run_id)
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{root}/dq_moments/run_id={last}")


def anomaly_report(spark: SparkSession, root: str, run_id: int) -> DataFrame:
    """What the monitors say about one run, given the runs before it: one warning row per series or table."""
    run = spark.read.parquet(f"{root}/dq_metrics/run_id={run_id}")
    watched = (F.col("metric") != "row_count") | F.col("table_name").isin(*VOLUME_WATCHED)
    scored = quality.score_against(run.filter(watched), moments_before(spark, root, run_id), SERIES)
    name = F.concat(F.lit("column_anomaly:"), "column_name", F.lit("."), "metric")
    scored = scored.withColumn("check_name", F.when(F.col("metric") == "row_count", "volume_anomaly").otherwise(name))
    found = [
        scored.select(
            "check_name",
            "table_name",
            F.lit("warn").alias("severity"),
            F.when(F.col("status") == "anomaly", 1).otherwise(0).cast("long").alias("failures"),
        )
    ]
    schemas = spark.read.parquet(f"{root}/dq_schemas")
    last = _last_run_before(spark, f"{root}/dq_schemas", run_id)
    last = run_id if last is None else last
    for name in SCHEMA_WATCHED:
        snapshots = [schemas.filter((F.col("run_id") == n) & (F.col("table_name") == name)) for n in (last, run_id)]
        found.append(quality.failure_count(quality.dq_schema_change(*snapshots), "schema_change", name, "warn"))
    return quality.dq_report(found)


def run_checks(
    spark: SparkSession, root: str, rows: Mapping[str, DataFrame], models: dict[str, DataFrame], run_id: int
) -> None:
    """Store the outcome of every declared check and monitor on this run's tables."""
    staging = staging_outcome(spark, root, run_id)
    report = quality.dq_report([staging, full_report({}, rows, models), anomaly_report(spark, root, run_id)])
    report.coalesce(1).write.mode("overwrite").parquet(f"{root}/dq_report/run_id={run_id}")


def medallion_run(
    spark: SparkSession,
    bronze: Callable[[str], DataFrame],
    root: str,
    run_id: int,
    staged_at: datetime | str,
    as_of: date | str,
) -> DataFrame:
    """Silver, gold, metrics and checks in that order; returns the rows per silver and gold relation.

    ``run_id`` must grow from run to run. Repeating one is safe: it replaces its own silver batch.
    """
    run_silver(spark, bronze, root, run_id, staged_at)
    rows = stored_silver(spark, root)
    # Typed tables feed several marts and checks: base and log are merged once and written.
    rows |= materialize_all({n: rows[n] for n in DOMAINS if DOMAINS[n].typed}, "merged")
    models = run_gold(spark, root, as_of, rows)
    run_metrics(spark, root, models, run_id, staged_at)
    run_checks(spark, root, rows, models, run_id)
    tables = {f"silver.{n}": df for n, df in rows.items()}
    tables |= {f"gold.{n}": df for n, df in models.items()}
    return table_volumes(tables)
