"""Registered queries: each operator over the shared tables, as ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalogue import CRM_REQUIRED, DOMAINS, MONITORS, OPAQUE
from ..functions import sales
from ..functions.hashing import JSON_OPTIONS, row_json, surrogate_key
from ..operators import charts, gold, quality, report, volumes
from ..operators import silver as sv
from ..operators.staging import stage_events
from ..session import apply_semantics, scratch_dir
from ..sources import files, messages
from ..sources.tables import UpsertTable
from ..streaming import ingest, upsert
from . import bindings as b
from . import checks
from .adhoc import adhoc_sql, gold_views, named_views
from .medallion import gold_models, medallion_run

Query = Callable[[SparkSession, str], DataFrame]

CRM = DOMAINS["crm"]
CRM_MESSAGE = T.StructType([f for f in CRM.schema if f.name != "ingested_at"])
STAMP = datetime(2024, 1, 31, 12, 0, 0, 123456)


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the checking engine has them."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({name: F.col(f"`{name}`").cast("timestamp_ntz") for name in zoned}) if zoned else df


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Sums of doubles depend on the order of addition; rounding makes them comparable."""
    return df.withColumns({column: F.round(column, d) for column, d in digits.items()})


def _money(mart: DataFrame) -> DataFrame:
    return rounded(mart, total_pipeline_value=2, won_value=2)


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return sv.clean_opportunities(b.staged(spark, sf, "crm"))


def _on_opportunities(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(b.opportunities(spark, sf))


def _on_cleaned(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(_cleaned(spark, sf))


def _on_volumes(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(volumes.table_volumes(b.tables(spark, sf)))


def _on_stage_mart(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_opportunities(lambda o: build(gold.opportunities_by_stage(o)))


def _on_conversion(by: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_opportunities(lambda o: build(gold.conversion(o, by)))


def _monitor(group: str) -> Query:
    names = MONITORS[group]
    return lambda spark, sf: gold.event_monitor({n: b.opaque_index(spark, sf, n) for n in names})


def _deals(keep: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_opportunities(lambda o: keep(o).select(*gold.OPPORTUNITY_COLUMNS))


# Sources and sinks


def _parse(spark: SparkSession, sf: str) -> DataFrame:
    return messages.parse_json_events(b.mixed_messages(spark, sf), CRM_MESSAGE, CRM_REQUIRED)


def _rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Prose, messages without a required key, and messages with values that cannot be cast."""
    sent = b.mixed_messages(spark, sf).unionByName(b.faulty_messages(spark, sf))
    return messages.rejected_messages(sent, CRM_MESSAGE, CRM_REQUIRED)


def _require(spark: SparkSession, sf: str) -> DataFrame:
    complete = messages.require_fields(b.crm_messages(spark, sf, keep_nulls=False), CRM_REQUIRED)
    return messages.parse_json_events(complete, CRM_MESSAGE)


def _stamp(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.bronze(spark, sf, "crm")
    stamped = messages.stamp_ingested_at(rows, STAMP).withColumn("exact", F.col("ingested_at"))
    seconds = messages.stamp_ingested_at(stamped, STAMP, "second")
    return seconds.select(
        "opportunity_id",
        "updated_at",
        "value",
        F.col("exact").alias("ingested_at"),
        F.col("ingested_at").alias("ingested_second"),
    )


def _append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "bronze-booking")
    rows = b.bronze(spark, sf, "booking")
    schema = DOMAINS["booking"].schema
    files.create_if_missing(spark, path, schema)
    split = F.col("ingested_at") < F.lit("1998-01-01").cast("timestamp")
    files.append_bronze(rows.filter(split), path, schema)
    files.append_bronze(rows.filter(~split), path, schema)
    return files.scan_source(spark, path, schema)


def _topic_messages(spark: SparkSession, sf: str, domain: str) -> DataFrame:
    rows = b.bronze(spark, sf, domain).drop("ingested_at")
    return rows.select(F.lit(domain).alias("topic"), F.to_json(F.struct("*"), JSON_OPTIONS).alias("value"))


def _fanout(spark: SparkSession, sf: str) -> DataFrame:
    landing, root, state = (scratch_dir(spark, f"fanout-{part}") for part in ("landing", "bronze", "state"))
    sent = [_topic_messages(spark, sf, name) for name in DOMAINS]
    # Prose sent to a known topic and properties sent to an unknown one.
    sent.append(b.table(spark, sf, "documents").select(F.lit("review").alias("topic"), F.col("text").alias("value")))
    sent.append(b.table(spark, sf, "events").select(F.lit("telemetry").alias("topic"), F.col("props").alias("value")))
    reduce(DataFrame.unionByName, sent).write.parquet(landing)
    stream = messages.message_stream(spark, "parquet", "topic string, value string", path=landing)
    ingest.fanout_bronze(stream, root, state).awaitTermination()
    # Whole rows but for the stamp, as text: the column lists differ.
    read = {
        n: ingest.read_fanout(spark, root, d).select(row_json([c for c in d.schema.names if c != "ingested_at"]).alias("row"))
        for n, d in DOMAINS.items()
    }
    placed = gold.tagged_union(read, "domain", "row").withColumn("reject_reason", F.lit(None).cast("string"))
    rest = ingest.read_quarantine(spark, root)
    return placed.unionByName(rest.select(F.col("topic").alias("domain"), F.col("value").alias("row"), "reject_reason"))


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType.fromDDL(
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    )
    return files.scan_source(spark, f"{sf}/events.parquet", schema)


def _adhoc(spark: SparkSession, sf: str) -> DataFrame:
    sql = """SELECT region, count(*) AS overdue, round(sum(value), 2) AS overdue_value
        FROM gld_dashboard_opportunities WHERE days_until_expected_close < 0 GROUP BY region"""
    return adhoc_sql(spark, sql, gold_views(b.opportunities(spark, sf)))


def _adhoc_marts(spark: SparkSession, sf: str) -> DataFrame:
    """One statement over marts of three subjects."""
    sql = """SELECT 'bookings' AS subject, sum(total_bookings) AS records FROM gld_booking_overview
        UNION ALL SELECT 'customers', sum(total_customers) FROM gld_customer_overview
        UNION ALL SELECT domain, total_events FROM gld_partner_event_monitor WHERE total_events > 0"""
    return adhoc_sql(spark, sql, named_views(gold_models(b.all_silver(spark, sf), b.AS_OF)))


def _sorted(opportunities: DataFrame) -> DataFrame:
    rank = sales.stage_rank(F.col("stage")).alias("stage_rank")
    return report.sort_by_stage_order(opportunities).select("opportunity_id", "stage", rank)


# Projections


def _staged_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The staged rows of all domains; their columns differ, so they are rendered as text."""
    rows = {n: b.staged(spark, sf, n) for n in DOMAINS}
    rendered = {n: df.select("row_hash", "staged_at", "ingested_at", row_json(DOMAINS[n].schema.names).alias("source")) for n, df in rows.items()}
    return gold.tagged_union(rendered, "domain", "row_hash", "staged_at", "ingested_at", "source")


OPAQUE_COLUMNS = ("event_sk", "staged_at", "ingested_at", "event_payload")


def _opaque_rows(rows: dict[str, DataFrame]) -> DataFrame:
    renamed = {n: df.withColumnRenamed(DOMAINS[n].sk, "event_sk") for n, df in rows.items()}
    return gold.tagged_union(renamed, "domain", *OPAQUE_COLUMNS)


def _payload(spark: SparkSession, sf: str) -> DataFrame:
    return _opaque_rows({n: sv.event_payload(b.staged(spark, sf, n), n) for n in OPAQUE})


def _latest_event(spark: SparkSession, sf: str) -> DataFrame:
    return _opaque_rows({n: b.silver_rows(spark, sf, n) for n in OPAQUE})


def _ages(cleaned: DataFrame) -> DataFrame:
    return gold.opportunity_ages(cleaned, b.AS_OF).select(
        "crm_event_sk", "days_since_update", "days_until_expected_close"
    )


def _stale(cleaned: DataFrame) -> DataFrame:
    aged = gold.opportunity_ages(cleaned, b.AS_OF)
    return aged.select(
        "crm_event_sk",
        gold.is_stale(F.col("stage")).alias("is_stale"),
        gold.is_stale(sales.normalize_stage(F.col("stage"))).alias("is_stale_open"),
    )


def _normalized(column: str, name: str, rule: Callable) -> Query:
    return _on_cleaned(
        lambda c: c.select("crm_event_sk", F.col(column).alias("source"), rule(F.col(column)).alias(name))
    )


# Incremental maintenance


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    split = F.col("ingested_at") < F.lit(b.SPLIT_AT).cast("timestamp")
    return rows.filter(split), rows.filter(~split)


def _incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Rows newer than a silver table, by the bound it observed while it was written."""
    rows = b.bronze(spark, sf, "crm")
    table = UpsertTable(spark, scratch_dir(spark, "bounded"), CRM.key)
    table.write_batch(sv.silver(stage_events(_halves(rows)[0], b.STAGED_AT), CRM), 1)
    return sv.ingested_after(rows, table.bound_before(2))


def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A bucketed base of the stored half, the other half as a batch of its log."""
    table = UpsertTable(spark, scratch_dir(spark, "upserted"), CRM.key)
    stored, fresh = _halves(_cleaned(spark, sf))
    table.write_batch(sv.latest_opportunity(stored), 1)
    table.compact()
    table.write_batch(sv.latest_opportunity(fresh), 2)
    return table.read()


def _late(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over two loads, the second of which delivers the rows of the first again: what it took of the second."""
    landing, root, state, counts = (scratch_dir(spark, f"late-{part}") for part in ("landing", "silver", "state", "counts"))
    table = UpsertTable(spark, root, CRM.key)
    rows = b.bronze(spark, sf, "crm")
    last = -1
    for load in (_halves(rows)[0], rows):
        before = last
        load.write.mode("append").parquet(landing)
        stream = messages.message_stream(spark, "parquet", CRM.schema, path=landing)
        upsert.stream_upsert_latest(stream, CRM, table, state, b.STAGED_AT, counts=counts).awaitTermination()
        last = table.last_batch()
    found = upsert.stream_late_rows(spark, counts).filter(F.col("batch_id") > before)
    return found.agg(F.sum("accepted_rows").alias("accepted_rows"), F.sum("late_rows").alias("late_rows"))


def _new_columns(spark: SparkSession, sf: str) -> DataFrame:
    stored = b.table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    batch = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return sv.append_new_columns(stored, batch)


def _full_refresh(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "gold-conversion")
    mart = gold.conversion(b.opportunities(spark, sf), "agent")
    files.overwrite_table(mart, path)
    files.overwrite_table(mart, path)
    return _money(files.scan_source(spark, path))


def _medallion(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every table a run builds, and what its marts hold: one line per key and measure."""
    apply_semantics(spark)
    root = scratch_dir(spark, "medallion")
    counts = medallion_run(spark, lambda name: b.bronze(spark, sf, name), root, 1, b.STAGED_AT, b.AS_OF)
    lines = [counts.select("table_name", F.lit("").alias("key"), F.lit("rows").alias("measure"), F.col("row_count").cast("double").alias("value"))]
    for mart, (keys, measures) in b.MART_CONTENT.items():
        rows = spark.read.parquet(f"{root}/gold/{mart}")
        key = F.concat_ws("|", *[F.coalesce(k, F.lit("~")) for k in keys])
        pairs = []
        for name, digits in measures.items():
            number = F.unix_micros(name).cast("double") if digits is None else F.round(F.col(name).cast("double"), digits)
            pairs.append(F.struct(F.lit(name).alias("measure"), number.alias("value")))
        lines.append(rows.select(F.lit(f"gold.{mart}").alias("table_name"), key.alias("key"), F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionByName, lines)


# Streams


def _stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    landing, out, state = (scratch_dir(spark, f"ingest-{part}") for part in ("landing", "bronze", "state"))
    b.mixed_messages(spark, sf).write.parquet(landing)
    stream = messages.message_stream(spark, "parquet", "value string", path=landing)
    ingest.stream_ingest(stream, CRM.schema, out, state, CRM_REQUIRED).awaitTermination()
    return files.scan_source(spark, out, CRM.schema).select(*CRM_MESSAGE.names)


def _stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads into the same stream: the second run resumes at the checkpoint and upserts only the new rows."""
    landing, root, state = (scratch_dir(spark, f"upsert-{part}") for part in ("landing", "silver", "state"))
    table = UpsertTable(spark, root, CRM.key)
    for load in _halves(b.bronze(spark, sf, "crm")):
        load.write.mode("append").parquet(landing)
        stream = messages.message_stream(spark, "parquet", CRM.schema, path=landing)
        upsert.stream_upsert_latest(stream, CRM, table, state, b.STAGED_AT).awaitTermination()
    return table.read()


def _stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    landing, out, state = (scratch_dir(spark, f"dedup-{part}") for part in ("landing", "bronze", "state"))
    rows = b.bronze(spark, sf, "crm")
    rows.unionByName(rows).write.parquet(landing)
    stream = messages.message_stream(spark, "parquet", CRM.schema, path=landing)
    upsert.stream_replay_dedup(stream, out, state, "1 day").awaitTermination()
    return spark.read.schema(CRM.schema).parquet(out)


# Quality


def _not_null(opportunities: DataFrame) -> DataFrame:
    return quality.dq_not_null(opportunities, ["opportunity_id", "stage", "value", "agent", "region"])


def _timestamp_order(spark: SparkSession, sf: str) -> DataFrame:
    """All opaque domains, staged before the newest events came in."""
    wrong = {n: quality.dq_timestamp_order(stage_events(b.bronze(spark, sf, n), b.SPLIT_AT)) for n in OPAQUE}
    rows = {n: sv.distinct_events(df) for n, df in wrong.items()}
    return gold.tagged_union(rows, "domain", "ingested_at", "staged_at")


def _conversion_marts(spark: SparkSession, sf: str) -> dict[str, tuple[str, DataFrame]]:
    """Our two conversion marts, which cannot break a rule, and two reported ones, which do: name → (key, mart)."""
    deals = b.opportunities(spark, sf)
    marts = {f"by_{by}": (by, gold.conversion(deals, by)) for by in ("agent", "product")}
    return marts | {f"reported_by_{by}": (by, b.reported_mart(spark, sf, by)) for by in ("agent", "product")}


def _won_lte_total(spark: SparkSession, sf: str) -> DataFrame:
    marts = {name: mart for name, (_, mart) in _conversion_marts(spark, sf).items()}
    ours = quality.dq_won_lte_total(marts["by_agent"], marts["by_product"])
    return ours.unionByName(quality.dq_won_lte_total(marts["reported_by_agent"], marts["reported_by_product"]))


def _rate_bounds(spark: SparkSession, sf: str) -> DataFrame:
    counts = ("won_opportunities", "lost_opportunities", "total_opportunities")
    wrong = {
        name: quality.dq_rate_bounds(mart).withColumnRenamed(key, "entity")
        for name, (key, mart) in _conversion_marts(spark, sf).items()
    }
    return gold.tagged_union(wrong, "mart", "entity", *counts)


def _conversion_invariants(spark: SparkSession, sf: str) -> DataFrame:
    found = {n: quality.dq_conversion_invariants(mart, key) for n, (key, mart) in _conversion_marts(spark, sf).items()}
    return gold.tagged_union(found, "mart", *found["by_agent"].columns)


def _payload_json(spark: SparkSession, sf: str) -> DataFrame:
    """The payloads of all opaque domains, properties that are JSON, such with text after them, and prose that is none."""
    prose = b.table(spark, sf, "documents").select(F.col("text").alias("event_payload"))
    props = b.table(spark, sf, "events").select(F.col("props").alias("event_payload"))
    broken = {n: b.broken_json(spark, sf, tail) for n, tail in b.JSON_TAILS.items()}
    # Failing rows are few, and each is dear to find: they are read once and grouped.
    opaque = {n: sv.silver(quality.staged_not_json(b.staged(spark, sf, n)), DOMAINS[n], hash_first=False) for n in OPAQUE}
    return quality.dq_payload_json({"documents": prose, "events": props, **broken, **opaque})


def _payload_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """JSON that lacks both times, JSON that lacks one of them, and payloads that have both."""
    props = b.table(spark, sf, "events").select(F.col("props").alias("event_payload"))
    unstaged = b.bronze(spark, sf, "support").select(row_json(["ticket_id", "ingested_at"]).alias("event_payload"))
    whole = {"support": b.silver_rows(spark, sf, "support")}
    broken = {n: b.broken_json(spark, sf, tail) for n, tail in b.JSON_TAILS.items()}
    return quality.dq_payload_metadata(gold.tagged_union({"events": props, "bronze": unstaged, **broken, **whole}, "model_name", "event_payload"))


def _volume_history(spark: SparkSession, sf: str) -> DataFrame:
    """Events per type and day: every day stands for one run."""
    apply_semantics(spark)
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    daily = b.table(spark, sf, "events").groupBy(F.col("event_type").alias("table_name"), day.alias("run_at"))
    return daily.agg(F.count("*").cast("double").alias("value"))


def _column_history(spark: SparkSession, sf: str) -> DataFrame:
    """Null and zero counts of the deal value per day."""
    day = F.date_trunc("day", "ingested_at")
    daily = b.bronze(spark, sf, "crm").groupBy(day.alias("run_at")).agg(
        F.count_if(F.col("value").isNull()).cast("double").alias("null_count"),
        F.count_if(F.col("value") == 0).cast("double").alias("zero_count"),
    )
    return daily.unpivot("run_at", ["null_count", "zero_count"], "metric", "value").select(
        F.lit("crm").alias("table_name"), F.lit("value").alias("column_name"), "metric", "run_at", "value"
    )


def _moments(spark: SparkSession, sf: str) -> DataFrame:
    """The last day of each series against the moments of the days before, which are merged from two parts."""
    days = _volume_history(spark, sf)
    part = F.when(F.col("run_at") >= F.lit("2024-01-30").cast("timestamp"), 2).otherwise(F.day("run_at") % 2)
    old = [quality.moments(days.filter(part == k), ["table_name"]) for k in (0, 1)]
    merged = quality.merge_moments(*old, ["table_name"])
    return quality.score_against(days.filter(part == 2), merged, ["table_name"])


def _scored(df: DataFrame) -> DataFrame:
    return rounded(df, mean=6, stddev=6, score=6)


def _schema_change(spark: SparkSession, sf: str) -> DataFrame:
    """Columns seen in the payloads of one domain against those of another, as a drift would show them."""
    seen = []
    for name in ("payment", "invoice"):
        rows = b.bronze(spark, sf, name)
        payload = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("event_payload"))
        seen.append(quality.payload_schema(payload))
    return quality.dq_schema_change(*seen)


def _dq_report(spark: SparkSession, sf: str) -> DataFrame:
    """The checks of the typed silver tables and their gold, each table built once."""
    rows = files.materialize_all({n: b.silver_rows(spark, sf, n) for n in ("booking", "crm", "customer")}, "checked")
    deals = files.materialize(gold.dashboard_opportunities(rows["crm"], b.AS_OF), "checked-deals")
    marts = {f"conversion_by_{by}": gold.conversion(deals, by) for by in ("agent", "product")}
    return checks.typed_and_gold_report(rows, {"dashboard_opportunities": deals, **marts})


def _full_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every declared check of the staging, silver and gold layers, over all domains.

    Typed tables are stored, as several checks and marts read them; opaque ones are judged in one pass.
    """
    rows = {n: b.silver_rows(spark, sf, n) for n in DOMAINS}
    rows |= files.materialize_all({n: rows[n] for n in DOMAINS if n not in OPAQUE}, "full")
    models = gold_models(rows, b.AS_OF)
    models["dashboard_opportunities"] = files.materialize(models["dashboard_opportunities"], "full-deals")
    return checks.full_report({n: b.staged(spark, sf, n) for n in DOMAINS}, rows, models)


def _staging_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dq_report([checks.staging_report(b.staged(spark, sf, n), n) for n in DOMAINS])


def _opaque_report(spark: SparkSession, sf: str) -> DataFrame:
    """The checks of all opaque domains, all at once; their rows are judged on the way and not stored."""
    return checks.opaque_report({n: b.silver_rows(spark, sf, n) for n in OPAQUE})


def _chart_win_rate(by: str) -> Query:
    return _on_conversion(by, lambda m: charts.chart_win_rate(m, by).withColumnRenamed("win_rate_pct", "win_rate"))


QUERIES: dict[str, Query] = {
    # Sources and sinks
    "parse_json_events": _parse,
    "rejected_messages": _rejected,
    "require_fields": _require,
    "stamp_ingested_at": _stamp,
    "append_bronze": _append,
    "fanout_bronze": _fanout,
    "add_column_if_missing": lambda s, d: files.add_column_if_missing(b.table(s, d, "supplier"), "ingested_at", "timestamp"),
    "scan_source": _scan,
    "load_opportunities": _on_opportunities(report.load_opportunities),
    "export_json_records": _on_opportunities(
        lambda o: files.json_records(o.select(*gold.OPPORTUNITY_COLUMNS, "updated_at", "ingested_at"))
    ),
    "adhoc_sql": _adhoc,
    "adhoc_sql_marts": _adhoc_marts,
    # Projections and filters
    "stage_events": _staged_rows,
    "clean_bookings": lambda s, d: sv.clean_bookings(b.staged(s, d, "booking")),
    "clean_opportunities": _cleaned,
    "clean_customers": lambda s, d: sv.clean_customers(b.staged(s, d, "customer")),
    "event_payload": _payload,
    "normalize_stage": _normalized("stage", "stage", sales.normalize_stage),
    "normalize_product": _normalized("product", "product", sales.normalize_product),
    "normalize_agent": _normalized("agent_id", "agent", sales.normalize_agent),
    "opportunity_ages": _on_cleaned(_ages),
    "opportunity_is_stale": _on_cleaned(_stale),
    "dashboard_opportunities": b.opportunities,
    "stale_opportunities": _on_opportunities(gold.stale_opportunities),
    "win_probability": _on_opportunities(
        lambda o: report.with_forecast(o).select("opportunity_id", "stage", "win_prob")
    ),
    "weighted_value": _on_opportunities(
        lambda o: rounded(report.with_forecast(o), weighted_value=6).select(
            "opportunity_id", "stage", "value", "weighted_value"
        )
    ),
    "close_bucket": _on_opportunities(
        lambda o: report.with_forecast(o).select("opportunity_id", "days_until_expected_close", "close_bucket")
    ),
    "overdue_deals": _deals(report.overdue_deals),
    "overdue_count": _on_opportunities(lambda o: report.overdue_deals(o).agg(F.count("*").alias("overdue"))),
    "closing_this_week": _deals(report.closing_this_week),
    "closing_this_month": _deals(report.closing_this_month),
    "idle_deals": _deals(report.idle_deals),
    "win_rate_band": _on_conversion(
        "agent",
        lambda m: m.select(
            "agent",
            "win_rate_pct",
            sales.win_rate_band(F.col("win_rate_pct")).alias("band"),
            sales.low_win_rate(F.col("win_rate_pct")).alias("low_win_rate"),
        ),
    ),
    "surrogate_key": lambda s, d: b.bronze(s, d, "crm").select(
        "opportunity_id", "agent_id", surrogate_key("opportunity_id", "agent_id", "updated_at").alias("event_key")
    ),
    # Joins and lookups
    "conversion_left_join": _on_opportunities(lambda o: _money(report.conversion_left_join(o, "agent"))),
    "funnel_dense": _on_opportunities(lambda o: report.funnel_dense(report.stage_summary(o))),
    "closing_timeline": _on_opportunities(report.closing_timeline),
    # Aggregations
    "booking_overview": lambda s, d: rounded(
        gold.booking_overview(b.silver_rows(s, d, "booking")), total_booking_amount=2, avg_booking_amount=6
    ),
    "customer_overview": lambda s, d: gold.customer_overview(b.silver_rows(s, d, "customer")),
    "opportunities_by_stage": _on_stage_mart(
        lambda m: rounded(m, total_value=2, avg_opportunity_value=6, avg_days_since_update=6)
    ),
    "conversion_by_agent": _on_conversion("agent", _money),
    "conversion_by_product": _on_conversion("product", _money),
    **{f"{group}_event_monitor": _monitor(group) for group in MONITORS},
    "stage_summary": _on_opportunities(
        lambda o: rounded(report.stage_summary(o), total_value=2, weighted_value=4, avg_days_since_update=6)
    ),
    "opportunity_kpis": _on_opportunities(
        lambda o: rounded(report.opportunity_kpis(o), total_value=2, weighted_forecast=4, win_rate_pct=6)
    ),
    "weighted_by_stage": _on_opportunities(lambda o: rounded(report.weighted_by_stage(o), weighted_value=4)),
    "best_agent": _on_opportunities(lambda o: _money(report.best_agent(o))),
    "table_volumes": _on_volumes(lambda v: v),
    "total_volume": _on_volumes(volumes.total_volume),
    "volume_deficit": _on_volumes(volumes.volume_deficit),
    "deficit_totals": _on_volumes(lambda v: volumes.deficit_totals(volumes.volume_deficit(v))),
    # Charts
    "chart_funnel": _on_opportunities(charts.chart_funnel),
    "chart_value_by_stage": _on_stage_mart(lambda m: rounded(charts.chart_value_by_stage(m), pipeline_value=2)),
    "chart_win_rate_agent": _chart_win_rate("agent"),
    "chart_win_rate_product": _chart_win_rate("product"),
    "chart_region": _on_opportunities(charts.chart_region),
    "chart_product_mix": _on_opportunities(lambda o: rounded(charts.chart_product_mix(o), share_pct=6)),
    "chart_stale_by_stage": _on_stage_mart(charts.chart_stale_by_stage),
    "chart_stale_detail": _on_opportunities(lambda o: charts.chart_stale_detail(gold.stale_opportunities(o))),
    # Latest record per key
    "latest_booking": lambda s, d: b.silver_rows(s, d, "booking"),
    "latest_opportunity": lambda s, d: b.silver_rows(s, d, "crm"),
    "latest_customer": lambda s, d: b.silver_rows(s, d, "customer"),
    "latest_event": _latest_event,
    # Sorts and top-k
    "sort_by_stage_order": _on_opportunities(_sorted),
    "top_agents": _on_conversion("agent", lambda m: _money(report.top_agents(m))),
    "products_by_win_rate": _on_conversion("product", lambda m: _money(report.products_by_win_rate(m))),
    # Incremental maintenance
    "incremental_filter": _incremental,
    "upsert_latest": _upsert,
    "append_new_columns": _new_columns,
    "full_refresh": _full_refresh,
    "medallion_run": _medallion,
    # Streams
    "stream_ingest": _stream_ingest,
    "stream_upsert_latest": _stream_upsert,
    "stream_late_rows": _late,
    "stream_replay_dedup": _stream_dedup,
    # Data quality
    "dq_not_null": _on_opportunities(_not_null),
    "dq_unique": _on_cleaned(lambda c: quality.dq_unique(c, "opportunity_id")),
    "dq_accepted_values": _on_opportunities(quality.dq_accepted_values),
    "dq_expression_true": _on_opportunities(
        lambda o: quality.dq_expression_true(o, "value >= 5").select("opportunity_id", "value")
    ),
    "dq_volume_anomaly": lambda s, d: _scored(quality.dq_volume_anomaly(_volume_history(s, d))),
    "dq_schema_change": _schema_change,
    "dq_column_anomaly": lambda s, d: _scored(quality.dq_column_anomaly(_column_history(s, d))),
    "dq_anomaly_from_moments": lambda s, d: _scored(_moments(s, d)),
    "dq_timestamp_order": _timestamp_order,
    "dq_travel_dates": lambda s, d: quality.dq_travel_dates(b.silver_rows(s, d, "booking")),
    "dq_won_lte_total": _won_lte_total,
    "dq_email_format": lambda s, d: quality.dq_email_format(b.silver_rows(s, d, "customer")),
    "dq_payload_json": _payload_json,
    "dq_payload_metadata": _payload_metadata,
    "dq_rate_bounds": _rate_bounds,
    "dq_report": _dq_report,
    "dq_opaque_report": _opaque_report,
    "dq_staging_report": _staging_report,
    "dq_full_report": _full_report,
    "dq_volume_bands": _on_volumes(volumes.volume_bands),
    "volume_band_totals": _on_volumes(lambda v: volumes.volume_band_totals(volumes.volume_bands(v))),
    "dq_conversion_invariants": _conversion_invariants,
}


def _registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(query(apply_semantics(spark), sf_dir))

    return run


def queries() -> dict[str, Query]:
    return {name: _registered(query) for name, query in QUERIES.items()}
