"""Gold: opportunity view, conversion and overview marts, event monitors."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sales

OPPORTUNITY_COLUMNS = (
    "opportunity_id",
    "stage",
    "region",
    "product",
    "agent",
    "value",
    "days_since_update",
    "days_until_expected_close",
    "is_stale",
)


def _day(as_of: date | str | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def opportunity_ages(df: DataFrame, as_of: date | str | Column | None = None) -> DataFrame:
    """Add days since the last update and (signed) days until the expected close."""
    day = _day(as_of)
    return df.withColumns(
        {
            "days_since_update": sales.days_since(F.col("updated_at"), day),
            "days_until_expected_close": sales.days_until(F.col("expected_close_date"), day),
        }
    )


def is_stale(stage: Column) -> Column:
    """Idle for two weeks, or due within a month or overdue. Closed stages are exempt by canonical name."""
    return (
        F.when(stage.isin("Won", "Lost"), False)
        .when(F.col("days_since_update") >= sales.STALE_DAYS, True)
        .when(F.col("days_until_expected_close") <= sales.MONTH_DAYS, True)
        .otherwise(False)
    )


def dashboard_opportunities(
    silver: DataFrame, as_of: date | str | Column | None = None, exempt_closed: bool = False
) -> DataFrame:
    """One row per opportunity with canonical names, ages and the stale flag.

    The established rule tests the *silver* stage, which is lower case, so its exemption of closed deals never
    applies; that is the default. ``exempt_closed`` tests the canonical stage instead.
    """
    canonical = sales.normalize_stage(F.col("stage"))
    return opportunity_ages(silver.filter(F.col("opportunity_id").isNotNull()), as_of).select(
        "opportunity_id",
        canonical.alias("stage"),
        "region",
        sales.normalize_product(F.col("product")).alias("product"),
        sales.normalize_agent(F.col("agent_id")).alias("agent"),
        "value",
        "expected_close_date",
        "updated_at",
        "ingested_at",
        "staged_at",
        "days_since_update",
        "days_until_expected_close",
        is_stale(canonical if exempt_closed else F.col("stage")).alias("is_stale"),
    )


def stale_opportunities(opportunities: DataFrame) -> DataFrame:
    return opportunities.filter("is_stale").select(
        "opportunity_id",
        "stage",
        "agent",
        "product",
        "region",
        "value",
        "expected_close_date",
        "updated_at",
        "days_since_update",
        "days_until_expected_close",
        "is_stale",
    )


def opportunities_by_stage(opportunities: DataFrame) -> DataFrame:
    return opportunities.groupBy("stage").agg(
        F.count("*").alias("total_opportunities"),
        F.sum("value").alias("total_value"),
        F.avg("value").alias("avg_opportunity_value"),
        F.avg("days_since_update").alias("avg_days_since_update"),
        F.count_if("is_stale").alias("stale_opportunities"),
    )


def conversion(opportunities: DataFrame, by: str) -> DataFrame:
    """Deals, win rate and value per ``by`` ('agent' or 'product'); a NULL key is a group of its own."""
    won = F.count_if(F.col("stage") == "Won")
    lost = F.count_if(F.col("stage") == "Lost")
    return opportunities.groupBy(by).agg(
        F.count("*").alias("total_opportunities"),
        won.alias("won_opportunities"),
        lost.alias("lost_opportunities"),
        F.coalesce(F.round(sales.win_rate_pct(won, won + lost), 2), F.lit(0.0)).alias("win_rate_pct"),
        F.sum("value").alias("total_pipeline_value"),
        F.sum(F.when(F.col("stage") == "Won", F.col("value")).otherwise(0.0)).alias("won_value"),
    )


def booking_overview(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy("booking_status", "channel", "currency").agg(
        F.count("*").alias("total_bookings"),
        F.sum("total_amount").alias("total_booking_amount"),
        F.avg("total_amount").alias("avg_booking_amount"),
        F.count_distinct("customer_id").alias("distinct_customers"),
        F.max("updated_at").alias("latest_booking_updated_at"),
    )


def customer_overview(customers: DataFrame) -> DataFrame:
    return customers.groupBy("customer_segment", "loyalty_tier", "country").agg(
        F.count("*").alias("total_customers"),
        F.count("email").alias("customers_with_email"),
        F.count("phone").alias("customers_with_phone"),
        F.max("updated_at").alias("latest_customer_updated_at"),
    )


def tagged_union(tables: Mapping[str, DataFrame], tag: str, *columns: str) -> DataFrame:
    """The given columns of all tables in one relation, each row tagged with its table's name."""
    parts = [df.select(F.lit(name).alias(tag), *columns) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def literal_rows(spark: SparkSession, **columns: Iterable) -> DataFrame:
    """A small relation from literal lists, made inside the JVM."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(columns, row)]) for row in zip(*columns.values())]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def event_monitor(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per domain from its silver table: events, first and last ingestion, last staging.

    Each domain is a keyless aggregate, which costs no lookup per row and gives a row even without events.
    """
    summary = (
        F.count("*").alias("total_events"),
        F.min("ingested_at").alias("first_ingested_at"),
        F.max("ingested_at").alias("last_ingested_at"),
        F.max("staged_at").alias("last_staged_at"),
    )
    rows = {name: df.agg(*summary) for name, df in tables.items()}
    return tagged_union(rows, "domain", "total_events", "first_ingested_at", "last_ingested_at", "last_staged_at")
