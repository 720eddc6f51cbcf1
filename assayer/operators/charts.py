"""Chart queries: one grouped metric each, and the stale detail table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_of(column: str = "*", label: str | None = None) -> Column:
    return F.count(column).alias(label or f"COUNT({column})")


def sum_of(column: str, label: str | None = None) -> Column:
    return F.sum(column).alias(label or f"SUM({column})")


def avg_of(column: str, label: str | None = None) -> Column:
    return F.avg(column).alias(label or f"AVG({column})")


def sql_metric(expression: str, label: str) -> Column:
    return F.expr(expression).alias(label)


def simple_filter(column: str, op: str, value) -> Column:
    """One comparison; NULLs never pass, as in SQL."""
    c = F.col(column)
    tests = {
        "==": lambda: c == value,
        "!=": lambda: c != value,
        "<": lambda: c < value,
        "<=": lambda: c <= value,
        ">": lambda: c > value,
        ">=": lambda: c >= value,
        "IN": lambda: c.isin(*value),
        "NOT IN": lambda: ~c.isin(*value),
        "IS NULL": c.isNull,
        "IS NOT NULL": c.isNotNull,
    }
    if op not in tests:
        raise ValueError(f"unknown operator {op!r}")
    return tests[op]()


def chart(
    df: DataFrame, group: str, metric: Column, label: str, limit: int, where: Column | None = None, desc: bool = True
) -> DataFrame:
    """``metric`` per ``group``, ordered by it, first ``limit`` groups; equal metrics go by group name."""
    rows = df if where is None else df.filter(where)
    grouped = rows.groupBy(group).agg(metric.alias(label))
    order = F.col(label).desc_nulls_last() if desc else F.col(label).asc_nulls_first()
    return grouped.orderBy(order, F.col(group).asc_nulls_last()).limit(limit)


def with_share(df: DataFrame, label: str) -> DataFrame:
    """Percent of the total over the slices shown. The input is a limited chart, so one task sees few rows."""
    return df.withColumn("share_pct", F.try_divide(100 * F.col(label), F.sum(label).over(W.partitionBy())))


def chart_funnel(opportunities: DataFrame) -> DataFrame:
    where = simple_filter("stage", "!=", "Lost")
    return chart(opportunities, "stage", count_of("opportunity_id"), "opportunities", 5, where)


def chart_value_by_stage(stage_mart: DataFrame) -> DataFrame:
    return chart(stage_mart, "stage", sum_of("total_value"), "pipeline_value", 10)


def chart_win_rate(mart: DataFrame, by: str) -> DataFrame:
    return chart(mart, by, avg_of("win_rate_pct"), "win_rate_pct", 10)


def chart_region(opportunities: DataFrame) -> DataFrame:
    return chart(opportunities, "region", count_of("opportunity_id"), "opportunities", 10)


def chart_product_mix(opportunities: DataFrame) -> DataFrame:
    return with_share(chart(opportunities, "product", count_of("opportunity_id"), "opportunities", 10), "opportunities")


def chart_stale_by_stage(stage_mart: DataFrame) -> DataFrame:
    return chart(stage_mart, "stage", sum_of("stale_opportunities"), "stale_opportunities", 10, desc=False)


def chart_stale_detail(stale: DataFrame) -> DataFrame:
    """The first hundred stale opportunities by id."""
    columns = (
        "opportunity_id",
        "stage",
        "agent",
        "product",
        "region",
        "value",
        "days_since_update",
        "days_until_expected_close",
    )
    return stale.select(*columns).orderBy("opportunity_id").limit(100)
