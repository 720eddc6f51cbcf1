"""Dashboard and report figures computed from the opportunity view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sales
from .gold import OPPORTUNITY_COLUMNS, conversion, literal_rows


def load_opportunities(opportunities: DataFrame) -> DataFrame:
    """The nine dashboard columns in business order of the stages; a stage outside the list becomes NULL."""
    return sort_by_stage_order(opportunities.select(*OPPORTUNITY_COLUMNS))


def sort_by_stage_order(df: DataFrame) -> DataFrame:
    """Rows by stage rank; unknown stages become NULL and come last.

    The id as second key gives a fixed order and lets the range partitioner cut inside a stage, so that six
    stage values do not mean six partitions.
    """
    listed = df.withColumn("stage", F.when(F.col("stage").isin(*sales.STAGE_ORDER), F.col("stage")))
    return listed.orderBy(sales.stage_rank(F.col("stage")).asc_nulls_last(), "opportunity_id")


def with_forecast(opportunities: DataFrame) -> DataFrame:
    """Add win probability, weighted value and close bucket."""
    stage = F.col("stage")
    return opportunities.withColumns(
        {
            "win_prob": sales.win_probability(stage),
            "weighted_value": sales.weighted_value(F.col("value"), stage),
            "close_bucket": sales.close_bucket(F.col("days_until_expected_close")),
        }
    )


def stage_summary(opportunities: DataFrame) -> DataFrame:
    """Per known stage: valued deals, value, forecast, stale deals, mean idle days."""
    known = with_forecast(opportunities).filter(F.col("stage").isin(*sales.STAGE_ORDER))
    return known.groupBy("stage").agg(
        F.count("value").alias("total_opportunities"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_value"),
        F.coalesce(F.sum("weighted_value"), F.lit(0.0)).alias("weighted_value"),
        F.count_if("is_stale").alias("stale_opportunities"),
        F.avg("days_since_update").alias("avg_days_since_update"),
    )


def opportunity_kpis(opportunities: DataFrame) -> DataFrame:
    """One row of headline figures; the win rate is 0 when nothing is closed."""
    won = F.count_if(F.col("stage") == "Won")
    lost = F.count_if(F.col("stage") == "Lost")
    return with_forecast(opportunities).agg(
        F.count("*").alias("total_opportunities"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_value"),
        F.coalesce(F.sum("weighted_value"), F.lit(0.0)).alias("weighted_forecast"),
        won.alias("won_deals"),
        lost.alias("lost_deals"),
        F.coalesce(sales.win_rate_pct(won, won + lost), F.lit(0.0)).alias("win_rate_pct"),
        F.count_if("is_stale").alias("stale_opportunities"),
    )


def weighted_by_stage(opportunities: DataFrame) -> DataFrame:
    return with_forecast(opportunities).groupBy("stage").agg(F.sum("weighted_value").alias("weighted_value"))


def conversion_left_join(opportunities: DataFrame, by: str) -> DataFrame:
    """Dashboard-side conversion: the totals of each key left-joined with its won deals, lost deals and won value.

    Unlike the mart it drops NULL keys, counts only deals with a value and rounds halves to even. All sides
    group the same rows by the same key, so the joins with 0 for a missing partner are one aggregation with
    conditions: one shuffle of partial sums instead of four and three joins.
    """
    won, lost = F.col("stage") == "Won", F.col("stage") == "Lost"
    closed = F.count_if(won | lost)
    zero = F.lit(0.0)
    return (
        opportunities.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.count("value").alias("total_opportunities"),
            F.coalesce(F.sum("value"), zero).alias("total_pipeline_value"),
            F.count_if(won).alias("won_opportunities"),
            F.count_if(lost).alias("lost_opportunities"),
            F.coalesce(F.sum(F.when(won, F.col("value"))), zero).alias("won_value"),
            F.coalesce(F.bround(sales.win_rate_pct(F.count_if(won), closed), 2), zero).alias("win_rate_pct"),
        )
    )


def _positions(df: DataFrame, name: str, values: tuple[str, ...]) -> DataFrame:
    """A literal ordered list as a small relation."""
    return literal_rows(df.sparkSession, position=range(len(values)), **{name: values})


def funnel_dense(summary: DataFrame) -> DataFrame:
    """Deals of the five funnel stages from last to first; a stage without deals shows as NULL."""
    stages = sales.FUNNEL_STAGES[::-1]
    shown = summary.filter(F.col("stage").isin(*stages)).select("stage", "total_opportunities")
    # One row per listed stage at most: the broadcast side cannot grow.
    return _positions(summary, "stage", stages).join(F.broadcast(shown), "stage", "left")


def closing_timeline(opportunities: DataFrame) -> DataFrame:
    """Valued open deals per close bucket; an empty bucket shows as 0."""
    counts = (
        with_forecast(opportunities)
        .filter(F.col("stage").isin(*sales.OPEN_STAGES))
        .groupBy("close_bucket")
        .agg(F.count("value").alias("deals"))
    )
    # Four buckets at most: the broadcast side cannot grow.
    return (
        _positions(opportunities, "close_bucket", sales.CLOSE_BUCKETS)
        .join(F.broadcast(counts), "close_bucket", "left")
        .fillna(0, ["deals"])
    )


def overdue_deals(opportunities: DataFrame) -> DataFrame:
    return opportunities.filter(F.col("days_until_expected_close") < 0)


def closing_this_week(opportunities: DataFrame) -> DataFrame:
    return opportunities.filter(F.col("days_until_expected_close").between(0, sales.WEEK_DAYS))


def closing_this_month(opportunities: DataFrame) -> DataFrame:
    return opportunities.filter(F.col("days_until_expected_close").between(0, sales.MONTH_DAYS))


def idle_deals(opportunities: DataFrame) -> DataFrame:
    """Idle for more than two weeks; unlike the stale flag the limit itself is not included."""
    return opportunities.filter(F.col("days_since_update") > sales.STALE_DAYS)


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ``tie`` makes the cut unambiguous."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc_nulls_last()).limit(k)


def top_agents(agent_conversion: DataFrame, k: int = 10) -> DataFrame:
    return top_k(agent_conversion, "win_rate_pct", k, "agent")


def best_agent(opportunities: DataFrame) -> DataFrame:
    return top_k(conversion(opportunities, "agent"), "win_rate_pct", 1, "agent")


def products_by_win_rate(product_conversion: DataFrame) -> DataFrame:
    """All products, best win rate first."""
    return product_conversion.orderBy(F.col("win_rate_pct").desc_nulls_last(), F.col("product").asc_nulls_last())
