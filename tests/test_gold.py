import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import sales
from assayer.operators import charts, gold, report, volumes
from assayer.plans.adhoc import adhoc_sql, gold_views, named_views

DAY = dt.date(2024, 1, 31)
OPP = (
    "opportunity_id string, stage string, region string, product string, agent string, value double, "
    "days_since_update int, days_until_expected_close int, is_stale boolean"
)


def silver(spark, rows):
    """rows of (id, stage, idle days, days to close)"""
    made = [
        (i, s, "agent_1", "vuelo", 10.0, "MTY",
         None if close is None else DAY + dt.timedelta(close),
         None if idle is None else dt.datetime(2024, 1, 31, 12) - dt.timedelta(idle))
        for i, s, idle, close in rows
    ]
    ddl = (
        "opportunity_id string, stage string, agent_id string, product string, value double, region string, "
        "expected_close_date date, updated_at timestamp"
    )
    at = F.lit("2024-01-31").cast("timestamp")
    return spark.createDataFrame(made, ddl).withColumns({"ingested_at": at, "staged_at": at})


@pytest.fixture(scope="module")
def deals(spark):
    """327 seeded opportunities with the stage counts of a typical book."""
    # The book of 327 deals that the dashboards' figures are checked with.
    rng = random.Random(42)
    counts = dict(zip(sales.STAGE_ORDER, (120, 85, 52, 30, 18, 22)))
    rows = []
    for stage, n in counts.items():
        for i in range(n):
            idle = rng.randrange(30)
            rows.append((f"OPP-{stage[:3].upper()}-{i:04d}", stage, rng.choice(["CDMX", "GDL", "MTY", "CUN", "TIJ"]),
                         rng.choice(["Flight", "Hotel", "Car Rental", "Package 2x", "Package 3x"]),
                         f"Agent {rng.randint(1, 20):02d}", round(rng.uniform(500, 15000), 2), idle,
                         rng.randint(-10, 59), idle > 14))
    return spark.createDataFrame(rows, OPP).cache()


def test_stale_rule_over_days_to_close_and_idle_days(spark):
    cases = [(-1, 0, True), (0, 0, True), (30, 0, True), (31, 0, False), (None, 0, False), (60, 13, False), (60, 14, True), (None, None, False)]
    df = silver(spark, [(f"o{i}", "propuesta", idle, close) for i, (close, idle, _) in enumerate(cases)])
    rows = gold.dashboard_opportunities(df, DAY).orderBy("opportunity_id").collect()
    assert [r.is_stale for r in rows] == [c[2] for c in cases]
    assert rows[0].stage == "Proposal" and rows[0].agent == "Agent 01" and rows[0].product == "Flight"
    assert (rows[0].days_until_expected_close, rows[6].days_since_update) == (-1, 14)


def test_closed_deals_are_exempt_only_on_request(spark):
    df = silver(spark, [("a", "ganado", 20, 60)])
    assert gold.dashboard_opportunities(df, DAY).first().is_stale is True
    assert gold.dashboard_opportunities(df, DAY, exempt_closed=True).first().is_stale is False


def test_opportunities_without_id_are_left_out_and_views_keep_their_columns(spark):
    df = silver(spark, [(None, "won", 1, 1), ("a", "won", 20, 1)])
    view = gold.dashboard_opportunities(df, DAY)
    assert view.count() == 1 and len(view.columns) == 13
    assert len(gold.stale_opportunities(view).columns) == 11


@pytest.mark.parametrize("by", ["agent", "product"])
@pytest.mark.parametrize("build", [gold.conversion, report.conversion_left_join])
def test_conversion_invariants(deals, by, build):
    rows = build(deals, by).collect()
    keys = [r[by] for r in rows]
    assert None not in keys and len(keys) == len(set(keys))
    for r in rows:
        assert r.total_opportunities > 0 and 0 <= r.win_rate_pct <= 100
        assert r.won_opportunities <= r.total_opportunities and r.lost_opportunities <= r.total_opportunities
    assert sum(r.won_opportunities for r in rows) == 18 and sum(r.lost_opportunities for r in rows) == 22


def test_null_keys_and_values_differ_between_mart_and_dashboard(spark):
    rows = [("1", "Won", None, None, None, 5.0, 1, 1, False), ("2", "Won", None, None, "A", None, 1, 1, False),
            ("3", "Lost", None, None, "A", 2.0, 1, 1, False), ("4", "Qualified", None, None, "B", None, 1, 1, False),
            ("5", "Won", None, None, "C", None, 1, 1, False)]
    df = spark.createDataFrame(rows, OPP)
    mart = {r.agent: r for r in gold.conversion(df, "agent").collect()}
    assert set(mart) == {None, "A", "B", "C"} and mart["A"].total_opportunities == 2
    assert mart["B"].win_rate_pct == 0 and mart["B"].total_pipeline_value is None and mart["C"].won_value is None
    board = {r.agent: r for r in report.conversion_left_join(df, "agent").collect()}
    assert set(board) == {"A", "B", "C"} and board["A"].total_opportunities == 1 and board["A"].won_opportunities == 1
    assert (board["A"].won_value, board["B"].total_pipeline_value, board["A"].win_rate_pct) == (0.0, 0.0, 50.0)


def test_win_rate_halves_round_up_in_the_mart_and_to_even_on_the_dashboard(spark):
    rows = [(str(i), "Won" if i < 1 else "Lost", None, None, "A", 1.0, 1, 1, False) for i in range(32)]
    df = spark.createDataFrame(rows, OPP)
    assert gold.conversion(df, "agent").first().win_rate_pct == 3.13
    assert report.conversion_left_join(df, "agent").first().win_rate_pct == 3.12


def test_monitor_keeps_domains_without_events(spark):
    some = spark.sql("SELECT TIMESTAMP '2024-01-01' AS ingested_at, TIMESTAMP '2024-01-02' AS staged_at FROM range(3)")
    rows = {r.domain: tuple(r)[1:] for r in gold.event_monitor({"fraud": some, "seat": some.limit(0)}).collect()}
    assert rows["seat"] == (0, None, None, None)
    assert rows["fraud"] == (3, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))


def test_summary_drops_unknown_stages_and_kpis_count_them(spark):
    rows = [("1", "Won", None, None, "A", 10.0, 4, 1, True), ("2", "Other", None, None, "A", 5.0, 1, 1, False),
            ("3", None, None, None, "A", 5.0, 1, 1, True), ("4", "Proposal", None, None, "A", None, 2, 1, False)]
    df = spark.createDataFrame(rows, OPP)
    summary = {r.stage: r for r in report.stage_summary(df).collect()}
    assert set(summary) == {"Won", "Proposal"}
    assert (summary["Proposal"].total_opportunities, summary["Proposal"].total_value) == (0, 0.0)
    kpis = report.opportunity_kpis(df).first()
    assert (kpis.total_opportunities, kpis.total_value, kpis.weighted_forecast) == (4, 20.0, 10.0)
    assert (kpis.won_deals, kpis.lost_deals, kpis.win_rate_pct, kpis.stale_opportunities) == (1, 0, 100.0, 2)
    empty = report.opportunity_kpis(df.limit(0)).first()
    assert (empty.total_opportunities, empty.total_value, empty.win_rate_pct) == (0, 0.0, 0.0)


def test_dense_funnel_and_timeline_show_missing_entries(spark):
    rows = [("1", "Won", None, None, "A", 10.0, 4, 1, True), ("2", "Proposal", None, None, "A", 1.0, 4, -1, True),
            ("3", "Proposal", None, None, "A", None, 4, -1, True), ("4", "Lost", None, None, "A", 1.0, 4, 3, True)]
    df = spark.createDataFrame(rows, OPP)
    funnel = report.funnel_dense(report.stage_summary(df)).orderBy("position").collect()
    assert [(r.stage, r.total_opportunities) for r in funnel] == [
        ("Won", 1), ("Negotiation", None), ("Proposal", 1), ("Qualified", None), ("Prospecting", None)]
    line = report.closing_timeline(df).orderBy("position").collect()
    assert [(r.close_bucket, r.deals) for r in line] == [("Overdue", 1), ("This Week", 0), ("This Month", 0), ("Later", 0)]


def test_orders_and_top_k(spark, deals):
    loaded = report.load_opportunities(deals.unionByName(deals.limit(1).withColumn("stage", F.lit("Other")))).collect()
    ranks = [sales.STAGE_ORDER.index(r.stage) if r.stage in sales.STAGE_ORDER else 99 for r in loaded]
    assert ranks == sorted(ranks) and ranks[-1] == 99 and loaded[-1].stage is None
    mart = gold.conversion(deals, "agent")
    top = [(r.win_rate_pct, r.agent) for r in report.top_agents(mart).collect()]
    assert top == sorted(top, key=lambda p: (-p[0], p[1])) and len(top) == 10
    assert report.best_agent(deals).first().agent == top[0][1]
    products = [r.win_rate_pct for r in report.products_by_win_rate(gold.conversion(deals, "product")).collect()]
    assert products == sorted(products, reverse=True)


def test_deal_filters(spark):
    rows = [(str(i), "Won", None, None, "A", 1.0, idle, close, False)
            for i, (idle, close) in enumerate([(14, -1), (15, 0), (None, 7), (0, 8), (0, 30), (0, 31), (0, None)])]
    df = spark.createDataFrame(rows, OPP)
    ids = lambda d: sorted(r.opportunity_id for r in d.collect())
    assert ids(report.overdue_deals(df)) == ["0"]
    assert ids(report.closing_this_week(df)) == ["1", "2"]
    assert ids(report.closing_this_month(df)) == ["1", "2", "3", "4"]
    assert ids(report.idle_deals(df)) == ["1"]


def test_charts(deals):
    funnel = charts.chart_funnel(deals).collect()
    assert [r.stage for r in funnel] == ["Prospecting", "Qualified", "Proposal", "Negotiation", "Won"]
    mix = charts.chart_product_mix(deals).collect()
    assert abs(sum(r.share_pct for r in mix) - 100) < 1e-9
    stale = [r.stale_opportunities for r in charts.chart_stale_by_stage(gold.opportunities_by_stage(deals)).collect()]
    assert stale == sorted(stale)
    detail = [r.opportunity_id for r in charts.chart_stale_detail(gold.stale_opportunities(
        deals.withColumns({"expected_close_date": F.current_date(), "updated_at": F.current_timestamp()}))).collect()]
    assert detail == sorted(detail) and len(detail) == 100


def test_metric_and_filter_builders(deals):
    row = deals.agg(charts.count_of(), charts.sum_of("value", "v"), charts.avg_of("value"), charts.sql_metric("max(value)", "m")).first()
    assert row.asDict().keys() == {"COUNT(*)", "v", "AVG(value)", "m"}
    assert deals.filter(charts.simple_filter("stage", "IN", ["Won", "Lost"])).count() == 40
    assert deals.filter(charts.simple_filter("region", "IS NULL", None)).count() == 0
    with pytest.raises(ValueError):
        charts.simple_filter("stage", "~", "x")


def test_adhoc_sql_over_gold_views(spark, deals):
    full = deals.withColumns({"expected_close_date": F.current_date(), "updated_at": F.current_timestamp()})
    views = gold_views(full)
    sql = "SELECT count(*) AS n FROM gld_dashboard_opportunities WHERE days_since_update > 14 OR is_stale"
    assert adhoc_sql(spark, sql, views).first().n == deals.filter("is_stale").count()
    assert adhoc_sql(spark, "SELECT count(*) AS n FROM gld_conversion_by_product", views).first().n == 5


def test_volumes_bands_and_deficit(spark):
    tables = {n: spark.range(k) for n, k in (("a", 90_000), ("b", 50_000), ("c", 69_999), ("d", 0))}
    counts = volumes.table_volumes(tables)
    bands = {r.table_name: r.status for r in volumes.volume_bands(counts).collect()}
    assert bands == {"a": "OK", "b": "MED", "c": "MED", "d": "LOW"}
    assert tuple(volumes.volume_band_totals(volumes.volume_bands(counts)).first()) == (1, 3, 209_999)
    deficit = volumes.volume_deficit(counts)
    assert [tuple(r) for r in deficit.collect()] == [
        ("d", 0, 70_000, 70), ("b", 50_000, 20_000, 20), ("c", 69_999, 1, 1), ("a", 90_000, 0, 0)]
    assert tuple(volumes.deficit_totals(deficit).first()) == (90_001, 70, 140)


def test_named_views_cover_all_gold_relations(spark):
    names = ["dashboard_opportunities", "opportunities_by_stage", "booking_overview", "risk_event_monitor"]
    views = named_views({n: spark.range(1) for n in names})
    assert list(views) == ["gld_dashboard_opportunities", "gld_pipeline_by_stage", "gld_booking_overview",
                           "gld_risk_event_monitor"]
    assert adhoc_sql(spark, "SELECT count(*) AS n FROM gld_booking_overview", views).first().n == 1
