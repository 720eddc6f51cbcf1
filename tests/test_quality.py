import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assayer.catalogue import DOMAINS
from assayer.operators import quality as q
from assayer.operators import volumes
from assayer.plans import checks, registry


def test_not_null_and_expression_split_the_work(spark):
    df = spark.createDataFrame([(1, 5.0), (None, None), (3, -1.0)], "id int, v double")
    assert {(r.column_name, r.failures) for r in q.dq_not_null(df, ["id", "v"]).collect()} == {("id", 1), ("v", 1)}
    assert [r.v for r in q.dq_expression_true(df, "v >= 0").collect()] == [-1.0]


def test_unique_ignores_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert [tuple(r) for r in q.dq_unique(df, "k").collect()] == [("a", 2)]


def test_accepted_values(spark):
    df = spark.createDataFrame([("Won",), ("Odd",), (None,)], "stage string")
    assert [tuple(r) for r in q.dq_accepted_values(df).collect()] == [("Odd", 1)]


def test_email_format(spark):
    good = ["a@b.co", "x.y+z@d-e.f.g", None]
    bad = ["a@b", "a b@c.d", "@b.c", "a@@b.c", "a@b.c d", "a@b.c\n"]
    df = spark.createDataFrame([(e,) for e in good + bad], "email string")
    assert sorted(r.email for r in q.dq_email_format(df).collect()) == sorted(bad)


def test_travel_dates_and_timestamp_order(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2024, 1, 2), d(2024, 1, 1)), (d(2024, 1, 1), d(2024, 1, 1)), (None, d(2024, 1, 1))],
                               "travel_start_date date, travel_end_date date")
    assert q.dq_travel_dates(df).count() == 1
    t = dt.datetime
    df = spark.createDataFrame([(t(2024, 1, 2), t(2024, 1, 1)), (t(2024, 1, 1), t(2024, 1, 1)), (None, t(2024, 1, 1))],
                               "ingested_at timestamp, staged_at timestamp")
    assert q.dq_timestamp_order(df).count() == 1


def test_payload_checks(spark):
    good = '{"ingested_at":"x","staged_at":"y"}'
    rows = [good, "{bad", None, "[1]", good + " tail", '{"ingested_at":null,"staged_at":"y"}', '{"staged_at":"y"}']
    df = spark.createDataFrame([(r,) for r in rows], "event_payload string")
    invalid = {r.event_payload for r in q.dq_payload_json({"fraud": df}).collect()}
    assert invalid == {"{bad", None, good + " tail"}
    assert {r.event_payload for r in q.dq_payload_metadata(df).collect()} == set(rows) - {good}


def test_plain_payloads_are_cleared_without_parsing(spark, monkeypatch):
    """The pattern clears only what the parser accepts, and the payloads of staged rows."""
    good = ['{"a":1}', '{"a": "x", "b": -1.5e+10, "c":null,"é":true}', '{"":""}', '{"a":0.10}', '{"t":"NaN","u":"日本 \x7f"}']
    bad = ['{"a":01}', '{"a":1.}', '{"a":.5}', '{"a":+1}', '{"a":NaN}', '{"a":nul}', '{"a":1,}', '{,"a":1}', '{"a":1}}', '{"a":1}]', '{"a":1} x', '{"a" 1}',
           "{'a':1}", '{a:1}', '{"a":"b\nc"}', '{"a":"b\tc"}', '{"a":"b"c"}', '{"a":"b\\"}', '{"a":1e}', '{"a":--1}', '{"a":1}\n{', '{"a":"\x00"}', '{"a":1"b":2}']
    slow = ['{}', '{"a":[1]}', '{"a":{"b":2}}', '{"a":"\\u0041 \\n"}', ' {"a":1}', '{"a":1}\n', '{"a" :1}', "[1]", "1", '"x"', "null", "{" + ",".join(f'"f{i}":{i}' for i in range(70)) + "}",
            '{"a":"' + "x" * 40_000 + '"}', '{"a":1' + "0" * 300 + "}"]
    rng = random.Random(4)
    changed = []
    for text in good * 40:
        at = rng.randrange(len(text))
        changed.append(text[:at] + rng.choice('{}[]",:0 1e-\\x\n') + text[at + rng.randrange(2):])
    texts = [*good, *bad, *slow, *changed, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    ask = lambda: [r[0] for r in df.select("i", q.not_json(F.col("p")).alias("r")).orderBy("i").select("r").collect()]
    found = ask()
    assert found[: len(good) + len(bad)] == [False] * len(good) + [True] * len(bad)
    assert found[len(good) + len(bad) :][: len(slow)] == [False] * len(slow)
    flat = [r[0] for r in df.select("i", F.col("p").rlike(q.FLAT_OBJECT).alias("r")).orderBy("i").select("r").collect()]
    assert flat[: len(good)] == [True] * len(good) and not any(flat[len(good) :][: len(bad)])
    monkeypatch.setattr(q, "FLAT_OBJECT", r"\A\z")
    assert ask()[:-1] == found[:-1] and found[-1] and found[-2]


def test_rows_are_judged_before_copies_are_dropped(spark):
    schema = "event_id string, n double, ingested_at timestamp"
    t = dt.datetime(2024, 1, 1)
    staged = registry.stage_events(spark.createDataFrame([("a", 1.0, t), ("a", 1.0, t), (None, None, None), ('q"\\\n', 2.0, t)], schema), "2024-01-31")
    failing = q.staged_not_json(staged)
    assert failing.columns == staged.columns and failing.count() == 0
    assert registry.sv.distinct_events(staged).count() == 3
    plan = registry.sv.distinct_events(failing)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Generate")


def mart(spark, rows):
    return spark.createDataFrame(rows, "agent string, total_opportunities long, won_opportunities long, lost_opportunities long, win_rate_pct double")


def test_conversion_checks(spark):
    df = mart(spark, [("a", 5, 2, 1, 66.67), ("b", 1, 2, 0, 100.0), ("c", 3, 2, 2, 120.0), (None, 0, 0, 0, None), ("a", 1, 0, 5, 0.0)])
    row = q.dq_conversion_invariants(df, "agent").first().asDict()
    assert row == {"key_null": 1, "key_not_unique": 1, "total_not_positive": 1, "rate_null": 1, "rate_out_of_bounds": 1,
                   "won_above_total": 1, "lost_above_total": 1}
    assert {r.agent for r in q.dq_rate_bounds(df).collect()} == {"a", "b", "c"}
    entities = q.dq_won_lte_total(df, df.withColumnRenamed("agent", "product")).collect()
    assert [r.entity for r in entities] == ["b", "b"]


def history(spark, values, table="t"):
    rows = [(table, dt.datetime(2024, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "table_name string, run_at timestamp, value double")


def test_volume_anomaly_needs_three_earlier_runs(spark):
    scored = q.dq_volume_anomaly(history(spark, [100, 101, 99, 100, 500, 100])).orderBy("run_at").collect()
    assert [r.status for r in scored] == ["not enough history"] * 3 + ["ok", "anomaly", "ok"]


def test_constant_history_scores_zero_and_series_are_apart(spark):
    both = history(spark, [5, 5, 5, 9]).unionByName(history(spark, [1, 2, 3, 2], "u"))
    last = {r.table_name: r for r in q.dq_volume_anomaly(both).filter("earlier_runs = 3").collect()}
    assert last["t"].score == 0.0 and last["u"].status == "ok"


def test_sensitivity(spark):
    values = [10, 12, 8, 10, 14]
    strict = q.dq_volume_anomaly(history(spark, values), 2).orderBy("run_at").collect()
    assert strict[-1].status == "anomaly"
    assert q.dq_volume_anomaly(history(spark, values), 3).orderBy("run_at").collect()[-1].status == "ok"


def test_column_metrics(spark):
    df = spark.createDataFrame([(0.0,), (None,), (0.0,), (2.0,)], "value double")
    assert {tuple(r) for r in q.column_metrics(df, ["value"]).collect()} == {("value", "null_count", 1.0), ("value", "zero_count", 2.0)}


def test_schema_change(spark):
    before = q.schema_snapshot(spark.sql("SELECT 1 AS a, 'x' AS b, 1.5D AS c"))
    after = q.schema_snapshot(spark.sql("SELECT 1L AS a, 'x' AS b, true AS d"))
    assert {(r.column_name, r.change) for r in q.dq_schema_change(before, after).collect()} == {
        ("a", "type_changed"), ("c", "removed"), ("d", "added")}


def test_payload_schema_sees_json_types(spark):
    rows = ['{"a":1,"b":"1","c":true,"d":null}', '{"a":"x","b":"true","e":{"z":1}}', "{bad"]
    df = spark.createDataFrame([(r,) for r in rows], "event_payload string")
    assert {tuple(r) for r in q.payload_schema(df).collect()} == {
        ("a", "number|string"), ("b", "string"), ("c", "boolean"), ("e", "nested")}


def test_report_rows(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    report = q.dq_report([
        q.row_checks(df, "t", {"not_null:k": (F.col("k").isNull(), "error"), "odd": (F.col("k") == "a", "warn")}),
        q.failure_count(df.filter(F.lit(False)), "none", "t", "warn"),
    ])
    assert {tuple(r) for r in report.collect()} == {
        ("not_null:k", "t", "error", 1), ("odd", "t", "warn", 1), ("none", "t", "warn", 0)}
    with pytest.raises(ValueError):
        q.failure_count(df, "x", "t", "info")


BROKEN = ['{"a":1}]', '{"a":1}] junk', '{"a":1}],[{', '{"a":1} {"b":2}', '{"a":1},{"b":2}', "{'a':1}", '{"a":NaN}', "", "  ", '{"a":1', "prose", '{"a":1},{"~end":"1"}]']
WHOLE = ['{"a":1}', ' {"a":{"b":[1,2]}} ', "[1,2]", '"text"', "3.5", "null", "true", "{}", '{"a":"]"}', '{"a":"\\u0041"}']


def test_payloads_with_text_after_them_are_no_json(column):
    assert column(q.not_json, BROKEN) == [True] * len(BROKEN)
    assert column(q.not_json, WHOLE) == [False] * len(WHOLE)
    assert column(q.not_json, [None]) == [True]


def test_metadata_needs_one_whole_object_with_both_times(column):
    both = '{"ingested_at":"x","staged_at":"y"}'
    bad = [both + t for t in ("]", "] junk", "],[{", " x")] + [f"[{both}]", '{"ingested_at":"x"}', '{"ingested_at":"x","staged_at":null}', "3", None, "", '"x"']
    assert column(q.metadata_missing, [both, " " + both + "\n", *bad]) == [False, False] + [True] * len(bad)


def test_payload_is_parsed_once(spark):
    rows = spark.createDataFrame([("{}",)], "event_payload string")
    # The first rule reads objects and other values in different ways, one of them for each payload.
    for rule, ways in ((q.not_json, 2), (q.metadata_missing, 1)):
        plan = rows.filter(rule(F.col("event_payload")))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == ways and "parse_json" not in plan and "get_json" not in plan


def test_moments_score_as_the_whole_history(spark):
    rng = random.Random(3)
    rows = [(t, dt.datetime(2024, 1, d), v) for t, values in {
        "steady": [5.0] * 9, "noisy": [rng.gauss(1e6, 3) for _ in range(9)], "short": [1.0, 2.0], "gaps": [None, 1.0, None, 3.0, 4.0, 5.0, 99.0]
    }.items() for d, v in enumerate(values, 1)]
    history = spark.createDataFrame(rows, "table_name string, run_at timestamp, value double")
    whole = {(r.table_name, r.run_at): r for r in q.dq_volume_anomaly(history).collect()}
    past = q.moments(history.limit(0), ["table_name"])
    for day in range(1, 10):
        run = history.filter(F.col("run_at") == dt.datetime(2024, 1, day))
        for r in q.score_against(run, past, ["table_name"]).collect():
            other = whole[r.table_name, r.run_at]
            assert (r.earlier_runs, r.status) == (other.earlier_runs, other.status)
            for name in ("mean", "stddev", "score"):
                assert r[name] == (None if other[name] is None else pytest.approx(other[name], rel=1e-6, abs=1e-9))
        past = spark.createDataFrame(q.merge_moments(past, q.moments(run, ["table_name"]), ["table_name"]).collect(), past.schema)
    assert past.count() == 4


def test_columns_with_dots_can_be_checked(spark):
    df = spark.createDataFrame([("x", 0), (None, 1)], "`a.b` string, `c.d` int")
    assert [tuple(r) for r in q.dq_accepted_values(df, "a.b", ["y"]).collect()] == [("x", 1)]
    assert {(r.column_name, r.metric): r.value for r in q.column_metrics(df, ["c.d"]).collect()} == {("c.d", "null_count"): 0.0, ("c.d", "zero_count"): 1.0}


def test_deficit_of_a_larger_target_has_parameters(spark):
    counts = spark.createDataFrame([("t", 1000)], "table_name string, row_count bigint")
    few = volumes.volume_deficit(counts, 1_000_000)
    assert few.first().batches == 80 and volumes.deficit_totals(few).first().total_rows_to_load == 80_000
    all_ = volumes.volume_deficit(counts, 1_000_000, batch_rows=10_000, max_batches=None)
    assert all_.first().batches == 100 and volumes.deficit_totals(all_, 10_000).first().total_rows_to_load == 999_000


def test_full_report_has_every_declared_check(spark, sf_dir):
    import __spark_entry__ as spark_entry

    lines = spark_entry.queries()["dq_full_report"](spark, sf_dir).collect()
    assert len({(r.check_name, r.table_name) for r in lines}) == len(lines)
    tables = {r.table_name for r in lines}
    assert {f"staging.{n}" for n in DOMAINS} | {f"silver.{n}" for n in DOMAINS} <= tables
    assert {"gold.dashboard_opportunities", "gold.conversion_by_agent", "gold.conversion_by_product"} <= tables
    assert sum(r.table_name.startswith("staging.") for r in lines) == 2 * len(DOMAINS)


def test_opaque_report_counts_copies_and_failed_rules_of_any_key(spark):
    md5 = "0123456789abcdef0123456789abcdef"
    good = '{"ingested_at":"2024-01-01","staged_at":"2024-01-02"}'
    rows = [
        (md5, "2024-01-02", "2024-01-01", good), (md5, "2024-01-02", "2024-01-03", "[1"), (md5.upper(), "2024-01-02", "2024-01-01", good),
        (bytes.fromhex("41" * 16).decode(), None, "2024-01-01", None), ("41" * 16, "2024-01-02", None, good),
        (None, "2024-01-02", "2024-01-01", good), (None, "2024-01-01", "2024-01-02", "{}"),
    ]
    events = spark.createDataFrame(rows, "sk string, s string, i string, event_payload string").selectExpr(
        "sk", "CAST(s AS TIMESTAMP) AS staged_at", "CAST(i AS TIMESTAMP) AS ingested_at", "event_payload"
    )
    tables = {n: events.withColumnRenamed("sk", f"{n}_event_sk") for n in ("fraud", "support")} | {"seat": events.limit(0).withColumnRenamed("sk", "seat_event_sk")}
    found = {(r.table_name, r.check_name): r.failures for r in checks.opaque_report(tables).collect()}
    expected = {"not_null:event_sk": 2, "not_null:staged_at": 1, "not_null:ingested_at": 1, "not_null:event_payload": 1,
                "timestamp_order": 2, "payload_json": 2, "payload_metadata": 0, "unique:event_sk": 1}
    assert {n: found["silver.fraud", n] for n in expected} == expected
    assert {n: found["silver.support", n] for n in expected} == expected | {"payload_metadata": 3}
    assert len(found) == 24 and not any(found["silver.seat", n] for n in expected)


def test_reports_store_no_opaque_rows(spark, sf_dir, monkeypatch):
    stored, keep = [], registry.files.materialize
    monkeypatch.setattr(registry.files, "materialize", lambda df, name: stored.append(name) or keep(df, name))
    for name in ("dq_opaque_report", "dq_full_report"):
        registry.queries()[name](spark, sf_dir)
    assert sorted(stored) == ["full-booking", "full-crm", "full-customer", "full-deals"]


def test_tables_are_stored_with_entropy_coding(spark):
    rows = registry.files.materialize(registry.apply_semantics(spark).range(10).selectExpr("md5(CAST(id AS STRING)) AS h"), "coded")
    assert rows.count() == 10 and all(".zstd." in f for f in rows.inputFiles())
