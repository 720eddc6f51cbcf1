import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayer.catalogue import DOMAINS
from assayer.functions.hashing import row_json
from assayer.operators import silver as sv
from assayer.operators.staging import stage_events
from assayer.sources.files import conform, folder_bytes
from assayer.sources.tables import UpsertTable

AT = "2024-02-01 00:00:00"


def crm(spark, rows):
    ddl = "opportunity_id string, stage string, value double, updated_at string, ingested_at string"
    return conform(spark.createDataFrame(rows, ddl), DOMAINS["crm"].schema)


def latest(spark, rows):
    return sv.silver(stage_events(crm(spark, rows), AT), DOMAINS["crm"])


def test_latest_by_update_then_ingestion_and_null_updates_lose(spark):
    rows = [
        ("A", "new", 1.0, None, "2024-01-09"),
        ("A", "won", 2.0, "2024-01-02", "2024-01-03"),
        ("A", "lost", 3.0, "2024-01-02", "2024-01-04"),
        ("A", "old", 4.0, "2024-01-01", "2024-01-08"),
        (" ", "x", 5.0, "2024-01-01", "2024-01-01"),
        (None, "y", 6.0, "2024-01-02", "2024-01-01"),
    ]
    found = {(r.opportunity_id, r.stage) for r in latest(spark, rows).collect()}
    assert found == {("A", "lost"), (None, "y")}


def test_full_ties_have_one_fixed_winner(spark):
    rows = [("A", f"s{i}", 1.0, "2024-01-02", "2024-01-03") for i in range(20)]
    first = latest(spark, rows).collect()
    again = latest(spark, rows[::-1]).collect()
    assert len(first) == 1 and first == again
    staged = stage_events(crm(spark, rows), AT)
    assert first[0].crm_event_sk == max(r.row_hash for r in staged.collect())


def test_plain_cast_of_a_bad_amount_fails_the_run(spark):
    staged = stage_events(spark.createDataFrame([("1", "abc")], "booking_id string, total_amount string"), AT)
    fill = [f.name for f in DOMAINS["booking"].schema if f.name not in staged.columns]
    staged = staged.selectExpr("*", *[f"CAST(NULL AS STRING) AS {c}" for c in fill])
    with pytest.raises(PySparkException):
        sv.clean_bookings(staged).collect()


def test_payload_is_the_staged_row(spark):
    rows = spark.createDataFrame([("e1", None)], "event_id string, customer_id string")
    staged = stage_events(conform(rows, DOMAINS["fraud"].schema), AT)
    row = sv.event_payload(staged, "fraud").first()
    assert row.asDict().keys() == {"fraud_event_sk", "staged_at", "ingested_at", "event_payload"}
    assert row.event_payload.startswith(f'{{"row_hash":"{row.fraud_event_sk}","staged_at":"2024-02-01T00:00:00.000000Z"')
    assert '"customer_id":null' in row.event_payload


def test_opaque_copies_collapse_and_index_agrees(spark):
    rows = spark.createDataFrame([("e1",), ("e1",), ("e2",)], "event_id string")
    staged = stage_events(conform(rows, DOMAINS["fraud"].schema), AT)
    assert sv.silver(staged, DOMAINS["fraud"]).count() == 2
    assert sv.event_index(staged.select("row_hash", "ingested_at", "staged_at")).count() == 2


def test_incremental_filter_is_strict(spark):
    rows = [("A", "s", 1.0, None, t) for t in ("2024-01-01", "2024-01-02", "2024-01-03", None)]
    df = crm(spark, rows)
    assert sv.incremental_filter(df, None).count() == 4
    stored = df.filter("ingested_at <= '2024-01-02'")
    assert [r.ingested_at for r in sv.incremental_filter(df, stored).collect()] == [dt.datetime(2024, 1, 3)]
    assert sv.incremental_filter(df, df.limit(0)).count() == 3
    counts = sv.skipped_rows(df, stored).first()
    assert (counts.accepted_rows, counts.late_rows) == (1, 3)


def test_upsert_newer_batch_wins_and_keyless_rows_stay(spark):
    old = latest(spark, [("A", "a1", 1.0, "2024-01-09", "2024-01-01"), ("B", "b1", 1.0, None, "2024-01-01"), (None, "n1", 1.0, None, None)])
    new = latest(spark, [("A", "a2", 1.0, "2024-01-01", "2024-01-02"), ("C", "c1", 1.0, None, None), (None, "n2", 1.0, None, None)])
    merged = {(r.opportunity_id, r.stage) for r in sv.upsert_latest(old, new, "opportunity_id").collect()}
    assert merged == {("A", "a2"), ("B", "b1"), ("C", "c1"), (None, "n1"), (None, "n2")}


def test_upsert_adds_new_columns(spark):
    old = spark.createDataFrame([("A", 1)], "k string, v int")
    new = spark.createDataFrame([("B", 2, "w")], "k string, v int, extra string")
    rows = {tuple(r) for r in sv.upsert_latest(old, new, "k").collect()}
    assert rows == {("A", 1, None), ("B", 2, "w")}


def test_table_matches_brute_force_over_random_batches(spark, tmp_path):
    """Random batches with replays and compactions against a dictionary; a third of all rows has no key."""
    rng = random.Random(7)
    table = UpsertTable(spark, str(tmp_path / "t"), "k")
    keyed, keyless = {}, []
    for n in range(6):
        batch = {f"k{rng.randrange(12)}": f"{n}-{i}" for i in range(8)}
        loose = [f"{n}-none{i}" for i in range(4)]
        rows = [*batch.items(), *((None, v) for v in loose)]
        keyed |= batch
        keyless += loose
        for _ in range(rng.choice([1, 2])):  # a replayed batch must not change anything
            table.write_batch(spark.createDataFrame(rows, "k string, v string"), n)
        if n in (2, 4):
            table.compact()
            assert table.pending() == 0 and table.folded(n)
        found = sorted((r.k or "", r.v) for r in table.read().collect())
        assert found == sorted([*keyed.items(), *(("", v) for v in keyless)])
    assert table.last_batch() == 5


def test_table_keeps_columns_and_skips_replays_of_folded_batches(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), "k")
    assert not table.exists() and table.bound_before(1) is None and table.last_batch() == -1
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write_batch(spark.createDataFrame([("A", 1)], "k string, v int"), 1)
    table.write_batch(spark.createDataFrame([("B", "x")], "k string, extra string"), 2)
    assert {tuple(r) for r in table.read().collect()} == {("A", 1, None), ("B", None, "x")}
    table.write_batch(spark.createDataFrame([("A", 9)], "k string, v int"), 3)
    assert {tuple(r) for r in table.read().collect()} == {("A", 9, None), ("B", None, "x")}
    table.compact()
    assert {tuple(r) for r in table.read().collect()} == {("A", 9, None), ("B", None, "x")}
    assert table.write_batch(spark.createDataFrame([("A", 0)], "k string, v int"), 2) == {}  # late replay of a folded batch
    assert table.pending() == 0 and table.last_batch() == 3
    table.write_batch(spark.createDataFrame([], "k string, v int"), 4)
    assert table.pending() == 1 and table.read().count() == 2


def test_table_compacts_only_when_it_pays(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), "k")
    big = spark.range(20_000).selectExpr("CAST(id AS STRING) AS k", "uuid() AS v")
    table.write_batch(big, 1)
    table.compact_if_worth()
    assert table.pending() == 1  # a single batch needs no merging
    table.write_batch(big.limit(5), 2)
    table.compact_if_worth()
    assert table.folded(2)  # several batches without a base
    for n in (3, 4, 5):
        table.write_batch(big.limit(5), n)
        table.compact_if_worth()
    assert table.pending() == 3 and table.log_share() < 0.1
    table.compact_if_worth(max_batches=2)
    assert table.folded(5) and table.read().count() == 20_000
    table.write_batch(big.limit(9_000), 6)  # one batch, but too large to merge at every read
    table.compact_if_worth()
    assert table.folded(6) and table.read().count() == 20_000
    assert len(list((tmp_path / "t").iterdir())) == 4
    table.remove_folded(grace=3600)
    assert len(list((tmp_path / "t").iterdir())) == 4
    table.remove_folded(grace=0)
    assert len(list((tmp_path / "t").iterdir())) == 1 and table.read().count() == 20_000


def test_base_is_never_shuffled(spark, tmp_path):
    """Neither a reader nor folding moves the base, with broadcasts off; a batch writes what it weighs."""
    table = UpsertTable(spark, str(tmp_path / "t"), "k")
    rows = spark.range(40_000).selectExpr("CAST(id AS STRING) AS k", "uuid() AS v")
    table.write_batch(rows, 1)
    table.compact()
    before = folder_bytes(spark, str(tmp_path / "t"))
    table.write_batch(rows.limit(40), 2)
    table.write_batch(rows.limit(20), 3)
    assert folder_bytes(spark, str(tmp_path / "t")) - before < before / 50
    base = table._generation().base.split(".")[1]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (table.read(), table._merged(table._generation())):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and base in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert table.read().count() == 40_000
    table.compact()
    assert len(list((tmp_path / "t").glob(f"generation-2-*/base/*.parquet"))) == table.buckets  # one sorted file a bucket


def test_bound_is_observed_and_read_by_no_job(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), "k")
    times = ["2024-01-01 00:00:00.000001", None, "2024-01-03 00:00:00", "2024-01-02 00:00:00"]
    for n, at in enumerate(times):
        row = spark.createDataFrame([(f"k{n}", at)], "k string, t string").selectExpr("k", "CAST(t AS timestamp) AS ingested_at")
        table.write_batch(row, n)
        if n == 2:
            table.compact()
    context = spark.sparkContext
    context.setJobGroup("bounds", "bounds")
    try:
        bounds = [table.bound_before(n) for n in (0, 3, 4)]
        assert not context.statusTracker().getJobIdsForGroup("bounds")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    value = lambda c: spark.range(1).select(c.cast("string")).first()[0]
    # Batches that were folded are not told apart any more.
    assert [value(c) for c in bounds] == ["2024-01-03 00:00:00"] * 3


def test_bound_of_a_batch_does_not_see_the_batch_itself(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), "k")
    row = lambda at: spark.sql(f"SELECT 'a' AS k, CAST({at} AS timestamp) AS ingested_at")
    table.write_batch(row("NULL"), 1)
    table.write_batch(row("'2024-01-05'"), 2)
    value = lambda c: spark.range(1).select(c.cast("string")).first()[0]
    assert value(table.bound_before(2)) == sv.EPOCH_FLOOR and value(table.bound_before(3)) == "2024-01-05 00:00:00"
    log = table._generation().log
    spark.sql(f"ALTER TABLE {log} UNSET TBLPROPERTIES ('upsert.bound.2')")  # as if the writer was lost here
    assert value(table.bound_before(3)) == "2024-01-05 00:00:00"


def test_column_types_widen_over_batches_and_clash_aloud(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), "k")
    for n, (ddl, v) in enumerate((("int", 1), ("bigint", 2**40), ("double", 0.5), ("int", 7))):
        table.write_batch(spark.createDataFrame([(f"k{n}", v)], f"k string, v {ddl}"), n)
    assert {tuple(r) for r in table.read().collect()} == {("k0", 1.0), ("k1", 2.0**40), ("k2", 0.5), ("k3", 7.0)}
    assert dict(table.read().dtypes)["v"] == "double"
    with pytest.raises(ValueError, match="cannot turn from double into string"):
        table.write_batch(spark.createDataFrame([("k9", "x")], "k string, v string"), 9)
    with pytest.raises(ValueError, match="own"):
        table.write_batch(spark.createDataFrame([("k9", 1)], "k string, upsert_batch int"), 9)
    assert table.read().count() == 4


def test_reader_that_started_before_is_not_broken_and_generations_stay_few(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), "k", buckets=1)
    one = lambda n: spark.createDataFrame([(f"k{n % 7}", n)], "k string, v int")
    table.write_batch(one(0), 0)
    table.compact()
    early = table.read()
    for n in range(1, 26):
        table.write_batch(one(n), n)
        table.compact_if_worth(4, float("inf"))
        table.remove_folded()
    assert [tuple(r) for r in early.collect()] == [("k0", 0)]  # its generation is within the grace
    for n in range(26, 51):
        table.write_batch(one(n), n)
        table.compact_if_worth(4, float("inf"))
        table.remove_folded(grace=0)
    assert len(list((tmp_path / "t").iterdir())) == 1 and table.pending() <= 4
    assert {tuple(r) for r in table.read().collect()} == {(f"k{n % 7}", n) for n in range(44, 51)}


def test_table_unknown_to_the_catalog_is_not_overwritten(spark, tmp_path):
    (tmp_path / "t" / "generation-0-x").mkdir(parents=True)
    with pytest.raises(ValueError, match="catalog"):
        UpsertTable(spark, str(tmp_path / "t"), "k").write_batch(spark.createDataFrame([("a", 1)], "k string, v int"), 1)


def test_distinct_events_equal_one_row_per_hash(spark):
    rows = [("e1", 1.0), ("e1", 1.0), ("e1", None), ("e1", None), (None, None), ("e2", 1.0)]
    bronze = conform(spark.createDataFrame(rows, "event_id string, risk_score double"), DOMAINS["fraud"].schema)
    staged = stage_events(bronze, AT)
    kept = sv.distinct_events(staged)
    assert kept.columns == staged.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, staged.dropDuplicates(["row_hash"]).collect()))
    later = sv.distinct_events(staged.unionByName(stage_events(bronze, "2024-03-01 00:00:00")))
    assert later.count() == 4 and later.select("staged_at").distinct().count() == 1


def test_opaque_silver_hashes_after_the_shuffle_without_sort(spark):
    rows = conform(spark.createDataFrame([("e1",)], "event_id string"), DOMAINS["fraud"].schema)
    plan = sv.silver(stage_events(rows, AT), DOMAINS["fraud"])._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan
    assert "md5" not in plan[plan.index("Exchange"):]


def test_only_rows_that_may_have_copies_are_grouped(spark, monkeypatch):
    t, nan = dt.datetime(2024, 1, 1), float("nan")
    odd = [("a", 1.0, t), ("a", 1.0, t), ("a", -0.0, t), ("a", 0.0, t), ("b", -0.0, t), ("c", nan, t), ("c", nan, t), (None, None, None), (None, None, None)]
    rows = odd + [(f"x{i % 700}", float(i % 7), t) for i in range(1500)]
    bronze = lambda rows: conform(spark.createDataFrame(rows, "event_id string, risk_score double, ingested_at timestamp"), DOMAINS["fraud"].schema)
    staged = stage_events(bronze(rows), AT).unionByName(stage_events(bronze(rows[:20]), "2024-03-01 00:00:00"))
    found = lambda hash_first: sorted(map(repr, sv.distinct_events(staged, hash_first).collect()))
    assert len(found(False)) == 705 and found(True) == found(False)
    alone = sv._may_have_copies(bronze(odd), ["event_id", "risk_score"]).groupBy("event_id").agg(F.max("_maybe").alias("m"))
    assert {r.event_id: r.m for r in alone.collect()} == {"a": True, "b": False, "c": True, None: True}
    monkeypatch.setattr(sv, "FILTER_BITS", sv.BITMAP_BITS)  # full enough to take rows for copies that have none
    assert found(True) == found(False)


def test_size_decides_whether_copies_are_looked_for_by_hash(spark, tmp_path, monkeypatch):
    conform(spark.createDataFrame([("e1",), ("e1",)], "event_id string"), DOMAINS["fraud"].schema).write.parquet(str(tmp_path / "t"))
    stored = stage_events(spark.read.parquet(str(tmp_path / "t")), AT)
    plan = lambda df: sv.distinct_events(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" not in plan(stored)
    monkeypatch.setattr(sv, "HASH_FIRST_BYTES", 1)
    assert "bitmap_construct_agg" in plan(stored)
    assert "bitmap_construct_agg" not in plan(stage_events(spark.createDataFrame([("e1",)], "event_id string"), AT))  # of no known size


def test_payload_is_made_from_the_json_of_the_hash(spark):
    t = dt.datetime(2024, 1, 1, 1, 2, 3, 4)
    rows = [("e1", "é☃", 1.5, t), ('q"\\\n', None, float("nan"), None), (None, None, None, None)]
    bronze = conform(spark.createDataFrame(rows, "event_id string, customer_id string, risk_score double, ingested_at timestamp"), DOMAINS["fraud"].schema)
    staged = stage_events(bronze, AT).unionByName(stage_events(bronze, None).withColumn("row_hash", F.lit(None).cast("string")).withColumn("staged_at", F.lit(None).cast("timestamp")))
    whole = staged.select(row_json(staged.columns).alias("p"))
    found = sv.event_payload(staged, "fraud")
    assert sorted(r.p for r in whole.collect()) == sorted(r.event_payload for r in found.collect())
    turned = staged.select(*reversed(staged.columns))  # the payload keeps the order of the columns
    assert sorted(r.event_payload for r in sv.with_payload(turned).collect()) == sorted(r.p for r in turned.select(row_json(turned.columns).alias("p")).collect())
    plan = sv.event_payload(stage_events(bronze, AT), "fraud")._jdf.queryExecution().optimizedPlan().toString()
    assert "event_payload" in plan and "StructField(row_hash,StringType,true),StructField(staged_at" not in plan
