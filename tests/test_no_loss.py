"""Paths that once lost rows without a word."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from assayer import session
from assayer.catalogue import DOMAINS
from assayer.sources.files import conform, json_records
from assayer.sources.messages import message_stream
from assayer.sources.tables import UpsertTable
from assayer.streaming import ingest, upsert

CRM = DOMAINS["crm"]


def test_fanout_writes_every_domain_of_many(spark, tmp_path):
    fraud = DOMAINS["fraud"]
    many = [SimpleNamespace(name=f"d{i}", schema=fraud.schema) for i in range(60)]
    rows = [(d.name, '{"event_id":"e","risk_score":0.5,"fraud_flag":true}') for d in many] + [(f"other{i}", "{}") for i in range(40)]
    ingest.fanout_batch(spark.createDataFrame(rows, "topic string, value string"), 0, str(tmp_path), many, None)
    assert sum(ingest.read_fanout(spark, str(tmp_path), d).count() for d in many) == 60


def crm(spark, *ids, day="2024-01-01"):
    rows = spark.createDataFrame([(i,) for i in ids], "opportunity_id string")
    return conform(rows.withColumn("ingested_at", F.lit(day).cast("timestamp")), CRM.schema)


def test_a_second_checkpoint_cannot_overwrite_stored_batches(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "table"), "opportunity_id")
    for n, ids in enumerate((("A", "B"), ("C",))):
        crm(spark, *ids).write.parquet(str(tmp_path / f"in{n}"))
        stream = message_stream(spark, "parquet", CRM.schema, path=str(tmp_path / f"in{n}"))
        query = upsert.stream_upsert_latest(stream, CRM, table, str(tmp_path / f"state{n}"), "2024-01-02")
        if n:
            with pytest.raises(Exception, match="another writer"):
                query.awaitTermination()
        else:
            query.awaitTermination()
    assert {r.opportunity_id for r in table.read().collect()} == {"A", "B"}


def test_an_old_batch_number_is_refused_and_a_replay_skipped(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path), "k")
    for n in (5, 6):
        table.write_batch(spark.createDataFrame([(f"k{n}", "v")], "k string, v string"), n)
    table.compact()
    table.write_batch(spark.createDataFrame([("k6", "again")], "k string, v string"), 6)
    with pytest.raises(ValueError, match="newer batches"):
        table.write_batch(spark.createDataFrame([("c", "v")], "k string, v string"), 4)
    assert {tuple(r) for r in table.read().collect()} == {("k5", "v"), ("k6", "v")}


def test_unique_late_rows_are_kept(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for name, day in (("A", "2024-03-01"), ("L0", "2024-01-01"), ("L1", "2024-01-02"), ("L2", "2023-01-01")):
        crm(spark, name, day=day).write.mode("append").parquet(inbox)
        stream = message_stream(spark, "parquet", CRM.schema, path=inbox)
        upsert.stream_replay_dedup(stream, out, state, "1 hour").awaitTermination()
    assert {r.opportunity_id for r in spark.read.parquet(out).collect()} == {"A", "L0", "L1", "L2"}


def test_no_machine_local_scratch_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(SimpleNamespace(conf=conf, sparkContext=context), "x")
    context.master = "local[4]"
    assert session.scratch_dir(SimpleNamespace(conf=conf, sparkContext=context), "x")


def test_exported_records_keep_microseconds(spark):
    row = json_records(spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00.123456' AS t")).first().record
    assert ".123456" in row
