import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.catalogue import CRM_REQUIRED, DOMAINS, OPAQUE, schema_from_spec
from assayer.sources import files, messages

SCHEMA = schema_from_spec("a,b,n:FLOAT")


def parsed(spark, texts, required=()):
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    return [tuple(r) for r in messages.parse_json_events(df, SCHEMA, required).collect()]


@pytest.mark.parametrize(
    "text",
    ["[1]", "{bad", "", "null", "5", '"s"', "true", "{'a':1}", '{"a":1', '{"a":1} x', '{"a":1},{"b":2}', '{"a":1}] [{}',
     '{"a":1}} {', '{"a":1},"x":2', '[{"a":1}]', '{"a":1},', '{"a":01}', '{"a":"x\ty"}', '{"a":1},{"~end":1}'],
)
def test_anything_but_one_object_is_dropped(spark, text):
    assert parsed(spark, [text]) == []


def test_objects_are_kept(spark):
    texts = ['{"a":"x","b":"y","n":1.5}', ' {"a":1} ', '{"a":null,"extra":[1]}', "{}", '{"a":1,"a":2}', '{"a":{"z":1}}']
    assert parsed(spark, texts) == [
        ("x", "y", 1.5), ("1", None, None), (None, None, None), (None, None, None), ("2", None, None), ('{"z":1}', None, None),
    ]


def test_numbers_as_text_are_read_and_bad_ones_rejected_with_a_reason(spark):
    texts = ['{"n":"12.5"}', '{"n":"abc"}', '{"n":null}']
    assert parsed(spark, texts) == [(None, None, 12.5), (None, None, None)]
    df = spark.createDataFrame([(t,) for t in [*texts, "[1]", '{"a":1}']], "value string")
    rejected = messages.rejected_messages(df, SCHEMA, ["a"]).collect()
    assert {(r.value, r.reject_reason) for r in rejected} == {
        ('{"n":"12.5"}', "missing: a"), ('{"n":"abc"}', "missing: a"), ('{"n":null}', "missing: a"),
        ("[1]", "not a JSON object"),
    }
    rejected = messages.rejected_messages(df, SCHEMA).collect()
    assert {(r.value, r.reject_reason) for r in rejected} == {
        ('{"n":"abc"}', "bad value: n"), ("[1]", "not a JSON object"),
    }


def test_required_means_present_not_filled(spark):
    full = {k: None for k in CRM_REQUIRED}
    short = {k: "x" for k in CRM_REQUIRED[1:]}
    df = spark.createDataFrame([(json.dumps(full),), (json.dumps(short),), ("[1]",), ("{bad",)], "value string")
    kept = messages.require_fields(df, CRM_REQUIRED).collect()
    assert [r.value for r in kept] == [json.dumps(full)]
    assert messages.parse_json_events(df, DOMAINS["crm"].schema, CRM_REQUIRED).count() == 1


def test_bytes_that_are_not_utf8_are_dropped(spark):
    df = spark.createDataFrame([(b'{"a":"\xff"}',), (b'{"a":"\xc3\xb3"}',)], "value binary")
    assert [r.a for r in messages.parse_json_events(df, SCHEMA).collect()] == ["ó"]


def _python_reads(text):
    def refuse(_):
        raise ValueError

    try:
        return isinstance(json.loads(text, parse_constant=refuse), dict)
    except ValueError:
        return False


plain = st.text("ab{}[]\":,0 ", max_size=12)
documents = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab]}", max_size=3),
    lambda inner: st.lists(inner, max_size=2) | st.dictionaries(st.sampled_from(["a", "b", "n"]), inner, max_size=2),
    max_leaves=4,
)
texts = plain | documents.map(json.dumps) | st.tuples(documents.map(json.dumps), plain).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=60, max_size=120))
def test_validity_agrees_with_a_strict_json_reader(spark, batch):
    df = spark.createDataFrame(list(enumerate(batch)), "i int, value string")
    rejected = messages.rejected_messages(df, schema_from_spec("a,b"))
    found = set(range(len(batch))) - {r.i for r in rejected.collect()}
    assert found == {i for i, t in enumerate(batch) if _python_reads(t)}


def test_stamp_overwrites_in_both_precisions(spark):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP '2000-01-01' AS ingested_at")
    at = dt.datetime(2024, 1, 31, 12, 0, 0, 123456)
    text = F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    assert messages.stamp_ingested_at(df, at).select(text).first()[0] == "2024-01-31 12:00:00.123456"
    assert messages.stamp_ingested_at(df, at, "second").select(text).first()[0] == "2024-01-31 12:00:00.000000"
    assert messages.stamp_ingested_at(df).filter("ingested_at > '2020-01-01'").count() == 1
    with pytest.raises(ValueError):
        messages.stamp_ingested_at(df, at, "day")


def test_catalogue_and_schema_specs():
    assert len(DOMAINS) == 26 and len(OPAQUE) == 23
    assert all(d.schema.fieldNames()[-1] == "ingested_at" for d in DOMAINS.values())
    assert schema_from_spec("a:INTEGER,b:FLOAT,c").simpleString() == "struct<a:bigint,b:double,c:string>"
    with pytest.raises(ValueError):
        schema_from_spec("a:BLOB")


def test_append_creates_then_appends_and_old_files_read_with_new_columns(spark, tmp_path):
    path, schema = str(tmp_path / "t"), schema_from_spec("a,n:FLOAT")
    files.create_if_missing(spark, path, schema)
    files.create_if_missing(spark, path, schema)
    files.append_bronze(spark.createDataFrame([("x",)], "a string"), path, schema)
    files.append_bronze(spark.createDataFrame([(2.0, "y")], "n double, a string"), path, schema)
    wider = schema_from_spec("a,n:FLOAT,ingested_at:TIMESTAMP")
    rows = files.scan_source(spark, path, wider).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [("x", None, None), ("y", 2.0, None)]


def test_add_column_if_missing(spark):
    df = spark.createDataFrame([(1,)], "id int")
    added = files.add_column_if_missing(df, "ingested_at", "timestamp")
    assert dict(added.dtypes)["ingested_at"] == "timestamp" and added.first().ingested_at is None
    assert files.add_column_if_missing(added, "ingested_at", "timestamp").columns == added.columns


def test_export_keeps_null_fields(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 1.5)], "k string, v double")
    files.export_json_records(df, str(tmp_path / "out"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert lines == {'{"k":"a","v":null}', '{"k":"b","v":1.5}'}


def test_fields_of_a_map_are_those_of_a_struct(spark):
    """Odd messages give the same fields either way, and a map costs no step for each name it lacks."""
    texts = ['{"a":"1","b":2}', '{"a":1,"a":2}', '{"a":1,"a":null}', '{"a":null}', "{}", '{"a":{"x":[1, 2.50]},"z":[{"a":9}]}', '{"a":1.10,"b":1e400}', '{"a":NaN,"z":NaN}', '{"a":"\\u0041\\n"}',
             ' {"a":true} ', '{"a":1} tail', '{"a":1},{"b":2}', '{"a":1}]', '{"a":1},{"~end":1}', '{"~end":1}', '{"a":1', "{'a':1}", '{a:1}', '{"A":1}', "[1]", "[]", '[{"a":1}]', "1", '"x"', '""', "null", "prose", "", None, '{"":1}', '{"a":"b\nc"}']
    schema = schema_from_spec("a,b")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    one = messages.read_objects(df, schema).select("i", F.col("_raw").isNull().alias("none"), "_raw.a", "_raw.b")
    two = messages.read_fields(df).select("i", F.col("_names").isNull().alias("none"), messages.field("a").alias("a"), messages.field("b").alias("b"))
    rows = [sorted(map(tuple, x.collect())) for x in (one, two)]
    assert rows[0] == rows[1] and len(rows[0]) == len(texts)
    assert rows[1][1] == (1, False, "2", None) and rows[1][2] == (2, False, None, None)
