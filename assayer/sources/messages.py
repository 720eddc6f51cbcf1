"""From raw messages to typed bronze rows."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strict JSON: no single quotes, no raw control characters.
STRICT = {"allowSingleQuotes": "false", "allowUnquotedControlChars": "false"}
END = "~end"


def message_stream(spark: SparkSession, source: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Unbounded source. ``source`` is any streaming format ('kafka', 'text', 'json', 'parquet', …).

    File formats take their folder as ``path``; Kafka takes its own options and yields a ``value`` column.
    """
    reader = spark.readStream.format(source).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load()


def decode(value: Column) -> Column:
    """UTF-8 text of a message; NULL when the bytes are not UTF-8."""
    return F.try_validate_utf8(value.cast("string"))


def read_objects(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Add ``_raw``, the object's fields as text (NULL when the message is not one JSON object).

    Spark's parser stops after the first complete value and would overlook what follows it. So the message is
    read as the first element of an array that we end with a marker object: only when the whole message is one
    value does the array have two elements, the second one being the marker. Fields are read as text because a
    number sent as a JSON string must survive until it is cast.
    """
    fields = [T.StructField(f.name, T.StringType(), True) for f in schema]
    return _read_whole(df, T.StructType([*fields, T.StructField(END, T.StringType(), True)]), value)


def _read_whole(df: DataFrame, kind: T.DataType, value: str) -> DataFrame:
    """Add ``_raw``, the object as the given type (NULL when the message is not one JSON object)."""
    framed = F.concat(F.lit("["), decode(F.col(value)), F.lit(f',{{"{END}":1}}]'))
    df = df.withColumn("_items", F.from_json(framed, T.ArrayType(kind), STRICT))
    whole = (F.size("_items") == 2) & (F.get("_items", F.lit(1))[END] == "1")
    return df.withColumn("_raw", F.when(whole, F.get("_items", F.lit(0)))).drop("_items")


def read_fields(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``_names`` and ``_texts``, the fields of the object as text, last ones first (both NULL when the message is not one JSON object).

    As ``read_objects``, for messages that carry few of very many names: a parse into a struct costs each message a step for every
    name that the struct has, one into a map a step for every field that the message has. ``field`` takes a field from them.
    """
    read = _read_whole(df, T.MapType(T.StringType(), T.StringType()), value)
    # Of a name that comes twice the last field counts, as it does in a struct.
    return read.withColumns({"_names": F.reverse(F.map_keys("_raw")), "_texts": F.reverse(F.map_values("_raw"))}).drop("_raw")


def field(name: str) -> Column:
    """The text of a field after ``read_fields``; NULL when the object lacks it."""
    return F.get("_texts", (F.array_position("_names", name) - 1).cast("int"))


def _read(df: DataFrame, schema: T.StructType, required: Iterable[str], value: str) -> DataFrame:
    """``read_objects`` and, where keys are required, ``_keys``."""
    if required:
        df = df.withColumn("_keys", F.json_object_keys(decode(F.col(value))))
    return read_objects(df, schema, value)


def _judge(schema: T.StructType, required: Iterable[str]) -> tuple[Column, Column]:
    """The typed row of a read message, and why it is rejected (NULL for a good one)."""
    raw = F.col("_raw")
    typed = {f.name: raw[f.name].try_cast(f.dataType) for f in schema}
    lost = [
        F.when(raw[f.name].isNotNull() & typed[f.name].isNull(), F.lit(f.name))
        for f in schema
        if not isinstance(f.dataType, T.StringType)
    ]
    reason = F.when(raw.isNull(), F.lit("not a JSON object"))
    missing = [F.when(~F.array_contains("_keys", k), F.lit(k)) for k in required]
    for label, names in (("missing", missing), ("bad value", lost)):
        if names:
            listed = F.concat_ws(",", *names)
            reason = reason.when(listed != "", F.concat(F.lit(f"{label}: "), listed))
    return F.struct(*[c.alias(n) for n, c in typed.items()]), reason


def parse_json_events(
    df: DataFrame, schema: T.StructType, required: Iterable[str] = (), value: str = "value"
) -> DataFrame:
    """Typed rows of the good messages; all others are dropped (see ``rejected_messages``).

    A good message is one JSON object that has every ``required`` key (a null value counts as present) and
    whose numbers, booleans and times can be cast. Each message gives an array of one row or none: a filter on
    the parsed value would be pushed below the parse and repeat it.
    """
    required = tuple(required)
    row, reason = _judge(schema, required)
    return _read(df, schema, required, value).select(F.inline(F.when(reason.isNull(), F.array(row))))


def rejected_messages(
    df: DataFrame, schema: T.StructType, required: Iterable[str] = (), value: str = "value"
) -> DataFrame:
    """The messages ``parse_json_events`` drops, with the reason."""
    required = tuple(required)
    _, reason = _judge(schema, required)
    verdict = F.struct(*[F.col(c) for c in df.columns], reason.alias("reject_reason"))
    return _read(df, schema, required, value).select(F.inline(F.when(reason.isNotNull(), F.array(verdict))))


def require_fields(df: DataFrame, required: Iterable[str], value: str = "value") -> DataFrame:
    """Messages that carry every key; a key with a null value is present."""
    keys = F.json_object_keys(decode(F.col(value)))
    wanted = F.array(*[F.lit(k) for k in required])
    return df.filter(F.size(F.array_except(wanted, keys)) == 0)


def stamp_ingested_at(df: DataFrame, at: datetime | Column | None = None, precision: str = "microsecond") -> DataFrame:
    """Overwrite ``ingested_at`` with the processing time, whatever the producer sent."""
    if precision not in ("microsecond", "second"):
        raise ValueError(f"precision must be 'microsecond' or 'second', not {precision!r}")
    moment = F.current_timestamp() if at is None else at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    return df.withColumn("ingested_at", moment if precision == "microsecond" else F.date_trunc("second", moment))
