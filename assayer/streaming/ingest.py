"""Streaming ingestion: messages in, typed bronze rows out."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..catalogue import CRM_REQUIRED, DOMAINS, Domain
from ..sources.files import INGEST_DAY, conform, matching_paths, with_ingest_day
from ..sources.messages import decode, field, parse_json_events, read_fields, rejected_messages, stamp_ingested_at

QUARANTINE = "quarantine"
TABLE = "bronze_table"
# Files that a task may have open at once; beyond that it sorts its rows by file.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
# Messages for each file that a task would leave from which on a batch is written as it comes.
FILE_MESSAGES = 10_000


def stream_ingest(
    messages: DataFrame,
    schema: T.StructType,
    path: str,
    checkpoint: str,
    required: Iterable[str] = (),
    precision: str = "microsecond",
    continuous: bool = False,
) -> StreamingQuery:
    """Parse, filter, stamp and append each message once; the checkpoint makes a restart resume.

    Everything is element-wise, so no state and no shuffle: throughput grows with the source partitions. The
    table has a folder per day of ingestion.
    """
    rows = conform(stamp_ingested_at(parse_json_events(messages, schema, required), precision=precision), schema)
    writer = with_ingest_day(rows).writeStream.format("parquet").outputMode("append").partitionBy(INGEST_DAY)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start(path)


def stream_quarantine(
    messages: DataFrame, schema: T.StructType, path: str, checkpoint: str, required: Iterable[str] = ()
) -> StreamingQuery:
    """Append the rejected messages with their reason."""
    rejected = rejected_messages(messages, schema, required)
    writer = rejected.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def fanout_columns(domains: Iterable[Domain]) -> dict[str, tuple[str, T.DataType, list[str]]]:
    """Columns of the one table all domains are written to: name there → (name, type, domains that have it).

    A name that domains use with several types has a column for each.
    """
    owners: dict[tuple[str, T.DataType], list[str]] = {}
    for domain in domains:
        for f in domain.schema:
            if f.name != "ingested_at":
                owners.setdefault((f.name, f.dataType), []).append(domain.name)
    several = Counter(name for name, _ in owners)
    return {
        name if several[name] == 1 else f"{name}__{kind.simpleString()}": (name, kind, names)
        for (name, kind), names in owners.items()
    }


def fanout_rows(messages: DataFrame, domains: Iterable[Domain], at: Column | None = None) -> DataFrame:
    """Each message as one row of the table of its topic, or of the quarantine with its topic, value and reason.

    A message is parsed once, with the names of all domains; each name is cast for the domains that have it and NULL for others.
    """
    domains = list(domains)
    columns = fanout_columns(domains)
    topic, value = F.col("message_topic"), F.col("message_value")
    strict = {d.name: tuple(CRM_REQUIRED) for d in domains if d.name == "crm"}
    sent = messages.select(F.col("topic").alias("message_topic"), F.col("value").alias("message_value"))
    # A topic by its number is told apart faster than by its name, which each column would compare anew.
    order = [d.name for d in domains]
    read = read_fields(sent, "message_value").withColumn("_topic", F.array_position(F.array(*map(F.lit, order)), topic).cast("int"))
    typed, lost = {}, []
    for column, (name, kind, names) in columns.items():
        own = F.col("_topic").isin(*[order.index(n) + 1 for n in names])
        typed[column] = F.when(own, field(name).try_cast(kind))
        if not isinstance(kind, T.StringType):
            lost.append(F.when(own & field(name).isNotNull() & typed[column].isNull(), F.lit(name)))
    keys = F.json_object_keys(decode(value))
    missing = [
        F.when(topic == name, F.array_join(F.array_except(F.array(*map(F.lit, required)), keys), ",")) for name, required in strict.items()
    ]
    listed = {"missing": F.concat_ws(",", *missing), "bad value": F.concat_ws(",", *lost)}
    reason = F.when(~F.coalesce(topic.isin(*[d.name for d in domains]), F.lit(False)), F.lit("unknown topic"))
    reason = reason.when(F.col("_names").isNull(), F.lit("not a JSON object"))
    for label, names in listed.items():
        reason = reason.when(names != "", F.concat(F.lit(f"{label}: "), names))
    moment = F.current_timestamp() if at is None else at
    judged = read.select(topic, value, reason.alias("reject_reason"), *[c.alias(n) for n, c in typed.items()])
    good = F.col("reject_reason").isNull()
    precise = F.when(topic == "crm", moment).otherwise(F.date_trunc("second", moment))
    return judged.select(
        *[F.when(good, F.col(n)).alias(n) for n in columns],
        F.when(good, precise).alias("ingested_at"),
        F.when(~good, topic).alias("message_topic"),
        F.when(~good, value).alias("message_value"),
        "reject_reason",
        F.when(good, topic).otherwise(F.lit(QUARANTINE)).alias(TABLE),
        F.to_date(moment).alias(INGEST_DAY),
    )


def fills_files(messages: DataFrame, tables: int, file_messages: int = FILE_MESSAGES) -> bool:
    """Whether the tasks of a batch hold so many messages that a file of each task and table is no small one on average."""
    return messages.count() >= file_messages * tables * messages.rdd.getNumPartitions()


def fanout_batch(
    messages: DataFrame,
    batch_id: int,
    root: str,
    domains: Iterable[Domain],
    at: Column | None,
    writer: str = "batch",
    file_messages: int = FILE_MESSAGES,
) -> None:
    """Write one micro-batch of (topic, value) messages to the bronze folders of its domains, in one job.

    The folders are <root>/batch_id=<writer>-<n>/bronze_table=<domain>/ingest_date=<day>. A folder per writer and batch makes a replay
    overwrite its own rows instead of appending them again, and no other writer's rows. CRM messages need all their keys and are
    stamped to the microsecond, the others to the second. What is not written to a domain goes to the quarantine with its topic
    and reason, messages of unknown or no topic included. The rows of a small batch are dealt by table first, into parts of even size, so
    that it leaves a file or a few for each table and not one of each task, and a topic with most of the rows is split. A batch whose tasks
    fill files of their own (``fills_files``) is neither shuffled nor sorted: a task keeps a file open for each table.
    """
    domains, spark = list(domains), messages.sparkSession
    rows = fanout_rows(messages, domains, at)
    tables = len(domains) + 1
    open_files = spark.conf.get(OPEN_FILES)
    if fills_files(messages, tables, file_messages):
        spark.conf.set(OPEN_FILES, 2 * tables)  # a batch may see midnight
    else:
        rows = rows.hint("rebalance", F.col(TABLE))
    try:
        rows.write.mode("overwrite").partitionBy(TABLE, INGEST_DAY).parquet(f"{root}/batch_id={writer}-{batch_id}")
    finally:
        spark.conf.set(OPEN_FILES, open_files)


def fanout_bronze(
    messages: DataFrame,
    root: str,
    checkpoint: str,
    domains: Iterable[Domain] = tuple(DOMAINS.values()),
    at: Column | None = None,
) -> StreamingQuery:
    """One stream of (topic, value) messages into a typed bronze table per domain."""
    wanted = list(domains)
    return (
        messages.writeStream.foreachBatch(
            lambda df, n: fanout_batch(df, n, root, wanted, at, writer_id(df.sparkSession, checkpoint))
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def writer_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a stream keeps in its checkpoint folder: the same after a restart, another one for a new checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _read_table(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    folders = matching_paths(spark, f"{root}/batch_id=*/{TABLE}={name}")
    if not folders:
        return spark.createDataFrame([], schema.add(INGEST_DAY, "date"))
    # Only the folders of this table are listed; the schema is given, so no file is opened for it.
    return spark.read.schema(schema).option("basePath", root).parquet(*folders)


def read_fanout(spark: SparkSession, root: str, domain: Domain, domains: Iterable[Domain] = tuple(DOMAINS.values())) -> DataFrame:
    """The bronze table of a domain written by ``fanout_bronze`` for ``domains``, with its day of ingestion; typed and empty before its first message."""
    own = {name: column for column, (name, _, names) in fanout_columns(domains).items() if domain.name in names}
    stored = T.StructType([T.StructField(own.get(f.name, f.name), f.dataType) for f in domain.schema])
    rows = _read_table(spark, root, domain.name, stored)
    return rows.select(*[F.col(own.get(f.name, f.name)).alias(f.name) for f in domain.schema], INGEST_DAY)


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """The messages ``fanout_bronze`` could not place: topic, value and reason."""
    schema = T.StructType.fromDDL("message_topic string, message_value string, reject_reason string")
    rows = _read_table(spark, root, QUARANTINE, schema)
    return rows.select(F.col("message_topic").alias("topic"), F.col("message_value").alias("value"), "reject_reason")
