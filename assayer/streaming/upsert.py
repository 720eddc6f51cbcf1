"""Streaming upsert into silver, and de-duplication of re-delivered messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalogue import Domain
from ..functions.hashing import row_hash
from ..operators.silver import ingested_after, late_and_taken, silver
from ..operators.staging import stage_events
from ..sources.files import path_exists
from ..sources.tables import UpsertTable
from .ingest import writer_id


# Counts observed below a shuffle are lost when the rule replaces a stage without rows, and nothing would ever deliver them.
KEEP_EMPTY_STAGES = {"spark.sql.adaptive.optimizer.excludedRules": "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"}


def stream_upsert_latest(
    bronze: DataFrame,
    domain: Domain,
    table: UpsertTable,
    checkpoint: str,
    staged_at: datetime | str | Column | None = None,
    compact_every: int = 8,
    counts: str | None = None,
) -> StreamingQuery:
    """Stage, clean and upsert every micro-batch.

    The batch id names the batch in the table, so a repeated micro-batch replaces itself; a table belongs to one stream, and
    another checkpoint's is refused. The log is folded every ``compact_every`` batches, or when it outweighs a tenth of the
    base; what that replaces is dropped after the table's ``grace``, so the folders of a long stream stay few.

    The checkpoint takes the place of the ingestion-time bound, unless ``counts`` names a folder: then a micro-batch takes only rows
    ingested after all stored before it, and the rows it took and left out as late, observed while it is written, are kept there by batch.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        writer = writer_id(session, checkpoint)
        if counts is None:
            table.write_batch(silver(stage_events(batch, staged_at), domain), batch_id, writer)
        else:
            for key, value in KEEP_EMPTY_STAGES.items():
                session.conf.set(key, value)
            seen, bound = Observation(), table.bound_before(batch_id)
            fresh = ingested_after(batch.observe(seen, *late_and_taken(bound)), bound)
            if table.write_batch(silver(stage_events(fresh, staged_at), domain), batch_id, writer):
                row = session.range(1).select(*[F.lit(seen.get[c]).cast("long").alias(c) for c in ("accepted_rows", "late_rows")])
                row.write.mode("overwrite").parquet(f"{counts}/batch_id={batch_id}")
        table.compact_if_worth(compact_every)
        table.remove_folded()

    return (
        bronze.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_late_rows(spark: SparkSession, counts: str) -> DataFrame:
    """Rows each micro-batch of a counting stream took and left out as late: batch_id, accepted_rows, late_rows."""
    schema = "accepted_rows bigint, late_rows bigint, batch_id bigint"
    rows = spark.read.schema(schema).parquet(counts) if path_exists(spark, counts) else spark.createDataFrame([], schema)
    return rows.select("batch_id", "accepted_rows", "late_rows")


def drop_replays(rows: DataFrame, within: str = "1 day", parts: int = 32) -> DataFrame:
    """Drop rows equal in everything but ``ingested_at`` that arrive within the given time of each other.

    On streams the state is bounded by the watermark. A message delivered over and over would send all its
    copies to one state partition, so copies are first dropped in ``parts`` shares, cut by source partition; at
    most one copy per share goes on to the second step, which drops the rest. On batches the partial aggregate
    does the same, and the time has no effect.
    """
    content = [c for c in rows.columns if c != "ingested_at"]
    hashed = rows.withColumn("content_hash", row_hash(content))
    if not rows.isStreaming:
        return hashed.dropDuplicates(["content_hash"])
    shared = hashed.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    # The watermark runs on the time of arrival, so no row is ever late and dropped for it.
    shared = shared.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    few = shared.dropDuplicatesWithinWatermark(["content_hash", "_part"])
    return few.drop("_part").dropDuplicatesWithinWatermark(["content_hash"]).drop("_arrived")


def stream_replay_dedup(rows: DataFrame, path: str, checkpoint: str, within: str = "1 day") -> StreamingQuery:
    return (
        drop_replays(rows, within)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
