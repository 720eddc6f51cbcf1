"""Silver: cleaning, latest record per key, incremental filter and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalogue import DOMAINS, Domain
from ..functions.cleaning import lower_text, safe_date, safe_timestamp, text, upper_text
from ..functions.hashing import row_hash, row_json, row_json_after
from ..sources.files import INGEST_DAY

EPOCH_FLOOR = "1900-01-01 00:00:00"
# Estimated bytes of a frame from which on copies are looked for by hash, so that rows without one are not shuffled.
HASH_FIRST_BYTES = 64 << 20
UNKNOWN_BYTES = 1 << 50
FILTER_BITS, BITMAP_BITS = 1 << 28, 1 << 15  # of the filter of repeated hashes, 32 MiB, and of one bitmap of Spark's bitmap functions


def clean_bookings(staged: DataFrame) -> DataFrame:
    c = F.col
    return staged.select(
        c("row_hash").alias("booking_event_sk"),
        "staged_at",
        text(c("booking_id")).alias("booking_id"),
        text(c("customer_id")).alias("customer_id"),
        safe_date(c("booking_date")).alias("booking_date"),
        safe_date(c("travel_start_date")).alias("travel_start_date"),
        safe_date(c("travel_end_date")).alias("travel_end_date"),
        lower_text(c("booking_status")).alias("booking_status"),
        c("total_amount").cast("double").alias("total_amount"),
        upper_text(c("currency")).alias("currency"),
        text(c("destination_city")).alias("destination_city"),
        upper_text(c("destination_country")).alias("destination_country"),
        lower_text(c("channel")).alias("channel"),
        safe_timestamp(c("created_at")).alias("created_at"),
        safe_timestamp(c("updated_at")).alias("updated_at"),
        "ingested_at",
    )


def clean_opportunities(staged: DataFrame) -> DataFrame:
    c = F.col
    return staged.select(
        c("row_hash").alias("crm_event_sk"),
        "staged_at",
        text(c("opportunity_id")).alias("opportunity_id"),
        lower_text(c("stage")).alias("stage"),
        text(c("agent_id")).alias("agent_id"),
        text(c("product")).alias("product"),
        c("value").cast("double").alias("value"),
        upper_text(c("region")).alias("region"),
        F.to_date(safe_timestamp(c("expected_close_date"))).alias("expected_close_date"),
        safe_timestamp(c("updated_at")).alias("updated_at"),
        "ingested_at",
    )


def clean_customers(staged: DataFrame) -> DataFrame:
    c = F.col
    return staged.select(
        c("row_hash").alias("customer_event_sk"),
        "staged_at",
        text(c("customer_id")).alias("customer_id"),
        text(c("full_name")).alias("full_name"),
        lower_text(c("email")).alias("email"),
        text(c("phone")).alias("phone"),
        upper_text(c("country")).alias("country"),
        text(c("city")).alias("city"),
        lower_text(c("customer_segment")).alias("customer_segment"),
        lower_text(c("loyalty_tier")).alias("loyalty_tier"),
        safe_timestamp(c("created_at")).alias("created_at"),
        safe_timestamp(c("updated_at")).alias("updated_at"),
        "ingested_at",
    )


def event_payload(staged: DataFrame, domain: str) -> DataFrame:
    """Key, stage time, ingestion time and the whole staged row as JSON text."""
    rows = with_payload(staged, "staged_at", "ingested_at")
    return rows.select(F.col("row_hash").alias(DOMAINS[domain].sk), "staged_at", "ingested_at", "event_payload")


def with_payload(staged: DataFrame, *kept: str) -> DataFrame:
    """``row_hash``, the columns that are kept, and ``event_payload``, the whole staged row as JSON text.

    The JSON of the source columns is what the hash is made of. Named next to the hash, which is named once, it is rendered once for
    both, since Spark shares equal expressions of one projection.
    """
    source = [c for c in staged.columns if c not in ("row_hash", "staged_at")]
    if staged.columns[:2] != ["row_hash", "staged_at"] or not source:
        return staged.select("row_hash", *[F.col(f"`{c}`") for c in kept], row_json(staged.columns).alias("event_payload"))
    rows = staged.select("row_hash", *[F.col(f"`{c}`") for c in dict.fromkeys(["staged_at", *kept])], row_json(source).alias("_source"))
    payload = row_json_after(("row_hash", "staged_at"), F.col("_source")).alias("event_payload")
    return rows.select("row_hash", *[F.col(f"`{c}`") for c in kept], payload)


def estimated_bytes(df: DataFrame) -> int | None:
    """Spark's own estimate of a frame's size; None where it has none, as for rows that come from an RDD or a micro-batch."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else None


def _may_have_copies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with a column ``_maybe``: false only for rows that are certainly alone.

    The hashes that occur more than once, 8 bytes a row to find them, set bits of a filter of at most ``FILTER_BITS``; so what is
    broadcast is bounded, and a fuller filter costs shuffled rows, never a wrong result.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    slot = F.pmod("_hash", F.lit(FILTER_BITS))
    block, bit = F.shiftright(slot, 15), slot.bitwiseAND(F.lit(BITMAP_BITS - 1))
    often = hashed.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1")
    bitmaps = often.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bitmap"))
    found = hashed.join(F.broadcast(bitmaps), block == F.col("_block"), "left")
    byte = F.conv(F.hex(F.substring("_bitmap", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    maybe = F.when(F.col("_bitmap").isNotNull(), is_set).otherwise(F.lit(False))
    return found.withColumn("_maybe", maybe).drop("_hash", "_block", "_bitmap")


def distinct_events(staged: DataFrame, hash_first: bool | None = None) -> DataFrame:
    """One staged row per distinct source row, the last staged one.

    The row hash stands for all source columns, ``ingested_at`` among them, so grouping by the columns themselves
    gives the same rows as ranking the copies of a hash. It needs no sort, and only the rows that are left are
    rendered and hashed. Zeros of either sign count as equal, as they do in any grouping.

    Grouping shuffles whole rows. With ``hash_first`` only rows that may have a copy are grouped, for which the source is read three times
    and a hash of each row shuffled; by default that is done for frames estimated at ``HASH_FIRST_BYTES`` or more. It suits
    rows that are cheap to make again and always come out the same.
    """
    columns = [c for c in staged.columns if c not in ("row_hash", "staged_at")]
    by = [F.col(f"`{c}`") for c in columns]
    types = {f.name: f.dataType for f in staged.schema}
    if hash_first is None:
        size = estimated_bytes(staged)
        hash_first = size is not None and size >= HASH_FIRST_BYTES
    # Equal values have equal hashes in plain types; in texts, only if they are compared by their bytes.
    plain = all(isinstance(t, T.AtomicType) and (not isinstance(t, T.StringType) or t == T.StringType()) for t in map(types.get, columns))
    if hash_first and plain:
        tested = _may_have_copies(staged.select(*by, "staged_at"), columns)
        floats = (T.DoubleType, T.FloatType)
        zero = lambda c: F.when(F.col(f"`{c}`") == 0, F.lit(0).cast(types[c])).otherwise(F.col(f"`{c}`"))
        alone = tested.where(~F.col("_maybe")).select(*[zero(c).alias(c) if isinstance(types[c], floats) else F.col(f"`{c}`") for c in columns], "staged_at")
        rows = alone.unionByName(tested.where("_maybe").groupBy(*by).agg(F.max("staged_at").alias("staged_at")))
    else:
        rows = staged.groupBy(*by).agg(F.max("staged_at").alias("staged_at"))
    return rows.select(row_hash(columns).alias("row_hash"), "staged_at", *by)


def event_index(staged: DataFrame) -> DataFrame:
    """Opaque silver rows without their payload, from rows that carry their hash: one per row hash.

    The hash covers ``ingested_at``, so all copies of a row agree in it and two maxima give the latest copy. A
    hash aggregate does this without the sort that ranking needs.
    """
    return staged.groupBy("row_hash").agg(F.max("ingested_at").alias("ingested_at"), F.max("staged_at").alias("staged_at"))


def latest(df: DataFrame, key: str, order_by: list[Column]) -> DataFrame:
    """The first row per key in the given order; all NULL keys form one group.

    ``row_number() = 1`` lets Catalyst keep one row per key inside each map task before the shuffle, so a key
    that holds a third of the rows sends at most one row per task.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order_by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def _newest_first(*columns: Column | str) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in columns]


def latest_booking(df: DataFrame) -> DataFrame:
    moved = F.coalesce("updated_at", "created_at")
    return latest(df, "booking_id", _newest_first(moved, "ingested_at", "staged_at", "booking_event_sk"))


def latest_opportunity(df: DataFrame) -> DataFrame:
    return latest(df, "opportunity_id", _newest_first("updated_at", "ingested_at", "staged_at", "crm_event_sk"))


def latest_customer(df: DataFrame) -> DataFrame:
    return latest(
        df, "customer_id", _newest_first("updated_at", "created_at", "ingested_at", "staged_at", "customer_event_sk")
    )


def silver(staged: DataFrame, domain: Domain, hash_first: bool | None = None) -> DataFrame:
    """The silver rows of one staged batch; ``hash_first`` as in ``distinct_events``."""
    if domain.name == "booking":
        return latest_booking(clean_bookings(staged))
    if domain.name == "crm":
        return latest_opportunity(clean_opportunities(staged))
    if domain.name == "customer":
        return latest_customer(clean_customers(staged))
    # Copies are dropped before the payload is written out: the columns are smaller than their JSON.
    return event_payload(distinct_events(staged, hash_first), domain.name)


def bound_literal(micros: int | None) -> Column:
    """An ingestion time in microseconds as a timestamp literal; None stands for a table without any."""
    return F.lit(EPOCH_FLOOR).cast("timestamp") if micros is None else F.timestamp_micros(F.lit(micros))


def ingestion_bound(target: DataFrame) -> Column:
    """The newest ``ingested_at`` of a table as a literal; one number comes to the driver."""
    return bound_literal(target.agg(F.unix_micros(F.max("ingested_at"))).first()[0])


def ingested_after(df: DataFrame, bound: Column | None) -> DataFrame:
    """Rows ingested after a bound; all rows when there is none yet.

    The bound is a literal, so it reaches the parquet scan and skips row groups, and whole folders where bronze
    is kept by day. The comparison is strict: equal and NULL times are skipped.
    """
    if bound is None:
        return df
    fresh = df.filter(F.col("ingested_at") > bound)
    return fresh.filter(F.col(INGEST_DAY) >= F.to_date(bound)) if INGEST_DAY in df.columns else fresh


def incremental_filter(df: DataFrame, target: DataFrame | None) -> DataFrame:
    """Rows ingested after everything in ``target``; all rows when there is no target yet.

    For a plain target its newest time is read. Tables that are kept with ``UpsertTable`` know theirs (``bound_before``).
    """
    return ingested_after(df, None if target is None else ingestion_bound(target))


def late_and_taken(bound: Column | None) -> list[Column]:
    """Counts of the rows an ingestion bound takes and of those it leaves out as late."""
    taken = F.lit(True) if bound is None else F.coalesce(F.col("ingested_at") > bound, F.lit(False))
    return [F.count_if(taken).alias("accepted_rows"), F.count_if(~taken).alias("late_rows")]


def skipped_rows(df: DataFrame, target: DataFrame) -> DataFrame:
    """How many rows the incremental filter takes and how many it leaves out as late."""
    return df.agg(*late_and_taken(ingestion_bound(target)))


def append_new_columns(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Both row sets under the union of their columns; what a side lacks is NULL."""
    return target.unionByName(batch, allowMissingColumns=True)


def not_replaced(target: DataFrame, batch: DataFrame, key: str, *bucketed_with: str) -> DataFrame:
    """The target rows whose key is not in the batch.

    NULL keys match nothing: they bypass the join, so they cannot gather in one shuffle partition. The
    remaining target keys are unique. Whether the batch is broadcast is left to Spark's own size check. ``bucketed_with`` names
    further columns that follow from the key and by which both sides are bucketed.
    """
    columns = [key, *bucketed_with]
    present = batch.select(*[f"`{c}`" for c in columns]).filter(F.col(f"`{key}`").isNotNull())
    keyed = target.filter(F.col(f"`{key}`").isNotNull()).join(present, columns, "left_anti")
    return keyed.select(*[f"`{c}`" for c in target.columns]).unionByName(target.filter(F.col(f"`{key}`").isNull()))


def upsert_latest(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``batch`` rows replace the target rows with the same key; all others are kept."""
    return append_new_columns(not_replaced(target, batch, key), batch)
