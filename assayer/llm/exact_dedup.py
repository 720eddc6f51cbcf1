"""Exact de-duplication with a two-pass Bloom filter, in DataFrame functions only.

Pass one counts how many rows set each slot of a filter and keeps a bit for every slot set twice or more. Pass two looks
each row up: a row with a slot that nobody else sets is certainly unique and passes straight through; only the others
shuffle, by the hash of their text. False positives cost a shuffled row, never a wrong result.

The filter has 16 slots a row, up to ``max_filter_bits`` (2**28 bits, 32 MiB), so what is broadcast is bounded; beyond
that more rows take the shuffle. Equal texts are counted map-side, so a text with a third of all rows is one row a task.

Null text counts as the empty text. Of equal texts the row with the smallest doc_id stays, a null doc_id last; of rows that
are equal in text and doc_id exactly one stays. An empty table gives an empty result. Columns named like the results are
ignored by ``exact_groups`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialize

SLOTS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 28
BITMAP_BITS = 8 * 4096  # bits of one bitmap of Spark's bitmap functions
PROBES = 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def text_sha256(text: Column) -> Column:
    """Hash of the text with every run of white space as one blank."""
    return F.sha2(normalised(text).cast("binary"), 256)


def _slot(sha: Column, probe: int, bits: int) -> Column:
    """Slot of a row under one probe: 15 of the 64 digits of its hash, modulo the size of the filter."""
    return F.conv(F.substring(sha, 1 + 15 * probe, 15), 16, 10).cast("long") % bits


def repeated_slots(rows: DataFrame, bits: int) -> DataFrame:
    """Bitmaps of the slots that two rows or more set: (block, bitmap), at most ``bits`` bits in all."""
    slots = rows.select(F.explode(F.array(*[_slot(F.col("sha"), p, bits) for p in range(PROBES)])).alias("slot"))
    often = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return often.groupBy((F.col("slot") / BITMAP_BITS).cast("long").alias("block")).agg(
        F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bitmap")
    )


def maybe_repeated(rows: DataFrame, hashes: DataFrame, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows with a column ``maybe``: false only where ``hashes`` has the row's ``sha`` once."""
    bits, wanted = BITMAP_BITS, min(max_filter_bits, SLOTS_PER_ROW * hashes.count())
    while bits < wanted:
        bits *= 2
    filter_ = materialize(repeated_slots(hashes, bits), "bloom")
    found = rows
    for p in range(PROBES):
        part = filter_.select(F.col("block").alias(f"block{p}"), F.col("bitmap").alias(f"bitmap{p}"))
        slot = _slot(F.col("sha"), p, bits)
        found = found.join(F.broadcast(part), (slot / BITMAP_BITS).cast("long") == F.col(f"block{p}"), "left")
        bit = slot % BITMAP_BITS
        byte = F.conv(F.hex(F.substring(F.col(f"bitmap{p}"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        set_ = (F.call_function("shiftright", byte, (bit % 8).cast("int")) % 2) == 1
        found = found.withColumn(f"set{p}", F.coalesce(set_, F.lit(False)))
    every = F.lit(True)
    for p in range(PROBES):
        every = every & F.col(f"set{p}")
    return found.withColumn("maybe", every).drop(*[f"{x}{p}" for p in range(PROBES) for x in ("block", "bitmap", "set")])


def exact_groups(docs: DataFrame, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(docs.select("doc_id", text_sha256(F.col("text")).alias("sha")), "hashes")
    tested = maybe_repeated(rows, rows, max_filter_bits)
    alone = tested.where(~F.col("maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    # Rows equal in text and doc_id count as one row with a number, so a hot text is one row a task and doc_id.
    same = materialize(tested.where("maybe").groupBy("sha", "doc_id").agg(F.count("*").alias("copies")), "same")
    groups = same.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = materialize(groups, "groups").withColumnRenamed("sha", "text_sha256")
    joined = same.join(groups, F.col("sha") == F.col("text_sha256"))
    shared = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(shared)


def drop_copies(docs: DataFrame, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The documents without later copies, all columns kept; only possible copies shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, text_sha256(F.col("text")).alias("sha"))
    tested = maybe_repeated(rows, materialize(rows.select("sha"), "hashes"), max_filter_bits)
    alone = tested.where(~F.col("maybe")).select("row")
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"))
    first = tested.where("maybe").groupBy("sha").agg(F.min_by("row", order).alias("row")).select("row")
    return alone.unionByName(first).select("row.*")
