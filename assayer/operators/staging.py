"""Staging: the source row with its hash and the stage time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_hash


def moment(at: datetime | str | Column | None) -> Column:
    """A timestamp literal, or the current time when none is given."""
    if at is None:
        return F.current_timestamp()
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def stage_events(df: DataFrame, staged_at: datetime | str | Column | None = None) -> DataFrame:
    """``row_hash``, ``staged_at``, then every source column.

    The hash covers all columns in the frame's order; read bronze with the catalogue schema so that the
    order does not depend on the files.
    """
    return df.select(row_hash(df.columns).alias("row_hash"), moment(staged_at).alias("staged_at"), "*")
