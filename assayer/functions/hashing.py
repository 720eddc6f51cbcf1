"""Row hashes, JSON snapshots of rows and surrogate keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# NULL fields stay in the text, and timestamps keep their microseconds (Spark's default format cuts at millis).
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

# Fixed value: text that stands for NULL inside a surrogate key.
NULL_KEY = "_dbt_utils_surrogate_key_null_"


def row_json(columns: Iterable[str]) -> Column:
    """JSON object of the named columns, in the given order."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), JSON_OPTIONS)


def row_json_after(first: Iterable[str], rest: Column) -> Column:
    """JSON object of the first columns and the fields of ``rest``, the JSON of an object that has some: as ``row_json`` of both, but ``rest`` is not rendered again."""
    inner = [F.substr(one, F.lit(2), F.length(one) - 2) for one in (row_json([c]) for c in first)]
    return F.concat(F.lit("{"), F.concat_ws(",", *inner, F.substr(rest, F.lit(2))))


def row_hash(columns: Iterable[str]) -> Column:
    """md5 hex of the JSON of the whole row."""
    return F.md5(row_json(columns))


def surrogate_key(*columns: str) -> Column:
    """md5 hex over several key columns; NULL differs from the empty string."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_KEY)) for c in columns]
    return F.md5(F.concat_ws("-", *parts))
