"""Data-quality checks: each gives its failing rows, or one metric row per column or check."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sales import STAGE_ORDER
from .gold import tagged_union
from .silver import with_payload

# RE2's \s is this set and its $ is the end of the text; Java's differ.
EMAIL_FORM = r"\A[^@\t\n\f\r ]+@[^@\t\n\f\r ]+\.[^@\t\n\f\r ]+\z"
MIN_HISTORY = 3


def dq_not_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NULLs per column, all columns in one pass."""
    return _per_column(df, {c: F.count_if(F.col(f"`{c}`").isNull()) for c in columns}, "failures")


def _per_column(df: DataFrame, metrics: Mapping[str, Column], name: str) -> DataFrame:
    one = df.agg(*[m.alias(c) for c, m in metrics.items()])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias(name)) for c in metrics]
    return one.select(F.inline(F.array(*pairs)))


def dq_unique(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; NULL keys are not looked at."""
    counted = df.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`")).agg(F.count("*").alias("n_records"))
    return counted.filter(F.col("n_records") > 1)


def dq_accepted_values(df: DataFrame, column: str = "stage", values: Iterable[str] = STAGE_ORDER) -> DataFrame:
    """Values outside the list with their frequency."""
    return (
        df.filter(~F.col(f"`{column}`").isin(*values)).groupBy(F.col(f"`{column}`")).agg(F.count("*").alias("n_records"))
    )


def dq_expression_true(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which the SQL expression is false. NULL passes; the not-null check covers it."""
    return df.filter(~F.expr(expression))


def staged_too_early() -> Column:
    return F.col("staged_at") < F.col("ingested_at")


def travel_dates_wrong() -> Column:
    return F.col("travel_end_date") < F.col("travel_start_date")


def email_malformed() -> Column:
    return ~F.col("email").rlike(EMAIL_FORM)


def won_above_total() -> Column:
    return F.col("won_opportunities") > F.col("total_opportunities")


def closed_above_total() -> Column:
    return F.col("won_opportunities") + F.col("lost_opportunities") > F.col("total_opportunities")


OBJECT_START = r"\A[ \t\r\n]*\{"
# Most payloads: up to 64 plain fields, without escapes, nesting or blanks but one after a comma or colon. All such texts are JSON.
_NAME = r'"[^"\\\x00-\x1f]*+"'
_PLAIN = _NAME + r"|-?(?:0|[1-9][0-9]{0,99}+)(?:\.[0-9]{1,99}+)?+(?:[eE][+-]?[0-9]{1,3}+)?+|true|false|null"
_FIELD = f"{_NAME}: ?+(?:{_PLAIN})"
FLAT_OBJECT = rf"\A\{{{_FIELD}(?:, ?+{_FIELD}){{0,63}}+\}}\z"
FLAT_BYTES = 32_000  # far below the parser's limits on names and values
STRICT_JSON = {"allowSingleQuotes": "false", "allowUnquotedControlChars": "false", "allowNonNumericNumbers": "false"}


def _parsed_whole(payload: Column, element: str, end: Column, ended: Callable[[Column], Column], holds: Callable[[Column], Column]) -> Column:
    """Whether the payload is one JSON value, and ``holds`` is true of it; one strict pass over the text.

    The parser stops after the first complete value and would overlook what follows. So the payload is read as the first element of
    an array that ends with a marker made of the payload's own hash, which no payload can hold: the array has two elements, the second
    of them the marker, only if all of the payload is one value.
    """
    framed = F.concat(F.lit("["), payload, F.lit(","), end, F.lit("]"))
    items = F.from_json(framed, f"array<{element}>", STRICT_JSON)
    # Tested inside a function of the array, so that the text is not parsed once for each part of the test.
    good = F.exists(F.array(items), lambda x: (F.size(x) == 2) & ended(F.get(x, F.lit(1))) & holds(F.get(x, F.lit(0))))
    return F.coalesce(good, F.lit(False))


def not_json(payload: Column) -> Column:
    """Whether a payload is missing or not one JSON value. A pattern clears the plain ones, all others are parsed."""
    flat = (F.octet_length(payload) <= FLAT_BYTES) & payload.rlike(FLAT_OBJECT)
    mark = F.xxhash64(payload).cast("string")
    end = F.concat(F.lit('{"~end":"'), mark, F.lit('"}'))
    always = lambda _: F.lit(True)
    # An object's fields are only walked over; other values, which are rare, are read as text.
    as_object = _parsed_whole(payload, "struct<`~end`: string>", end, lambda x: x["~end"] == mark, always)
    as_text = _parsed_whole(payload, "string", F.concat(F.lit('"'), mark, F.lit('"')), lambda x: x == mark, always)
    return F.when(flat, F.lit(False)).otherwise(~F.when(payload.rlike(OBJECT_START), as_object).otherwise(as_text))


def metadata_missing(payload: Column) -> Column:
    """Whether the payload is no JSON object, or one without its ingestion or stage time."""
    mark = F.xxhash64(payload).cast("string")
    both = F.concat(F.lit('{"~end":"'), mark, F.lit('"}'))
    element = "struct<ingested_at: string, staged_at: string, `~end`: string>"
    times = lambda x: x["ingested_at"].isNotNull() & x["staged_at"].isNotNull()
    return ~_parsed_whole(payload, element, both, lambda x: x["~end"] == mark, times)


def dq_timestamp_order(events: DataFrame) -> DataFrame:
    """Rows staged before they were ingested."""
    return events.filter(staged_too_early())


def dq_travel_dates(bookings: DataFrame) -> DataFrame:
    return bookings.filter(travel_dates_wrong())


def dq_won_lte_total(by_agent: DataFrame, by_product: DataFrame) -> DataFrame:
    """Entities of either conversion mart with more won deals than deals."""
    columns = ("won_opportunities", "total_opportunities")
    both = by_agent.select(F.col("agent").alias("entity"), *columns).unionByName(
        by_product.select(F.col("product").alias("entity"), *columns)
    )
    return both.filter(won_above_total())


def dq_email_format(customers: DataFrame) -> DataFrame:
    return customers.filter(email_malformed())


def _failing(df: DataFrame, rule: Column) -> DataFrame:
    """The rows a rule holds for, which is asked once for each row.

    A filter would be pushed below the projection that renders the payload, and render it anew for every mention in the rule.
    """
    return df.select(F.inline(F.when(rule, F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns])))))


def dq_payload_json(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Payloads that are missing or not JSON, over all given opaque tables."""
    return _failing(tagged_union(tables, "model_name", "event_payload"), not_json(F.col("event_payload")))


def staged_not_json(staged: DataFrame) -> DataFrame:
    """Staged rows whose payload is not JSON.

    Copies of a row have one payload but for the stage time, which does not bear on the rule. So rows can be judged before copies are
    dropped, and only those that fail need be grouped.
    """
    payloads = with_payload(staged, *[c for c in staged.columns if c != "row_hash"])
    return _failing(payloads, not_json(F.col("event_payload"))).select(*[F.col(f"`{c}`") for c in staged.columns])


def dq_payload_metadata(events: DataFrame) -> DataFrame:
    """Rows whose payload is no JSON or lacks its ingestion or stage time."""
    return _failing(events, metadata_missing(F.col("event_payload")))


def dq_rate_bounds(mart: DataFrame) -> DataFrame:
    """Groups of a conversion mart whose won and lost deals exceed their deals."""
    return mart.filter(closed_above_total())


def dq_conversion_invariants(mart: DataFrame, key: str) -> DataFrame:
    """Violations of each rule of a conversion mart, as one row."""
    total, rate = F.col("total_opportunities"), F.col("win_rate_pct")
    per_key = mart.groupBy(key).agg(
        F.count("*").alias("copies"),
        F.count_if(~(total > 0)).alias("total_not_positive"),
        F.count_if(rate.isNull()).alias("rate_null"),
        F.count_if(~rate.between(0, 100)).alias("rate_out_of_bounds"),
        F.count_if(F.col("won_opportunities") > total).alias("won_above_total"),
        F.count_if(F.col("lost_opportunities") > total).alias("lost_above_total"),
    )
    rules = ("total_not_positive", "rate_null", "rate_out_of_bounds", "won_above_total", "lost_above_total")
    return per_key.agg(
        F.count_if(F.col(key).isNull()).alias("key_null"),
        F.count_if(F.col(key).isNotNull() & (F.col("copies") > 1)).alias("key_not_unique"),
        *[F.coalesce(F.sum(r), F.lit(0).cast("long")).alias(r) for r in rules],
    )


def column_metrics(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Null and zero counts of each column, all in one pass: (column_name, metric, value)."""
    names = list(columns)
    metrics = {}
    for c in names:
        metrics[f"{c}/null_count"] = F.count_if(F.col(f"`{c}`").isNull())
        metrics[f"{c}/zero_count"] = F.count_if(F.col(f"`{c}`") == 0)
    wide = _per_column(df, metrics, "value")
    return wide.select(
        F.substring_index("column_name", "/", 1).alias("column_name"),
        F.substring_index("column_name", "/", -1).alias("metric"),
        F.col("value").cast("double").alias("value"),
    )


def score_history(history: DataFrame, series: list[str], sensitivity: float = 3) -> DataFrame:
    """Each run's value against all earlier runs of its series.

    ``history`` holds one small row per run and metric: ``series`` columns, ``run_at``, ``value``. With fewer
    than three earlier runs there is no score; a constant history scores 0.
    """
    earlier = W.partitionBy(*series).orderBy("run_at").rowsBetween(W.unboundedPreceding, -1)
    scored = history.withColumns(
        {
            "earlier_runs": F.count("value").over(earlier),
            "mean": F.avg("value").over(earlier),
            "stddev": F.stddev_samp("value").over(earlier),
        }
    )
    return _judged(scored, sensitivity)


def _judged(scored: DataFrame, sensitivity: float) -> DataFrame:
    score = F.when(F.col("stddev") == 0, F.lit(0.0)).otherwise((F.col("value") - F.col("mean")) / F.col("stddev"))
    scored = scored.withColumn("score", F.when(F.col("earlier_runs") >= MIN_HISTORY, score))
    status = (
        F.when(F.col("score").isNull(), "not enough history")
        .when(F.abs("score") > sensitivity, "anomaly")
        .otherwise("ok")
    )
    return scored.withColumn("status", status)


def moments(history: DataFrame, series: list[str]) -> DataFrame:
    """Number, mean and sum of squared deviations of each series: all that scoring needs of its past, in one row."""
    n = F.count("value")
    return history.groupBy(*series).agg(
        n.alias("n"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("value") * n, F.lit(0.0)).alias("squares")
    )


def merge_moments(one: DataFrame, other: DataFrame, series: list[str]) -> DataFrame:
    """The moments of both histories together, without the histories."""
    names = ("n", "mean", "squares")
    a = one.select(*series, *[F.col(c).alias(f"a_{c}") for c in names])
    b = other.select(*series, *[F.col(c).alias(f"b_{c}") for c in names])
    both = a.join(b, series, "full").fillna(0, [f"{side}_{c}" for side in "ab" for c in names])
    n = F.col("a_n") + F.col("b_n")
    apart = F.col("b_mean") - F.col("a_mean")
    share = F.when(n > 0, F.col("b_n") / n).otherwise(F.lit(0.0))
    return both.select(
        *series,
        n.alias("n"),
        F.when(F.col("a_n") == 0, F.col("b_mean")).otherwise(F.col("a_mean") + apart * share).alias("mean"),
        (F.col("a_squares") + F.col("b_squares") + apart * apart * F.col("a_n") * share).alias("squares"),
    )


def score_against(runs: DataFrame, past: DataFrame, series: list[str], sensitivity: float = 3) -> DataFrame:
    """The values of a run against the moments of the runs before, one stored row for each series; as ``score_history``."""
    known = past.select(
        *series,
        F.col("n").alias("earlier_runs"),
        F.when(F.col("n") > 0, F.col("mean")).alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).alias("stddev"),
    )
    scored = runs.join(known, series, "left").withColumn("earlier_runs", F.coalesce("earlier_runs", F.lit(0).cast("long")))
    return _judged(scored.select(*runs.columns, "earlier_runs", "mean", "stddev"), sensitivity)


def dq_volume_anomaly(history: DataFrame, sensitivity: float = 3) -> DataFrame:
    """Row counts of tables over runs: ``table_name, run_at, value``."""
    return score_history(history, ["table_name"], sensitivity)


def dq_column_anomaly(history: DataFrame, sensitivity: float = 3) -> DataFrame:
    """Column metrics over runs: ``table_name, column_name, metric, run_at, value``."""
    return score_history(history, ["table_name", "column_name", "metric"], sensitivity)


def schema_snapshot(df: DataFrame) -> DataFrame:
    """(column_name, data_type) of a frame."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string")


def payload_schema(events: DataFrame, payload: str = "event_payload") -> DataFrame:
    """(column_name, data_type) seen in JSON payloads; a key with several types lists them all."""
    variant = F.try_parse_json(F.col(payload).outer())
    entries = events.select(payload).lateralJoin(events.sparkSession.tvf.variant_explode(variant))
    seen = F.schema_of_variant("value")
    kind = (
        F.when(seen.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(seen == "BOOLEAN", "boolean")
        .when(seen == "STRING", "string")
        .otherwise("nested")
    )
    typed = entries.filter(seen != "VOID").select(F.col("key").alias("column_name"), kind.alias("data_type"))
    # Map-side counts first: what is collected per key is at most the four kinds.
    kinds = typed.groupBy("column_name", "data_type").agg(F.count("*").alias("n_records"))
    return kinds.groupBy("column_name").agg(
        F.array_join(F.array_sort(F.collect_set("data_type")), "|").alias("data_type")
    )


def dq_schema_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added, removed or changed in type between two snapshots."""
    old = before.select("column_name", F.col("data_type").alias("old_type"))
    new = after.select("column_name", F.col("data_type").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
    )
    return old.join(new, "column_name", "full").withColumn("change", change).filter(F.col("change").isNotNull())


def failure_count(failing: DataFrame, check: str, table: str, severity: str = "error") -> DataFrame:
    """One report row from the failing rows of a check."""
    if severity not in ("warn", "error"):
        raise ValueError(f"severity must be 'warn' or 'error', not {severity!r}")
    return failing.agg(F.count("*").alias("failures")).select(
        F.lit(check).alias("check_name"),
        F.lit(table).alias("table_name"),
        F.lit(severity).alias("severity"),
        "failures",
    )


def row_checks(df: DataFrame, table: str, checks: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Report rows of many row rules in one pass: name → (condition of a failing row, severity)."""
    names = list(checks)
    sums = df.agg(*[F.count_if(checks[n][0]).alias(f"c{i}") for i, n in enumerate(names)])
    lines = [
        F.struct(
            F.lit(n).alias("check_name"),
            F.lit(table).alias("table_name"),
            F.lit(checks[n][1]).alias("severity"),
            F.col(f"c{i}").alias("failures"),
        )
        for i, n in enumerate(names)
    ]
    return sums.select(F.inline(F.array(*lines)))


def dq_report(parts: Iterable[DataFrame]) -> DataFrame:
    """All checks as (check_name, table_name, severity, failures)."""
    return reduce(DataFrame.unionByName, parts)
