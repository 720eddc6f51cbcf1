"""Plain SQL that states each registered query's result a second time, for the correctness check."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ..catalogue import DOMAINS, MONITORS, OPAQUE
from ..functions import sales
from ..functions.hashing import NULL_KEY
from ..operators import volumes
from .bindings import AS_OF, BINDINGS, JSON_TAILS, MART_CONTENT, REPORTED, SPLIT_AT, STAGED_AT, TABLES
from .checks import AMOUNTS, REQUIRED

STAGED = f"TIMESTAMP '{STAGED_AT}'"
DAY = f"DATE '{AS_OF}'"


def _text(c: str) -> str:
    # Blanks of Unicode besides those of \\s: separators and the next-line sign.
    blank = "[\\s\\p{Z}\\x{85}\\x{0b}]+"
    return f"NULLIF(regexp_replace({c}, '^{blank}|{blank}$', '', 'g'), '')"


def _date(c: str) -> str:
    t = _text(c)
    return f"CASE WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN TRY_CAST({t} AS DATE) END"


def _timestamp(c: str) -> str:
    t = _text(c)
    return f"CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN TRY_CAST({t} AS TIMESTAMP) END"


def _json_value(name: str, data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        text = f"CAST(to_json({name}) AS VARCHAR)"
    elif isinstance(data_type, T.TimestampType):
        text = f"'\"' || strftime({name}, '%Y-%m-%dT%H:%M:%S.%fZ') || '\"'"
    elif isinstance(data_type, T.DateType):
        text = f"'\"' || CAST({name} AS VARCHAR) || '\"'"
    else:
        text = f"CAST({name} AS VARCHAR)"
    return f"COALESCE({text}, 'null')"


def _json_object(fields: list[tuple[str, T.DataType]]) -> str:
    parts = [f"'\"{name}\":' || {_json_value(name, t)}" for name, t in fields]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _fields(domain: str) -> list[tuple[str, T.DataType]]:
    return [(f.name, f.dataType) for f in DOMAINS[domain].schema]


def _bronze(domain: str) -> str:
    return BINDINGS[domain].format(**{t: t for t in TABLES})


def _staged(domain: str) -> str:
    return f"SELECT md5({_json_object(_fields(domain))}) AS row_hash, {STAGED} AS staged_at, * FROM brz_{domain}"


def _case(table: dict, key: str, other: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else f"{v}") for k, v in table.items())
    return f"CASE {key} {whens} ELSE {other} END"


def _payload_fields(domain: str) -> list[tuple[str, T.DataType]]:
    return [("row_hash", T.StringType()), ("staged_at", T.TimestampType()), *_fields(domain)]


CLEAN = {
    "booking": f"""SELECT row_hash AS booking_event_sk, staged_at, {_text('booking_id')} AS booking_id,
        {_text('customer_id')} AS customer_id, {_date('booking_date')} AS booking_date,
        {_date('travel_start_date')} AS travel_start_date, {_date('travel_end_date')} AS travel_end_date,
        lower({_text('booking_status')}) AS booking_status, CAST(total_amount AS DOUBLE) AS total_amount,
        upper({_text('currency')}) AS currency, {_text('destination_city')} AS destination_city,
        upper({_text('destination_country')}) AS destination_country, lower({_text('channel')}) AS channel,
        {_timestamp('created_at')} AS created_at, {_timestamp('updated_at')} AS updated_at, ingested_at
        FROM stg_booking""",
    "crm": f"""SELECT row_hash AS crm_event_sk, staged_at, {_text('opportunity_id')} AS opportunity_id,
        lower({_text('stage')}) AS stage, {_text('agent_id')} AS agent_id, {_text('product')} AS product,
        CAST(value AS DOUBLE) AS value, upper({_text('region')}) AS region,
        CAST({_timestamp('expected_close_date')} AS DATE) AS expected_close_date,
        {_timestamp('updated_at')} AS updated_at, ingested_at
        FROM stg_crm""",
    "customer": f"""SELECT row_hash AS customer_event_sk, staged_at, {_text('customer_id')} AS customer_id,
        {_text('full_name')} AS full_name, lower({_text('email')}) AS email, {_text('phone')} AS phone,
        upper({_text('country')}) AS country, {_text('city')} AS city,
        lower({_text('customer_segment')}) AS customer_segment, lower({_text('loyalty_tier')}) AS loyalty_tier,
        {_timestamp('created_at')} AS created_at, {_timestamp('updated_at')} AS updated_at, ingested_at
        FROM stg_customer""",
}

ORDERS = {
    "booking": "COALESCE(updated_at, created_at) DESC NULLS LAST, ingested_at DESC NULLS LAST, booking_event_sk DESC",
    "crm": "updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST, crm_event_sk DESC",
    "customer": "updated_at DESC NULLS LAST, created_at DESC NULLS LAST, ingested_at DESC NULLS LAST, "
    "customer_event_sk DESC",
}


def _latest(relation: str, domain: str) -> str:
    key = DOMAINS[domain].key
    order = ORDERS.get(domain, "ingested_at DESC NULLS LAST, staged_at DESC")
    return f"SELECT * FROM {relation} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


# Only the words the bindings contain need the general title case.
TITLE_STAGE = "CASE stage WHEN 'on_hold-now' THEN 'On_Hold-Now' ELSE stage END"
TITLE_PRODUCT = "upper(substr(product, 1, 1)) || lower(substr(product, 2))"
STAGE = _case(sales.STAGE_ALIASES, "lower(stage)", TITLE_STAGE)
PRODUCT = _case(sales.PRODUCT_ALIASES, "lower(product)", TITLE_PRODUCT)
AGENT = (
    "CASE WHEN regexp_matches(lower(agent_id), 'agent[_ -]?\\d+') "
    "THEN 'Agent ' || lpad(regexp_extract(lower(agent_id), '(\\d+)', 1), 2, '0') ELSE agent_id END"
)
SINCE = f"CAST(date_diff('day', CAST(updated_at AS DATE), {DAY}) AS INTEGER)"
UNTIL = f"CAST(date_diff('day', {DAY}, expected_close_date) AS INTEGER)"
STALE = f"COALESCE({SINCE} >= {sales.STALE_DAYS}, FALSE) OR COALESCE({UNTIL} <= {sales.MONTH_DAYS}, FALSE)"

OPPORTUNITIES = f"""SELECT opportunity_id, {STAGE} AS stage, region, {PRODUCT} AS product, {AGENT} AS agent, value,
    expected_close_date, updated_at, ingested_at, staged_at, {SINCE} AS days_since_update,
    {UNTIL} AS days_until_expected_close, {STALE} AS is_stale
    FROM slv_crm WHERE opportunity_id IS NOT NULL"""

RATE = "100.0 * count(*) FILTER (stage = 'Won') / NULLIF(count(*) FILTER (stage IN ('Won', 'Lost')), 0)"
PROB = _case(sales.WIN_PROBABILITY, "stage", "0.0")
BUCKET = (
    "CASE WHEN days_until_expected_close < 0 THEN 'Overdue' WHEN days_until_expected_close <= 7 THEN 'This Week' "
    "WHEN days_until_expected_close <= 30 THEN 'This Month' ELSE 'Later' END"
)
BAND = "CASE WHEN win_rate_pct >= 40 THEN 'high' WHEN win_rate_pct >= 20 THEN 'medium' ELSE 'low' END"


def _conversion(by: str) -> str:
    return f"""SELECT {by}, count(*) AS total_opportunities,
        count(*) FILTER (stage = 'Won') AS won_opportunities, count(*) FILTER (stage = 'Lost') AS lost_opportunities,
        COALESCE(round({RATE}, 2), 0) AS win_rate_pct, sum(value) AS total_pipeline_value,
        sum(CASE WHEN stage = 'Won' THEN value ELSE 0 END) AS won_value
        FROM opp GROUP BY {by}"""


def _first_batch(time: str = "ingested_at") -> str:
    return f"{time} < TIMESTAMP '{SPLIT_AT}'"


CTES: dict[str, str] = {}
for _name in DOMAINS:
    CTES[f"brz_{_name}"] = _bronze(_name)
    CTES[f"stg_{_name}"] = _staged(_name)
for _name in CLEAN:
    CTES[f"cln_{_name}"] = CLEAN[_name]
    CTES[f"slv_{_name}"] = _latest(f"cln_{_name}", _name)
for _name in OPAQUE:
    CTES[f"slv_{_name}"] = (
        f"SELECT DISTINCT row_hash AS {_name}_event_sk, staged_at, ingested_at, "
        f"{_json_object(_payload_fields(_name))} AS event_payload FROM stg_{_name}"
    )
    # The same rows without hash and payload text: a row hash stands for the distinct row.
    CTES[f"dst_{_name}"] = f"SELECT DISTINCT *, {STAGED} AS staged_at FROM brz_{_name}"
CTES["opp"] = OPPORTUNITIES
CTES["by_agent"] = _conversion("agent")
CTES["by_product"] = _conversion("product")
CTES["rep_agent"] = REPORTED["agent"].format(events="events")
CTES["rep_product"] = REPORTED["product"].format(events="events")
# Mart name → (key, relation).
MARTS = {
    "by_agent": ("agent", "by_agent"),
    "by_product": ("product", "by_product"),
    "reported_by_agent": ("agent", "rep_agent"),
    "reported_by_product": ("product", "rep_product"),
}
CTES["by_stage"] = """SELECT stage, count(*) AS total_opportunities, sum(value) AS total_value,
    avg(value) AS avg_opportunity_value, avg(days_since_update) AS avg_days_since_update,
    count(*) FILTER (is_stale) AS stale_opportunities FROM opp GROUP BY stage"""
CTES["volumes"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)
# An upsert in two batches: the newer batch wins, keyless rows of both stay.
CTES["old_crm"] = f"SELECT * FROM cln_crm WHERE {_first_batch()}"
CTES["new_crm"] = f"SELECT * FROM cln_crm WHERE NOT {_first_batch()}"
CTES["old_latest"] = _latest("old_crm", "crm")
CTES["new_latest"] = _latest("new_crm", "crm")
CTES["upserted"] = """SELECT * FROM old_latest WHERE opportunity_id IS NULL
    OR opportunity_id NOT IN (SELECT opportunity_id FROM new_latest WHERE opportunity_id IS NOT NULL)
    UNION ALL SELECT * FROM new_latest"""
CTES["daily"] = """SELECT event_type AS table_name, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS run_at,
    CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL"""
CTES["daily_columns"] = " UNION ALL ".join(
    f"""SELECT 'crm' AS table_name, 'value' AS column_name, '{metric}' AS metric,
    CAST(CAST(ingested_at AS DATE) AS TIMESTAMP) AS run_at,
    CAST(count(*) FILTER ({test}) AS DOUBLE) AS value FROM brz_crm GROUP BY CAST(ingested_at AS DATE)"""
    for metric, test in (("null_count", "value IS NULL"), ("zero_count", "value = 0"))
)


def _uses(sql: str) -> set[str]:
    return set(re.findall(r"[a-z_]+", sql)) & CTES.keys()


def with_ctes(select: str) -> str:
    """The statement with just the common tables it needs, in definition order."""
    needed: set[str] = set()
    todo = _uses(select)
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= _uses(CTES[name]) - needed - {name}
    body = ", ".join(f"{n} AS ({CTES[n]})" for n in _in_order(needed))
    return f"WITH {body} {select}" if body else select


def _in_order(names: set[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in sorted((_uses(CTES[name]) & names) - {name}):
            if other not in ordered:
                visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in sorted(names):
        visit(name)
    return ordered


CONVERSION_COLUMNS = (
    "total_opportunities, won_opportunities, lost_opportunities, win_rate_pct, "
    "round(total_pipeline_value, 2) AS total_pipeline_value, round(won_value, 2) AS won_value"
)


def _monitor(group: str) -> str:
    parts = [
        f"SELECT '{n}' AS domain, count(*) AS total_events, min(ingested_at) AS first_ingested_at, "
        f"max(ingested_at) AS last_ingested_at, max(staged_at) AS last_staged_at FROM dst_{n}"
        for n in MONITORS[group]
    ]
    return " UNION ALL ".join(parts)


def _score(relation: str, series: str) -> str:
    over = f"OVER (PARTITION BY {series} ORDER BY run_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""SELECT {series}, run_at, value, earlier_runs, round(mean, 6) AS mean, round(stddev, 6) AS stddev,
        round(score, 6) AS score, CASE WHEN score IS NULL THEN 'not enough history'
            WHEN abs(score) > 3 THEN 'anomaly' ELSE 'ok' END AS status
        FROM (SELECT *, CASE WHEN earlier_runs < 3 THEN NULL WHEN stddev = 0 THEN 0
                ELSE (value - mean) / stddev END AS score
            FROM (SELECT *, count(value) {over} AS earlier_runs, avg(value) {over} AS mean,
                stddev_samp(value) {over} AS stddev FROM {relation}))"""


def _chart(relation: str, group: str, metric: str, label: str, limit: int, where: str = "TRUE", way: str = "DESC") -> str:
    return (
        f"SELECT {group}, {metric} AS {label} FROM {relation} WHERE {where} GROUP BY {group} "
        f"ORDER BY {label} {way} NULLS {'LAST' if way == 'DESC' else 'FIRST'}, {group} NULLS LAST LIMIT {limit}"
    )


OPP_COLUMNS = (
    "opportunity_id, stage, region, product, agent, value, days_since_update, days_until_expected_close, is_stale"
)
CRM_COLUMNS = ", ".join(f.name for f in DOMAINS["crm"].schema if f.name != "ingested_at")
NULL_COUNTS = ("opportunity_id", "stage", "value", "agent", "region")


def _count(check: str, table: str, relation: str, failing: str, severity: str = "error") -> str:
    return (
        f"SELECT '{check}' AS check_name, '{table}' AS table_name, '{severity}' AS severity, "
        f"count(*) FILTER ({failing}) AS failures FROM {relation}"
    )


def _unique(table: str, relation: str, key: str, label: str = "") -> str:
    grouped = f"(SELECT count({key}) AS n FROM {relation} GROUP BY {key})"
    return _count(f"unique:{label or key}", table, grouped, "n > 1")


def _typed_checks(name: str) -> list[str]:
    d, table, relation = DOMAINS[name], f"silver.{name}", f"slv_{name}"
    filled = (d.sk, d.key, *REQUIRED[name], "ingested_at", "staged_at")
    rows = [_count(f"not_null:{c}", table, relation, f"{c} IS NULL") for c in filled]
    rows += [_unique(table, relation, k) for k in (d.sk, d.key)]
    if name in AMOUNTS:
        rows.append(_count(f"expression:{AMOUNTS[name]} >= 0", table, relation, f"{AMOUNTS[name]} < 0"))
    if name == "booking":
        rows.append(_count("travel_dates", table, relation, "travel_end_date < travel_start_date", "warn"))
    if name == "customer":
        form = "^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"
        rows.append(_count("email_format", table, relation, f"NOT regexp_matches(email, '{form}')", "warn"))
    return rows


def _opportunity_checks(known: str) -> list[str]:
    table = "gold.dashboard_opportunities"
    bad = f"(SELECT DISTINCT stage FROM opp WHERE stage NOT IN ({known}))"
    return [
        *[_count(f"not_null:{c}", table, "opp", f"{c} IS NULL") for c in ("opportunity_id", "stage", "value")],
        _count("expression:value >= 0", table, "opp", "value < 0"),
        _count("accepted_values:stage", table, bad, "TRUE"),
        _unique(table, "opp", "opportunity_id"),
    ]


def _conversion_checks(by: str) -> list[str]:
    table, relation = f"gold.conversion_by_{by}", f"by_{by}"
    filled = (by, "total_opportunities", "won_opportunities", "win_rate_pct")
    rules = {
        "expression:total_opportunities > 0": ("total_opportunities <= 0", "error"),
        "expression:won_opportunities >= 0": ("won_opportunities < 0", "error"),
        "expression:win_rate_pct >= 0": ("win_rate_pct < 0", "error"),
        "expression:win_rate_pct <= 100": ("win_rate_pct > 100", "error"),
        "won_lte_total": ("won_opportunities > total_opportunities", "warn"),
        "rate_bounds": ("won_opportunities + lost_opportunities > total_opportunities", "warn"),
    }
    return [
        *[_count(f"not_null:{c}", table, relation, f"{c} IS NULL") for c in filled],
        *[_count(n, table, relation, failing, severity) for n, (failing, severity) in rules.items()],
        _unique(table, relation, by),
    ]


def _opaque_checks(name: str) -> list[str]:
    sk, table, relation = DOMAINS[name].sk, f"silver.{name}", f"slv_{name}"
    missing = " OR ".join(f"json_extract_string(event_payload, '$.{t}') IS NULL" for t in ("ingested_at", "staged_at"))
    return [
        _count("not_null:event_sk", table, relation, f"{sk} IS NULL"),
        *[_count(f"not_null:{c}", table, relation, f"{c} IS NULL") for c in ("staged_at", "ingested_at", "event_payload")],
        _count("timestamp_order", table, relation, "staged_at < ingested_at", "warn"),
        _count("payload_json", table, relation, "NOT json_valid(event_payload)", "warn"),
        _count("payload_metadata", table, relation, missing if name == "support" else "FALSE", "warn"),
        _unique(table, relation, sk, "event_sk"),
    ]


def _build() -> dict[str, str]:
    q: dict[str, str] = {}

    # Sources and sinks
    message = f"SELECT {CRM_COLUMNS} FROM brz_crm"
    q["parse_json_events"] = (
        message + " UNION ALL SELECT " + ", ".join(
            f"json_extract_string(text, '$.{f.name}')" if isinstance(f.dataType, T.StringType)
            else f"CAST(json_extract_string(text, '$.{f.name}') AS DOUBLE)"
            for f in DOMAINS["crm"].schema if f.name != "ingested_at"
        ) + " FROM documents WHERE CASE WHEN json_valid(text) THEN json_type(text) = 'OBJECT' ELSE FALSE END"
    )
    crm = [f for f in _fields("crm") if f[0] != "ingested_at"]
    worded = [(n, T.StringType()) if n == "value" else (n, t) for n, t in crm]
    q["rejected_messages"] = (
        "SELECT text AS value, 'not a JSON object' AS reject_reason FROM documents "
        "WHERE CASE WHEN json_valid(text) THEN json_type(text) <> 'OBJECT' ELSE TRUE END"
        f" UNION ALL SELECT {_json_object([f for f in crm if f[0] != 'stage'])}, 'missing: stage' FROM brz_crm"
        f" UNION ALL SELECT {_json_object(worded)}, 'bad value: value' FROM "
        "(SELECT * REPLACE ('about ' || CAST(value AS VARCHAR) AS value) FROM brz_crm WHERE value IS NOT NULL)"
    )
    present = " AND ".join(f"{c} IS NOT NULL" for c in CRM_COLUMNS.split(", "))
    q["require_fields"] = f"SELECT {CRM_COLUMNS} FROM brz_crm WHERE {present}"
    q["stamp_ingested_at"] = (
        f"SELECT opportunity_id, updated_at, value, TIMESTAMP '2024-01-31 12:00:00.123456' AS ingested_at, "
        f"TIMESTAMP '2024-01-31 12:00:00' AS ingested_second FROM brz_crm"
    )
    q["append_bronze"] = "SELECT * FROM brz_booking"
    q["fanout_bronze"] = " UNION ALL ".join(
        [f"SELECT '{n}' AS domain, {_json_object([f for f in _fields(n) if f[0] != 'ingested_at'])} AS row, "
         f"CAST(NULL AS VARCHAR) AS reject_reason FROM brz_{n}" for n in DOMAINS]
        + ["SELECT 'review', text, 'not a JSON object' FROM documents",
           "SELECT 'telemetry', props, 'unknown topic' FROM events"]
    )
    q["add_column_if_missing"] = "SELECT *, CAST(NULL AS TIMESTAMP) AS ingested_at FROM supplier"
    q["scan_source"] = "SELECT event_id, ts, user_id, event_type, value, props FROM events"
    listed = "CASE WHEN stage IN ({}) THEN stage END AS stage".format(", ".join(f"'{s}'" for s in sales.STAGE_ORDER))
    q["load_opportunities"] = f"SELECT {OPP_COLUMNS} FROM (SELECT * REPLACE ({listed}) FROM opp)"
    ranks = _case({s: i for i, s in enumerate(sales.STAGE_ORDER)}, "stage", "NULL")
    q["sort_by_stage_order"] = f"SELECT opportunity_id, {listed}, CAST({ranks} AS INTEGER) AS stage_rank FROM opp"
    record = [("opportunity_id", T.StringType()), ("stage", T.StringType()), ("region", T.StringType()),
              ("product", T.StringType()), ("agent", T.StringType()), ("value", T.DoubleType()),
              ("days_since_update", T.IntegerType()), ("days_until_expected_close", T.IntegerType()),
              ("is_stale", T.BooleanType()), ("updated_at", T.TimestampType()), ("ingested_at", T.TimestampType())]
    q["export_json_records"] = f"SELECT {_json_object(record)} AS record FROM opp"
    q["adhoc_sql"] = (
        "SELECT region, count(*) AS overdue, round(sum(value), 2) AS overdue_value FROM opp "
        "WHERE days_until_expected_close < 0 GROUP BY region"
    )
    q["adhoc_sql_marts"] = """SELECT 'bookings' AS subject, count(*) AS records FROM slv_booking
        UNION ALL SELECT 'customers', count(*) FROM slv_customer
        UNION ALL SELECT 'partner', count(*) FROM dst_partner UNION ALL SELECT 'agency', count(*) FROM dst_agency"""

    # Projections
    q["stage_events"] = " UNION ALL ".join(
        f"SELECT '{n}' AS domain, row_hash, staged_at, ingested_at, {_json_object(_fields(n))} AS source FROM stg_{n}" for n in DOMAINS
    )
    q["clean_bookings"] = "SELECT * FROM cln_booking"
    q["clean_opportunities"] = "SELECT * FROM cln_crm"
    q["clean_customers"] = "SELECT * FROM cln_customer"
    q["event_payload"] = " UNION ALL ".join(
        f"SELECT '{n}' AS domain, row_hash AS event_sk, staged_at, ingested_at, {_json_object(_payload_fields(n))} AS event_payload FROM stg_{n}"
        for n in OPAQUE
    )
    q["normalize_stage"] = f"SELECT crm_event_sk, stage AS source, {STAGE} AS stage FROM cln_crm"
    q["normalize_product"] = f"SELECT crm_event_sk, product AS source, {PRODUCT} AS product FROM cln_crm"
    q["normalize_agent"] = f"SELECT crm_event_sk, agent_id AS source, {AGENT} AS agent FROM cln_crm"
    q["opportunity_ages"] = (
        f"SELECT crm_event_sk, {SINCE} AS days_since_update, {UNTIL} AS days_until_expected_close FROM cln_crm"
    )
    q["opportunity_is_stale"] = (
        f"SELECT crm_event_sk, {STALE} AS is_stale, CASE WHEN {STAGE} IN ('Won', 'Lost') THEN FALSE "
        f"ELSE {STALE} END AS is_stale_open FROM cln_crm"
    )
    q["dashboard_opportunities"] = "SELECT * FROM opp"
    q["stale_opportunities"] = (
        "SELECT opportunity_id, stage, agent, product, region, value, expected_close_date, updated_at, "
        "days_since_update, days_until_expected_close, is_stale FROM opp WHERE is_stale"
    )
    q["win_probability"] = f"SELECT opportunity_id, stage, CAST({PROB} AS DOUBLE) AS win_prob FROM opp"
    q["weighted_value"] = (
        f"SELECT opportunity_id, stage, value, round(value * CAST({PROB} AS DOUBLE), 6) AS weighted_value FROM opp"
    )
    q["close_bucket"] = f"SELECT opportunity_id, days_until_expected_close, {BUCKET} AS close_bucket FROM opp"
    q["overdue_deals"] = f"SELECT {OPP_COLUMNS} FROM opp WHERE days_until_expected_close < 0"
    q["overdue_count"] = "SELECT count(*) AS overdue FROM opp WHERE days_until_expected_close < 0"
    q["closing_this_week"] = f"SELECT {OPP_COLUMNS} FROM opp WHERE days_until_expected_close BETWEEN 0 AND 7"
    q["closing_this_month"] = f"SELECT {OPP_COLUMNS} FROM opp WHERE days_until_expected_close BETWEEN 0 AND 30"
    q["idle_deals"] = f"SELECT {OPP_COLUMNS} FROM opp WHERE days_since_update > 14"
    q["win_rate_band"] = (
        f"SELECT agent, win_rate_pct, {BAND} AS band, win_rate_pct < 20 AS low_win_rate FROM by_agent"
    )
    q["surrogate_key"] = (
        "SELECT opportunity_id, agent_id, md5(concat_ws('-', "
        + ", ".join(f"COALESCE({c}, '{NULL_KEY}')" for c in ("opportunity_id", "agent_id", "updated_at"))
        + ")) AS event_key FROM brz_crm"
    )

    # Joins
    q["conversion_left_join"] = f"""SELECT agent, count(value) AS total_opportunities,
        round(COALESCE(sum(value), 0), 2) AS total_pipeline_value,
        count(*) FILTER (stage = 'Won') AS won_opportunities, count(*) FILTER (stage = 'Lost') AS lost_opportunities,
        round(COALESCE(sum(value) FILTER (stage = 'Won'), 0), 2) AS won_value,
        COALESCE(round_even({RATE}, 2), 0) AS win_rate_pct FROM opp WHERE agent IS NOT NULL GROUP BY agent"""
    funnel = ", ".join(f"({i}, '{s}')" for i, s in enumerate(sales.FUNNEL_STAGES[::-1]))
    q["funnel_dense"] = f"""SELECT CAST(position AS INTEGER) AS position, f.stage, total_opportunities
        FROM (VALUES {funnel}) f(position, stage)
        LEFT JOIN (SELECT stage, count(value) AS total_opportunities FROM opp GROUP BY stage) s ON f.stage = s.stage"""
    buckets = ", ".join(f"({i}, '{s}')" for i, s in enumerate(sales.CLOSE_BUCKETS))
    open_stages = ", ".join(f"'{s}'" for s in sales.OPEN_STAGES)
    q["closing_timeline"] = f"""SELECT CAST(position AS INTEGER) AS position, b.close_bucket, COALESCE(deals, 0) AS deals
        FROM (VALUES {buckets}) b(position, close_bucket)
        LEFT JOIN (SELECT {BUCKET} AS close_bucket, count(value) AS deals FROM opp
            WHERE stage IN ({open_stages}) GROUP BY 1) c ON b.close_bucket = c.close_bucket"""

    # Aggregations
    q["booking_overview"] = """SELECT booking_status, channel, currency, count(*) AS total_bookings,
        round(sum(total_amount), 2) AS total_booking_amount, round(avg(total_amount), 6) AS avg_booking_amount,
        count(DISTINCT customer_id) AS distinct_customers, max(updated_at) AS latest_booking_updated_at
        FROM slv_booking GROUP BY ALL"""
    q["customer_overview"] = """SELECT customer_segment, loyalty_tier, country, count(*) AS total_customers,
        count(email) AS customers_with_email, count(phone) AS customers_with_phone,
        max(updated_at) AS latest_customer_updated_at FROM slv_customer GROUP BY ALL"""
    q["opportunities_by_stage"] = """SELECT stage, total_opportunities, round(total_value, 2) AS total_value,
        round(avg_opportunity_value, 6) AS avg_opportunity_value,
        round(avg_days_since_update, 6) AS avg_days_since_update, stale_opportunities FROM by_stage"""
    for by in ("agent", "product"):
        q[f"conversion_by_{by}"] = f"SELECT {by}, {CONVERSION_COLUMNS} FROM by_{by}"
    for group in MONITORS:
        q[f"{group}_event_monitor"] = _monitor(group)
    known = ", ".join(f"'{s}'" for s in sales.STAGE_ORDER)
    q["stage_summary"] = f"""SELECT stage, count(value) AS total_opportunities,
        round(COALESCE(sum(value), 0), 2) AS total_value,
        round(COALESCE(sum(value * CAST({PROB} AS DOUBLE)), 0), 4) AS weighted_value,
        count(*) FILTER (is_stale) AS stale_opportunities, round(avg(days_since_update), 6) AS avg_days_since_update
        FROM opp WHERE stage IN ({known}) GROUP BY stage"""
    q["opportunity_kpis"] = f"""SELECT count(*) AS total_opportunities, round(sum(value), 2) AS total_value,
        round(sum(value * CAST({PROB} AS DOUBLE)), 4) AS weighted_forecast, count(*) FILTER (stage = 'Won') AS won_deals,
        count(*) FILTER (stage = 'Lost') AS lost_deals, round(COALESCE({RATE}, 0), 6) AS win_rate_pct,
        count(*) FILTER (is_stale) AS stale_opportunities FROM opp"""
    q["weighted_by_stage"] = (
        f"SELECT stage, round(sum(value * CAST({PROB} AS DOUBLE)), 4) AS weighted_value FROM opp GROUP BY stage"
    )
    q["best_agent"] = (
        f"SELECT agent, {CONVERSION_COLUMNS} FROM by_agent ORDER BY by_agent.win_rate_pct DESC, agent NULLS LAST LIMIT 1"
    )
    q["top_agents"] = (
        f"SELECT agent, {CONVERSION_COLUMNS} FROM by_agent ORDER BY by_agent.win_rate_pct DESC, agent NULLS LAST LIMIT 10"
    )
    q["products_by_win_rate"] = f"SELECT product, {CONVERSION_COLUMNS} FROM by_product"
    q["table_volumes"] = "SELECT table_name, row_count FROM volumes"
    q["total_volume"] = "SELECT CAST(sum(row_count) AS BIGINT) AS total_rows FROM volumes"
    target, size, most = volumes.TARGET_ROWS, volumes.BATCH_ROWS, volumes.MAX_BATCHES
    q["volume_deficit"] = f"""SELECT table_name, row_count, needed_rows,
        least({most}, CAST(ceil(needed_rows / {size}) AS BIGINT)) AS batches
        FROM (SELECT *, greatest(0, {target} - row_count) AS needed_rows FROM volumes)"""
    q["deficit_totals"] = f"""SELECT CAST(sum(least(batches * {size}, needed_rows)) AS BIGINT) AS total_rows_to_load,
        max(batches) AS max_batches, CAST(max(batches) * {volumes.BATCH_SECONDS} // 60 AS BIGINT) AS minutes
        FROM ({q['volume_deficit']})"""

    # Charts
    q["chart_funnel"] = _chart("opp", "stage", "count(opportunity_id)", "opportunities", 5, "stage <> 'Lost'")
    q["chart_value_by_stage"] = _chart("by_stage", "stage", "round(sum(total_value), 2)", "pipeline_value", 10)
    q["chart_win_rate_agent"] = _chart("by_agent", "agent", "avg(by_agent.win_rate_pct)", "win_rate", 10)
    q["chart_win_rate_product"] = _chart("by_product", "product", "avg(by_product.win_rate_pct)", "win_rate", 10)
    q["chart_region"] = _chart("opp", "region", "count(opportunity_id)", "opportunities", 10)
    mix = _chart("opp", "product", "count(opportunity_id)", "opportunities", 10)
    q["chart_product_mix"] = (
        "SELECT product, opportunities, round(100.0 * opportunities / sum(opportunities) OVER (), 6) AS share_pct "
        f"FROM ({mix})"
    )
    q["chart_stale_by_stage"] = _chart(
        "(SELECT stage, stale_opportunities AS stale FROM by_stage)", "stage", "CAST(sum(stale) AS BIGINT)",
        "stale_opportunities", 10, way="ASC",
    )
    q["chart_stale_detail"] = (
        "SELECT opportunity_id, stage, agent, product, region, value, days_since_update, days_until_expected_close "
        "FROM opp WHERE is_stale ORDER BY opportunity_id LIMIT 100"
    )

    # Latest record per key
    q["latest_booking"] = "SELECT * FROM slv_booking"
    q["latest_opportunity"] = "SELECT * FROM slv_crm"
    q["latest_customer"] = "SELECT * FROM slv_customer"
    q["latest_event"] = " UNION ALL ".join(
        f"SELECT '{n}' AS domain, {n}_event_sk AS event_sk, staged_at, ingested_at, event_payload FROM slv_{n}" for n in OPAQUE
    )

    # Incremental maintenance
    q["incremental_filter"] = "SELECT * FROM brz_crm WHERE ingested_at > (SELECT max(ingested_at) FROM old_crm)"
    q["upsert_latest"] = "SELECT * FROM upserted"
    q["append_new_columns"] = """SELECT event_id AS id, event_type, CAST(NULL AS VARCHAR) AS priority FROM events
        UNION ALL SELECT o_orderkey, CAST(NULL AS VARCHAR), o_orderpriority FROM orders"""
    q["full_refresh"] = q["conversion_by_agent"]
    rows = [f"SELECT 'silver.{n}' AS table_name, count(*) AS row_count FROM " + (f"dst_{n}" if n in OPAQUE else f"slv_{n}")
            for n in DOMAINS]
    gold_counts = {
        "dashboard_opportunities": "SELECT count(*) FROM opp",
        "stale_opportunities": "SELECT count(*) FROM opp WHERE is_stale",
        "opportunities_by_stage": "SELECT count(*) FROM by_stage",
        "conversion_by_agent": "SELECT count(*) FROM by_agent",
        "conversion_by_product": "SELECT count(*) FROM by_product",
        "booking_overview": "SELECT count(*) FROM (SELECT DISTINCT booking_status, channel, currency FROM slv_booking)",
        "customer_overview": "SELECT count(*) FROM (SELECT DISTINCT customer_segment, loyalty_tier, country FROM slv_customer)",
        **{f"{g}_event_monitor": f"SELECT {len(names)}" for g, names in MONITORS.items()},
    }
    rows += [f"SELECT 'gold.{n}' AS table_name, ({s}) AS row_count" for n, s in gold_counts.items()]
    lines = [f"SELECT table_name, '' AS key, 'rows' AS measure, CAST(row_count AS DOUBLE) AS value FROM ({' UNION ALL '.join(rows)})"]
    for mart, (keys, measures) in MART_CONTENT.items():
        key = "concat_ws('|', " + ", ".join(f"COALESCE({k}, '~')" for k in keys) + ")"
        for name, digits in measures.items():
            number = f"epoch_us({name})" if digits is None else f"round(CAST({name} AS DOUBLE), {digits})"
            lines.append(f"SELECT 'gold.{mart}', {key}, '{name}', CAST({number} AS DOUBLE) FROM ({q[mart]})")
    q["medallion_run"] = " UNION ALL ".join(lines)

    # Streams: the state they end in
    q["stream_ingest"] = q["parse_json_events"]
    q["stream_upsert_latest"] = "SELECT * FROM upserted"
    q["stream_late_rows"] = """SELECT count(*) FILTER (ingested_at > bound) AS accepted_rows,
        count(*) FILTER (NOT COALESCE(ingested_at > bound, FALSE)) AS late_rows
        FROM brz_crm, (SELECT max(ingested_at) AS bound FROM old_crm)"""
    q["stream_replay_dedup"] = "SELECT DISTINCT * FROM brz_crm"

    # Quality
    q["dq_not_null"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS failures FROM opp" for c in NULL_COUNTS
    )
    q["dq_unique"] = """SELECT opportunity_id, count(*) AS n_records FROM cln_crm WHERE opportunity_id IS NOT NULL
        GROUP BY 1 HAVING count(*) > 1"""
    q["dq_accepted_values"] = f"SELECT stage, count(*) AS n_records FROM opp WHERE stage NOT IN ({known}) GROUP BY stage"
    q["dq_expression_true"] = "SELECT opportunity_id, value FROM opp WHERE NOT (value >= 5)"
    q["dq_timestamp_order"] = " UNION ALL ".join(
        f"SELECT '{n}' AS domain, ingested_at, TIMESTAMP '{SPLIT_AT}' AS staged_at FROM dst_{n} "
        f"WHERE ingested_at > TIMESTAMP '{SPLIT_AT}'" for n in OPAQUE
    )
    q["dq_travel_dates"] = "SELECT * FROM slv_booking WHERE travel_end_date < travel_start_date"
    q["dq_won_lte_total"] = " UNION ALL ".join(
        f"SELECT {by} AS entity, CAST(won_opportunities AS BIGINT) AS won_opportunities, "
        f"CAST(total_opportunities AS BIGINT) AS total_opportunities FROM {mart} "
        "WHERE won_opportunities > total_opportunities" for by, mart in MARTS.values()
    )
    q["dq_email_format"] = """SELECT * FROM slv_customer WHERE email IS NOT NULL
        AND NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')"""
    q["dq_payload_json"] = " UNION ALL ".join(
        f"SELECT '{name}' AS model_name, {column} AS event_payload FROM {relation} "
        f"WHERE {column} IS NULL OR NOT json_valid({column})"
        for name, column, relation in (
            ("documents", "text", "documents"),
            ("events", "props", "events"),
            *[(n, "event_payload", f"(SELECT props || '{tail}' AS event_payload FROM events)") for n, tail in JSON_TAILS.items()],
            *[(n, "event_payload", f"slv_{n}") for n in OPAQUE],
        )
    )
    two_keys = [f for f in _fields("support") if f[0] in ("ticket_id", "ingested_at")]
    payloads = {
        "events": "SELECT props AS p FROM events",
        "bronze": f"SELECT {_json_object(two_keys)} AS p FROM brz_support",
        "support": "SELECT event_payload AS p FROM slv_support",
        **{n: f"SELECT props || '{tail}' AS p FROM events" for n, tail in JSON_TAILS.items()},
    }
    q["dq_payload_metadata"] = " UNION ALL ".join(
        f"SELECT '{name}' AS model_name, p AS event_payload FROM ({sql}) WHERE CASE WHEN NOT json_valid(p) THEN TRUE ELSE "
        "json_extract_string(p, '$.ingested_at') IS NULL OR json_extract_string(p, '$.staged_at') IS NULL END"
        for name, sql in payloads.items()
    )
    counts = [f"CAST({c}_opportunities AS BIGINT) AS {c}_opportunities" for c in ("won", "lost", "total")]
    q["dq_rate_bounds"] = " UNION ALL ".join(
        f"SELECT '{name}' AS mart, {by} AS entity, {', '.join(counts)} FROM {mart} "
        "WHERE won_opportunities + lost_opportunities > total_opportunities" for name, (by, mart) in MARTS.items()
    )
    q["dq_conversion_invariants"] = " UNION ALL ".join(
        f"""SELECT '{name}' AS mart, CAST(count(*) FILTER ({by} IS NULL) > 0 AS BIGINT) AS key_null,
        (SELECT count(*) FROM (SELECT {by} FROM {mart} WHERE {by} IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
            AS key_not_unique,
        count(*) FILTER (total_opportunities <= 0) AS total_not_positive,
        count(*) FILTER (win_rate_pct IS NULL) AS rate_null,
        count(*) FILTER (win_rate_pct < 0 OR win_rate_pct > 100) AS rate_out_of_bounds,
        count(*) FILTER (won_opportunities > total_opportunities) AS won_above_total,
        count(*) FILTER (lost_opportunities > total_opportunities) AS lost_above_total FROM {mart}"""
        for name, (by, mart) in MARTS.items()
    )
    q["dq_volume_anomaly"] = _score("daily", "table_name")
    q["dq_column_anomaly"] = _score("daily_columns", "table_name, column_name, metric")
    q["dq_schema_change"] = """SELECT column_name, old_type, new_type, change FROM (
        SELECT COALESCE(o.column_name, n.column_name) AS column_name, old_type, new_type,
            CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed'
                WHEN old_type <> new_type THEN 'type_changed' END AS change
        FROM (SELECT column_name, data_type AS old_type FROM seen_payment) o
        FULL JOIN (SELECT column_name, data_type AS new_type FROM seen_invoice) n USING (column_name))
        WHERE change IS NOT NULL"""
    q["dq_report"] = " UNION ALL ".join(
        [*_typed_checks("booking"), *_typed_checks("crm"), *_typed_checks("customer"), *_opportunity_checks(known)]
        + [row for by in ("agent", "product") for row in _conversion_checks(by)]
    )
    q["dq_opaque_report"] = " UNION ALL ".join(row for n in OPAQUE for row in _opaque_checks(n))
    q["dq_staging_report"] = " UNION ALL ".join(
        _count(f"not_null:{c}", f"staging.{n}", f"stg_{n}", f"{c} IS NULL")
        for n in DOMAINS for c in ("row_hash", "staged_at")
    )
    q["dq_full_report"] = " UNION ALL ".join(q[n] for n in ("dq_staging_report", "dq_report", "dq_opaque_report"))
    q["dq_anomaly_from_moments"] = f"SELECT * FROM ({q['dq_volume_anomaly']}) WHERE run_at >= TIMESTAMP '2024-01-30'"
    q["dq_volume_bands"] = f"""SELECT table_name, row_count, CASE WHEN row_count >= {volumes.OK_ROWS} THEN 'OK'
        WHEN row_count >= {volumes.MEDIUM_ROWS} THEN 'MED' ELSE 'LOW' END AS status FROM volumes"""
    q["volume_band_totals"] = f"""SELECT count(*) FILTER (status = 'OK') AS tables_ok,
        count(*) FILTER (status <> 'OK') AS tables_low, CAST(sum(row_count) AS BIGINT) AS total_rows
        FROM ({q['dq_volume_bands']})"""
    return q


def _seen(domain: str) -> str:
    kinds = {T.DoubleType: "number", T.LongType: "number", T.BooleanType: "boolean"}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, '{kinds.get(type(t), 'string')}' AS data_type FROM brz_{domain} "
        f"HAVING count({name}) > 0" for name, t in _fields(domain)
    )


CTES["seen_payment"] = _seen("payment")
CTES["seen_invoice"] = _seen("invoice")


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(select) for name, select in _build().items()}
