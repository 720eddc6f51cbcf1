"""Sales vocabulary: canonical names, probabilities, buckets and bands."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import title_case

# Stages in business order with their win probability.
STAGE_ORDER = ("Prospecting", "Qualified", "Proposal", "Negotiation", "Won", "Lost")
OPEN_STAGES = STAGE_ORDER[:4]
FUNNEL_STAGES = STAGE_ORDER[:5]
WIN_PROBABILITY = {
    "Prospecting": 0.10,
    "Qualified": 0.25,
    "Proposal": 0.45,
    "Negotiation": 0.70,
    "Won": 1.00,
    "Lost": 0.00,
}

# Source spellings of stages and products.
STAGE_ALIASES = {
    "prospección": "Prospecting",
    "prospecting": "Prospecting",
    "calificado": "Qualified",
    "qualified": "Qualified",
    "propuesta": "Proposal",
    "proposal": "Proposal",
    "negociación": "Negotiation",
    "negociacion": "Negotiation",
    "negotiation": "Negotiation",
    "ganado": "Won",
    "won": "Won",
    "perdido": "Lost",
    "lost": "Lost",
}
PRODUCT_ALIASES = {
    "vuelo": "Flight",
    "flight": "Flight",
    "hotel": "Hotel",
    "auto": "Car Rental",
    "car": "Car Rental",
    "car rental": "Car Rental",
    "paquete_2x": "Package 2x",
    "package 2x": "Package 2x",
    "paquete_3x": "Package 3x",
    "package 3x": "Package 3x",
}

# Close buckets in order, and the day and rate limits of the business rules.
CLOSE_BUCKETS = ("Overdue", "This Week", "This Month", "Later")
WEEK_DAYS = 7
MONTH_DAYS = 30
STALE_DAYS = 14
HIGH_RATE = 40
MEDIUM_RATE = 20


def lookup(table: dict, key: Column) -> Column:
    """Value for ``key`` in a literal table, else NULL; Catalyst folds it into a CASE."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def normalize_stage(c: Column) -> Column:
    return F.coalesce(lookup(STAGE_ALIASES, F.lower(c)), title_case(c))


def normalize_product(c: Column) -> Column:
    return F.coalesce(lookup(PRODUCT_ALIASES, F.lower(c)), title_case(c))


def normalize_agent(c: Column) -> Column:
    """'agent_7', 'AGENT-07' → 'Agent 07'; the number is cut to two digits. Other text stays as it is."""
    low = F.lower(c)
    number = F.lpad(F.regexp_extract(low, r"(\d+)", 1), 2, "0")
    return F.when(low.rlike(r"agent[_ -]?\d+"), F.concat(F.lit("Agent "), number)).otherwise(c)


def stage_rank(stage: Column) -> Column:
    """Position in the business order; NULL for any other stage."""
    return lookup({name: i for i, name in enumerate(STAGE_ORDER)}, stage)


def win_probability(stage: Column) -> Column:
    return F.coalesce(lookup(WIN_PROBABILITY, stage), F.lit(0.0))


def weighted_value(value: Column, stage: Column) -> Column:
    return value * win_probability(stage)


def close_bucket(days: Column) -> Column:
    overdue, week, month, later = CLOSE_BUCKETS
    return F.when(days < 0, overdue).when(days <= WEEK_DAYS, week).when(days <= MONTH_DAYS, month).otherwise(later)


def win_rate_band(rate: Column) -> Column:
    return F.when(rate >= HIGH_RATE, "high").when(rate >= MEDIUM_RATE, "medium").otherwise("low")


def low_win_rate(rate: Column) -> Column:
    return rate < MEDIUM_RATE


def days_since(moment: Column, as_of: Column) -> Column:
    return F.date_diff(as_of, F.to_date(moment))


def days_until(day: Column, as_of: Column) -> Column:
    return F.date_diff(day, as_of)


def win_rate_pct(won: Column, closed: Column) -> Column:
    """Won share of closed deals in percent, unrounded; NULL when nothing is closed."""
    return F.try_divide(won, closed) * 100
