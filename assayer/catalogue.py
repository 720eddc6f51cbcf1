"""The 26 event domains: bronze schema, silver kind and key, monitor group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SPARK_TYPES = {
    "STRING": T.StringType(),
    "FLOAT": T.DoubleType(),
    "FLOAT64": T.DoubleType(),
    "INTEGER": T.LongType(),
    "INT64": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
}


def schema_from_spec(spec: str) -> T.StructType:
    """``"name:TYPE,name:TYPE"`` to a Spark schema; a name without a type is a STRING."""
    fields = []
    for item in spec.split(","):
        name, _, type_name = item.strip().partition(":")
        if not name:
            raise ValueError(f"empty column name in schema spec: {spec!r}")
        type_name = (type_name or "STRING").strip().upper()
        if type_name not in SPARK_TYPES:
            raise ValueError(f"unknown type {type_name!r} for column {name!r}")
        fields.append(T.StructField(name.strip(), SPARK_TYPES[type_name], True))
    return T.StructType(fields)


@dataclass(frozen=True)
class Domain:
    """One event type. ``key`` is the unique key of its silver table."""

    name: str
    schema: T.StructType
    key: str
    monitor: str | None = None

    @property
    def sk(self) -> str:
        return f"{self.name}_event_sk"

    @property
    def typed(self) -> bool:
        return self.key != self.sk


# Bronze columns of the three domains with a typed silver table.
TYPED = {
    "booking": (
        "booking_id",
        "booking_id, customer_id, booking_date, travel_start_date, travel_end_date, booking_status, "
        "total_amount:FLOAT, currency, destination_city, destination_country, channel, created_at, updated_at",
    ),
    "crm": (
        "opportunity_id",
        "opportunity_id, stage, agent_id, product, value:FLOAT, region, expected_close_date, updated_at",
    ),
    "customer": (
        "customer_id",
        "customer_id, full_name, email, phone, country, city, customer_segment, loyalty_tier, created_at, updated_at",
    ),
}

# Bronze columns of the older opaque domains (source dates are text).
OLDER = {
    "payment": "payment_id, booking_id, customer_id, payment_date, payment_method, payment_status, amount:FLOAT, "
    "currency, transaction_reference, updated_at",
    "search": "search_id, customer_id, search_date, origin_city, destination_city, destination_country, "
    "travel_start_date, travel_end_date, number_of_guests:INTEGER, device_type, created_at, updated_at",
    "hotel": "hotel_id, booking_id, customer_id, hotel_name, city, country, check_in_date, check_out_date, "
    "room_type, number_of_nights:INTEGER, total_room_amount:FLOAT, currency, created_at, updated_at",
    "flight": "flight_id, booking_id, customer_id, airline, flight_number, departure_city, arrival_city, "
    "departure_datetime, arrival_datetime, ticket_class, ticket_amount:FLOAT, currency, created_at, updated_at",
    "cancellation": "cancellation_id, booking_id, customer_id, cancellation_date, cancellation_reason, "
    "refund_status, refund_amount:FLOAT, currency, created_at, updated_at",
    "review": "review_id, booking_id, customer_id, review_date, rating:INTEGER, review_title, review_comment, "
    "service_category, created_at, updated_at",
    "support": "ticket_id, customer_id, booking_id, created_date, closed_date, ticket_status, priority, "
    "issue_category, assigned_agent, resolution_time_hours:FLOAT, created_at, updated_at",
    "marketing": "campaign_id, customer_id, event_date, campaign_name, channel, event_type, device_type, country, "
    "city, created_at, updated_at",
}

# What the newer opaque domains carry between event_id and event_timestamp.
NEWER = {
    "loyalty": "customer_id, loyalty_tier, points_earned:INTEGER, points_redeemed:INTEGER",
    "session": "session_id, customer_id, device_type, browser",
    "device": "customer_id, device_id, device_type, os",
    "location": "customer_id, country, city, latitude:FLOAT, longitude:FLOAT",
    "itinerary": "booking_id, customer_id, origin, destination, travel_date:DATE",
    "baggage": "booking_id, customer_id, bags_count:INTEGER, baggage_fee:FLOAT",
    "seat": "booking_id, customer_id, seat_number, seat_type",
    "insurance": "booking_id, customer_id, insurance_type, insurance_cost:FLOAT",
    "promo": "customer_id, promo_code, discount_amount:FLOAT, campaign_id",
    "notification": "customer_id, notification_type, channel, status",
    "refund": "payment_id, booking_id, customer_id, refund_amount:FLOAT, refund_reason",
    "invoice": "booking_id, customer_id, invoice_id, total_amount:FLOAT",
    "partner": "booking_id, partner_id, partner_type, commission_amount:FLOAT",
    "fraud": "customer_id, payment_id, risk_score:FLOAT, fraud_flag:BOOLEAN",
    "agency": "booking_id, agency_id, agent_id, agency_commission:FLOAT",
}

# Domains summarised by each event monitor, in report order.
MONITORS = {
    "finance": ("payment", "invoice", "refund", "promo", "insurance", "cancellation"),
    "operations": ("flight", "hotel", "baggage", "seat", "itinerary", "location"),
    "engagement": ("marketing", "notification", "review", "support", "search", "session", "device", "loyalty"),
    "partner": ("partner", "agency"),
    "risk": ("fraud",),
}


def _build() -> dict[str, Domain]:
    group = {name: monitor for monitor, names in MONITORS.items() for name in names}
    domains = {
        name: Domain(name, schema_from_spec(f"{spec}, ingested_at:TIMESTAMP"), key)
        for name, (key, spec) in TYPED.items()
    }
    opaque = {
        **OLDER,
        **{name: f"event_id, {spec}, event_timestamp:TIMESTAMP" for name, spec in NEWER.items()},
    }
    for name, spec in opaque.items():
        schema = schema_from_spec(f"{spec}, ingested_at:TIMESTAMP")
        domains[name] = Domain(name, schema, f"{name}_event_sk", group[name])
    return domains


DOMAINS: dict[str, Domain] = _build()
OPAQUE: tuple[str, ...] = tuple(name for name, d in DOMAINS.items() if not d.typed)

# Fixed value: keys every CRM message must carry (ingested_at is stamped before the check).
CRM_REQUIRED = tuple(f.name for f in DOMAINS["crm"].schema if f.name != "ingested_at")
