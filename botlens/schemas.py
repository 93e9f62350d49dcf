"""Domain table schemas, enum sets and the plan / price dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, TS, B = T.StringType(), T.TimestampType(), T.BooleanType()
MONEY = T.DecimalType(12, 2)
PCT = T.DecimalType(5, 2)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


ACCOUNTS = _schema(
    ("id", S, False), ("email", S, False), ("name", S, True), ("api_key_hash", S, False),
    ("billing_provider_customer_id", S, True), ("plan", S, False),
    ("created_at", TS, False), ("updated_at", TS, False))

BOTS = _schema(
    ("id", S, False), ("owner_account_id", S, True), ("bot_identifier", S, False),
    ("bot_type", S, False), ("display_name", S, True), ("telegram_bot_id", S, True),
    ("encrypted_token", S, True), ("verification_status", S, False),
    ("tracking_status", S, False), ("webhook_status", S, False), ("connected_at", TS, False),
    ("verified_at", TS, True), ("tracking_enabled_at", TS, True),
    ("created_at", TS, False), ("updated_at", TS, False))

USERS = _schema(
    ("id", S, False), ("bot_id", S, False), ("telegram_id", S, False), ("username", S, True),
    ("first_name", S, True), ("last_name", S, True), ("created_at", TS, False),
    ("last_active_at", TS, False), ("first_seq", T.LongType(), False),
    ("last_seq", T.LongType(), False))

MESSAGES = _schema(
    ("id", S, False), ("bot_id", S, False), ("user_id", S, False), ("text", S, True),
    ("created_at", TS, False))

PAYMENTS = _schema(
    ("id", S, False), ("bot_id", S, False), ("user_id", S, False), ("amount", MONEY, False),
    ("currency", S, False), ("created_at", TS, False))

BOT_HEALTH_LOGS = _schema(
    ("id", S, False), ("bot_id", S, False), ("status", S, False), ("uptime", PCT, False),
    ("request_count", T.IntegerType(), False), ("created_at", TS, False))

SUBSCRIPTIONS = _schema(
    ("id", S, False), ("account_id", S, False), ("provider", S, False),
    ("provider_customer_id", S, True), ("provider_subscription_id", S, True),
    ("plan", S, False), ("status", S, False), ("amount_monthly", MONEY, False),
    ("currency", S, False), ("current_period_start", TS, True),
    ("current_period_end", TS, True), ("cancel_at_period_end", B, False),
    ("created_at", TS, False), ("updated_at", TS, False))

BILLING_EVENTS = _schema(
    ("id", S, False), ("account_id", S, True), ("provider", S, False),
    ("provider_event_id", S, False), ("event_type", S, False), ("payload", S, False),
    ("processed_at", TS, False), ("created_at", TS, False))

ACTIVITY_LOGS = _schema(
    ("id", S, False), ("bot_id", S, False), ("event_type", S, False),
    ("description", S, False), ("event_code", S, True), ("params", S, False),
    ("created_at", TS, False))

TABLE_SCHEMAS = {
    "accounts": ACCOUNTS, "bots": BOTS, "users": USERS, "messages": MESSAGES,
    "payments": PAYMENTS, "bot_health_logs": BOT_HEALTH_LOGS,
    "subscriptions": SUBSCRIPTIONS, "billing_events": BILLING_EVENTS,
    "activity_logs": ACTIVITY_LOGS,
}

# --- fixed values: these must equal the reference's for right results -------
# Enum sets of the DDL CHECK constraints and the request validators.
BOT_TYPES = ["token", "username"]
PLANS = ["starter", "growth"]
BILLING_PROVIDERS = ["manual", "stripe", "click"]
SUBSCRIPTION_STATUSES = ["inactive", "trialing", "active", "past_due", "canceled", "incomplete"]
VERIFICATION_STATUSES = ["pending", "verified", "failed"]
TRACKING_STATUSES = ["disabled", "enabled"]
WEBHOOK_STATUSES = ["pending", "enabled", "failed"]
HEALTH_STATUSES = ["online", "offline"]
ACTIVE_SUBSCRIPTION_STATUSES = ["active", "trialing"]
# Plan limits and price book, one row per plan:
# (plan, max_bots, monthly_events, price_monthly, currency, features)
PLAN_ROWS = [
    ("starter", 2, 5000, "29.00", "USD", ["2 bots", "5,000 monthly events", "core dashboard"]),
    ("growth", 25, 250000, "99.00", "USD", ["25 bots", "250,000 monthly events", "priority insights"]),
]
# Default uptime percentage below which a bot's API health is "degraded".
DEFAULT_UPTIME_THRESHOLD = 99
# --- end of fixed values -------------------------------------------------------

PLAN_SCHEMA = _schema(
    ("plan", S, False), ("max_bots", T.IntegerType(), False),
    ("monthly_events", T.IntegerType(), False), ("price_monthly", MONEY, False),
    ("currency", S, False), ("features", T.ArrayType(S, False), False))


def plan_catalogue(spark: SparkSession) -> DataFrame:
    """Q23: the price book with limits (two rows; always safe to broadcast)."""
    from decimal import Decimal
    rows = [(p, mb, me, Decimal(price), cur, feats) for p, mb, me, price, cur, feats in PLAN_ROWS]
    return spark.createDataFrame(rows, PLAN_SCHEMA)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLE_SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast ``df`` to the declared schema of ``table``."""
    from pyspark.sql import functions as F
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name)
                      for f in TABLE_SCHEMAS[table].fields])
