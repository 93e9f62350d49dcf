"""The reference's deterministic demo data, generated with spark.range.

The reference numbers rows with ``row_number() OVER ()`` (arbitrary order),
so only the multisets it produces are defined; here row n is assigned
deterministically.  ``scale`` multiplies the number of users (and with them
messages and payments) for volume tests; scale 1 reproduces the demo.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from botlens.functions import exprs as X
from botlens.functions.clock import Clock, ts_lit
from botlens.schemas import conform
from botlens.sources.tables import Tables

# --- fixed values: these must equal the reference's for right results -------
ACCOUNT_ID = "10000000-0000-0000-0000-000000000001"
SUBSCRIPTION_ID = "20000000-0000-0000-0000-000000000001"
BOT1 = "00000000-0000-0000-0000-000000000001"
BOT2 = "00000000-0000-0000-0000-000000000002"
DEMO_EMAIL = "demo@example.com"
DEMO_NAME = "Demo Owner"
DEMO_API_KEY = "demo-owner-api-key"
DEMO_API_SECRET = "dev-api-key-secret"
DEMO_CUSTOMER = "cust_demo_owner"
DEMO_SUBSCRIPTION = "sub_demo_growth"
BOT1_IDENTIFIER = "sample_analytics_bot"
BOT2_IDENTIFIER = "sample-token-hash"
SEED_USERS = 120
# activity rows: (event_type, description, event_code, params, minutes before now)
SEED_ACTIVITY = [
    ("user_joined", "User tg-user-119 joined", "user.joined", '{"user":"tg-user-119"}', 180),
    ("message", "Message received from tg-user-118", "message.received", '{"user":"tg-user-118"}', 120),
    ("payment", "Payment of 19.96 USD", "payment.received",
     '{"amount":19.96,"currency":"USD","user":"tg-user-118"}', 90),
    ("message", "Message received from tg-user-110", "message.received", '{"user":"tg-user-110"}', 35),
    ("message", "Message received from tg-user-101", "message.received", '{"user":"tg-user-101"}', 12),
]
# --- end of fixed values -------------------------------------------------------


def generate_seed(spark: SparkSession, as_of, scale: int = 1) -> Tables:
    c = as_of if isinstance(as_of, Clock) else Clock.at(as_of)
    now = ts_lit(c.as_of)

    def ago(unit: str, n) -> "F.Column":
        return F.timestamp_add(unit, -X.col_(n) if not isinstance(n, int) else F.lit(-n), now)

    one = spark.range(1)
    accounts = one.select(
        F.lit(ACCOUNT_ID).alias("id"), F.lit(DEMO_EMAIL).alias("email"), F.lit(DEMO_NAME).alias("name"),
        X.hmac_sha256_hex(F.lit(DEMO_API_KEY), DEMO_API_SECRET).alias("api_key_hash"),
        F.lit(DEMO_CUSTOMER).alias("billing_provider_customer_id"), F.lit("starter").alias("plan"),
        ago("DAY", 60).alias("created_at"), now.alias("updated_at"))
    subscriptions = one.select(
        F.lit(SUBSCRIPTION_ID).alias("id"), F.lit(ACCOUNT_ID).alias("account_id"),
        F.lit("manual").alias("provider"), F.lit(DEMO_CUSTOMER).alias("provider_customer_id"),
        F.lit(DEMO_SUBSCRIPTION).alias("provider_subscription_id"), F.lit("starter").alias("plan"),
        F.lit("active").alias("status"), F.lit("29.00").cast("decimal(12,2)").alias("amount_monthly"),
        F.lit("USD").alias("currency"), ago("DAY", 10).alias("current_period_start"),
        F.timestamp_add("DAY", F.lit(20), now).alias("current_period_end"),
        F.lit(False).alias("cancel_at_period_end"), ago("DAY", 10).alias("created_at"),
        now.alias("updated_at"))
    bot1 = one.select(
        F.lit(BOT1).alias("id"), F.lit(ACCOUNT_ID).alias("owner_account_id"),
        F.lit(BOT1_IDENTIFIER).alias("bot_identifier"), F.lit("username").alias("bot_type"),
        F.lit("@" + BOT1_IDENTIFIER).alias("display_name"), F.lit(None).cast("string").alias("telegram_bot_id"),
        F.lit(None).cast("string").alias("encrypted_token"), F.lit("verified").alias("verification_status"),
        F.lit("enabled").alias("tracking_status"), F.lit("enabled").alias("webhook_status"),
        ago("DAY", 60).alias("connected_at"), ago("DAY", 59).alias("verified_at"),
        ago("DAY", 58).alias("tracking_enabled_at"), ago("DAY", 60).alias("created_at"),
        now.alias("updated_at"))
    bot2 = one.select(
        F.lit(BOT2).alias("id"), F.lit(ACCOUNT_ID).alias("owner_account_id"),
        F.lit(BOT2_IDENTIFIER).alias("bot_identifier"), F.lit("token").alias("bot_type"),
        F.lit(X.GENERIC_BOT_NAME).alias("display_name"), F.lit(None).cast("string").alias("telegram_bot_id"),
        F.lit(None).cast("string").alias("encrypted_token"), F.lit("pending").alias("verification_status"),
        F.lit("disabled").alias("tracking_status"), F.lit("pending").alias("webhook_status"),
        ago("DAY", 45).alias("connected_at"), F.lit(None).cast("timestamp").alias("verified_at"),
        F.lit(None).cast("timestamp").alias("tracking_enabled_at"), ago("DAY", 45).alias("created_at"),
        now.alias("updated_at"))
    n_users = SEED_USERS * scale
    gs = F.col("id")
    users = spark.range(1, n_users + 1).select(
        F.concat(F.lit("seed-user-"), gs.cast("string")).alias("uid"), gs.alias("gs"),
        F.lit(BOT1).alias("bot_id"), F.concat(F.lit("tg-user-"), gs.cast("string")).alias("telegram_id"),
        F.concat(F.lit("user"), gs.cast("string")).alias("username"),
        F.concat(F.lit("First"), gs.cast("string")).alias("first_name"),
        F.concat(F.lit("Last"), gs.cast("string")).alias("last_name"),
        ago("DAY", F.lit(30) - gs % 30).alias("created_at"),
        ago("HOUR", gs % 3).alias("last_active_at"), gs.alias("first_seq"), gs.alias("last_seq"))
    users_t = users.withColumnRenamed("uid", "id").drop("gs")
    rn = F.col("id")
    messages = spark.range(1, 3 * n_users + 1).select(
        F.concat(F.lit("seed-message-"), rn.cast("string")).alias("id"), F.lit(BOT1).alias("bot_id"),
        F.concat(F.lit("seed-user-"), (F.floor((rn - 1) / 3) + 1).cast("string")).alias("user_id"),
        F.concat(F.lit("Sample message #"), rn.cast("string")).alias("text"),
        ago("DAY", rn % 30).alias("created_at"))
    payers = users.filter(F.substring("telegram_id", -1, 1).isin("1", "3", "5", "7", "9"))
    pn = ((F.col("gs") + 1) / 2).cast("long")          # 1..60: the payment's row number
    payments = payers.select(
        F.concat(F.lit("seed-payment-"), pn.cast("string")).alias("id"),
        F.lit(BOT1).alias("bot_id"), F.col("uid").alias("user_id"),
        ((pn % 9 + 1) * F.lit(4.99).cast("decimal(4,2)")).cast("decimal(12,2)").alias("amount"),
        F.lit("USD").alias("currency"), ago("DAY", pn % 20).alias("created_at"))
    health = spark.range(1, 31).select(
        F.concat(F.lit("seed-health-"), gs.cast("string")).alias("id"), F.lit(BOT1).alias("bot_id"),
        F.lit("online").alias("status"), F.lit("99.70").cast("decimal(5,2)").alias("uptime"),
        (F.lit(10) + gs % 5).cast("int").alias("request_count"),
        ago("DAY", F.lit(30) - gs).alias("created_at"))
    rows = [(f"seed-activity-{i + 1}", BOT1, et, d, code, p, m)
            for i, (et, d, code, p, m) in enumerate(SEED_ACTIVITY)]
    act = spark.createDataFrame(rows, "id string, bot_id string, event_type string, description string, "
                                      "event_code string, params string, m int")
    activity = act.select("id", "bot_id", "event_type", "description", "event_code", "params",
                          ago("MINUTE", F.col("m")).alias("created_at"))
    return Tables(
        accounts=conform(accounts, "accounts"), subscriptions=conform(subscriptions, "subscriptions"),
        bots=conform(bot1.unionByName(bot2), "bots"), users=conform(users_t, "users"),
        messages=conform(messages, "messages"), payments=conform(payments, "payments"),
        bot_health_logs=conform(health, "bot_health_logs"),
        activity_logs=conform(activity, "activity_logs"))
