"""Driver tables -> domain tables (FIXTURES.md §3), in Spark and in SQL.

Mapping A (``events`` based) is the correctness fixture; mapping B (the star
schema) is the scale / bench fixture.  Each mapping exists twice: as Spark
DataFrames, and as SQL common table expressions that DuckDB runs for the
oracle.  Both must produce the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botlens.functions import exprs as X
from botlens.schemas import conform
from botlens.sources.tables import Tables

AS_OF_A = datetime(2024, 1, 30, 12, 0, 0)
AS_OF_B = datetime(1998, 9, 15, 12, 0, 0)
FIXTURE_API_SECRET = "fixture-api-key-secret"
N_BOTS_A = 24


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def api_key_of(account_id) -> "F.Column":
    """The fixture's plain API key of an account id."""
    return F.concat(F.lit("key-"), X.col_(account_id))


def _accounts(spark, sf_dir) -> DataFrame:
    r = read(spark, sf_dir, "region")
    id_ = F.col("r_regionkey").cast("string")
    return conform(r.select(
        id_.alias("id"),
        F.concat(F.lit("owner"), id_, F.lit("@example.com")).alias("email"),
        F.col("r_name").alias("name"),
        X.hmac_sha256_hex(api_key_of(id_), FIXTURE_API_SECRET).alias("api_key_hash"),
        F.lit(None).cast("string").alias("billing_provider_customer_id"),
        F.when(F.col("r_regionkey") % 2 == 0, "starter").otherwise("growth").alias("plan"),
        F.lit("2023-11-01 00:00:00").cast("timestamp").alias("created_at"),
        F.lit("2023-11-01 00:00:00").cast("timestamp").alias("updated_at")), "accounts")


def _bots(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    connected = F.timestamp_add("DAY", k, F.lit("2023-12-01 00:00:00").cast("timestamp"))
    verified = k % 3 != 0
    after = F.timestamp_add("DAY", F.lit(1), connected)
    return conform(n.select(
        k.cast("string").alias("id"),
        F.col("n_regionkey").cast("string").alias("owner_account_id"),
        F.lower("n_name").alias("bot_identifier"),
        F.when(k % 2 == 0, "username").otherwise("token").alias("bot_type"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("@"), F.lower("n_name")))
         .alias("display_name"),
        F.lit(None).cast("string").alias("telegram_bot_id"),
        F.lit(None).cast("string").alias("encrypted_token"),
        F.when(verified, "verified").otherwise("pending").alias("verification_status"),
        F.when(verified, "enabled").otherwise("disabled").alias("tracking_status"),
        F.lit("pending").alias("webhook_status"),
        connected.alias("connected_at"),
        F.when(verified, after).alias("verified_at"),
        F.when(verified, after).alias("tracking_enabled_at"),
        connected.alias("created_at"), connected.alias("updated_at")), "bots")


def events_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the mapping-A derived columns k and bot_id."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        "value", "props",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("user_id") % N_BOTS_A).cast("string").alias("bot_id"))


def mapping_a(spark: SparkSession, sf_dir: str) -> Tables:
    ev = events_a(spark, sf_dir)
    eid = F.col("event_id").cast("string")
    uid = F.col("user_id").cast("string")
    users = ev.filter(F.col("event_type") == "signup").select(
        eid.alias("id"), "bot_id", eid.alias("telegram_id"),
        F.concat(F.lit("u"), uid).alias("username"),
        F.lit(None).cast("string").alias("first_name"),
        F.lit(None).cast("string").alias("last_name"),
        F.col("ts").alias("created_at"),
        F.timestamp_add("HOUR", F.col("k"), F.col("ts")).alias("last_active_at"),
        F.col("event_id").alias("first_seq"), F.col("event_id").alias("last_seq"))
    messages = ev.filter(F.col("event_type").isin("click", "view")).select(
        eid.alias("id"), "bot_id", uid.alias("user_id"), F.col("props").alias("text"),
        F.col("ts").alias("created_at"))
    amount = F.col("value").cast("decimal(12,2)")
    currency = F.when(F.col("k") % 10 == 0, "EUR").otherwise("USD")
    payments = ev.filter(F.col("event_type") == "purchase").select(
        eid.alias("id"), "bot_id", uid.alias("user_id"), amount.alias("amount"),
        currency.alias("currency"), F.col("ts").alias("created_at"))
    is_error = F.col("event_type") == "error"
    health = ev.select(
        eid.alias("id"), "bot_id",
        F.when(is_error, "offline").otherwise("online").alias("status"),
        F.when(is_error, F.lit(95)).otherwise(F.lit(100)).cast("decimal(5,2)").alias("uptime"),
        F.lit(1).alias("request_count"), F.col("ts").alias("created_at"))
    et = F.col("event_type")
    kind = (F.when(et.isin("click", "view"), "message").when(et == "purchase", "payment")
             .otherwise("user_joined"))
    described = (
        F.when(kind == "message", F.concat(F.lit("Message received from "), uid))
         .when(kind == "payment", F.concat(F.lit("Payment of "), amount.cast("string"),
                                           F.lit(" "), currency))
         .otherwise(F.concat(F.lit("User "), uid, F.lit(" joined"))))
    legacy = F.col("event_id") % 3 == 0
    description = F.when(legacy & (F.col("event_id") % 7 == 0),
                         F.concat(F.lit("Imported "), kind, F.lit(" record"))) \
                   .otherwise(described)
    code = (F.when(kind == "message", "message.received")
             .when(kind == "payment", "payment.received").otherwise("user.joined"))
    event_code = F.when(legacy & (F.col("event_id") % 2 == 0), F.lit("")) \
                  .when(legacy, F.lit(None)).otherwise(code)
    user_json = X.json_string(uid)
    params = (
        F.when(legacy, F.lit("{}"))
         .when(kind == "payment",
               F.concat(F.lit('{"user":'), user_json, F.lit(',"amount":'),
                        X.js_number_text(amount), F.lit(',"currency":'),
                        X.json_string(currency), F.lit("}")))
         .otherwise(F.concat(F.lit('{"user":'), user_json, F.lit("}"))))
    activity = ev.filter(~is_error).select(
        eid.alias("id"), "bot_id", kind.alias("event_type"), description.alias("description"),
        event_code.alias("event_code"), params.alias("params"), F.col("ts").alias("created_at"))
    return Tables(
        accounts=_accounts(spark, sf_dir), bots=_bots(spark, sf_dir),
        users=conform(users, "users"), messages=conform(messages, "messages"),
        payments=conform(payments, "payments"), bot_health_logs=conform(health, "bot_health_logs"),
        activity_logs=conform(activity, "activity_logs"))


def contract_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Mapping A with subscriptions (one a supplier) and billing events (one an
    order) that break some rules: several subscriptions an account, unknown
    providers and accounts, negative amounts, redelivered event ids."""
    t = mapping_a(spark, sf_dir)
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("account_id"))
    s = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    subs = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.cast("string").alias("id"), "account_id",
        F.when(key % 9 == 0, "paypal").otherwise("stripe").alias("provider"),
        F.lit(None).cast("string").alias("provider_customer_id"),
        F.lit(None).cast("string").alias("provider_subscription_id"),
        F.when(key % 8 == 0, "gold").otherwise("growth").alias("plan"),
        F.when(key % 7 == 0, "paused").otherwise("active").alias("status"),
        F.when(key % 5 == 0, F.lit(-1)).otherwise(F.lit(99)).cast("decimal(12,2)").alias("amount_monthly"),
        F.lit("USD").alias("currency"), at.alias("current_period_start"), at.alias("current_period_end"),
        F.lit(False).alias("cancel_at_period_end"), at.alias("created_at"), at.alias("updated_at"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key = F.col("o_orderkey")
    billing = (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
               .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.cast("string").alias("id"), F.when(key % 97 == 0, "missing").otherwise(F.col("account_id")).alias("account_id"),
        F.when(key % 101 == 0, "paypal").otherwise("stripe").alias("provider"),
        (key % 5000).cast("string").alias("provider_event_id"), F.lit("subscription.updated").alias("event_type"),
        F.when(key % 103 != 0, F.lit("{}")).alias("payload"), at.alias("processed_at"), at.alias("created_at")))
    return t.with_(subscriptions=subs, billing_events=billing)


def contract_tables_sql() -> str:
    return mapping_a_sql() + """,
d_subscriptions AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(n_regionkey AS VARCHAR) AS account_id,
         CASE WHEN s_suppkey % 9 = 0 THEN 'paypal' ELSE 'stripe' END AS provider,
         CASE WHEN s_suppkey % 8 = 0 THEN 'gold' ELSE 'growth' END AS plan,
         CASE WHEN s_suppkey % 7 = 0 THEN 'paused' ELSE 'active' END AS status,
         CASE WHEN s_suppkey % 5 = 0 THEN -1.0 ELSE 99.0 END AS amount_monthly, 'USD' AS currency,
         false AS cancel_at_period_end, TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
d_billing_events AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
         CASE WHEN o_orderkey % 97 = 0 THEN 'missing' ELSE CAST(n_regionkey AS VARCHAR) END AS account_id,
         CASE WHEN o_orderkey % 101 = 0 THEN 'paypal' ELSE 'stripe' END AS provider,
         CAST(o_orderkey % 5000 AS VARCHAR) AS provider_event_id, 'subscription.updated' AS event_type,
         CASE WHEN o_orderkey % 103 <> 0 THEN '{}' END AS payload,
         TIMESTAMP '2024-01-01' AS processed_at, TIMESTAMP '2024-01-01' AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def user_arrivals_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals for the user upsert (I9): every event, late by k hours."""
    ev = events_a(spark, sf_dir)
    return ev.select(
        "bot_id", F.col("user_id").cast("string").alias("telegram_id"),
        F.when(F.col("k") % 7 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("username"),
        F.lit(None).cast("string").alias("first_name"),
        F.lit(None).cast("string").alias("last_name"),
        F.timestamp_add("HOUR", -F.col("k"), F.col("ts")).alias("event_time"),
        F.col("event_id").alias("seq"))


def mapping_b(spark: SparkSession, sf_dir: str) -> Tables:
    """Star-schema mapping over whole tables: rows after the point in time stay,
    as the reference's windows have no upper bound."""
    cust = read(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("bot_id"))
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    co = orders.join(cust, orders.o_custkey == cust.c_custkey)
    firsts = co.groupBy("c_custkey", "c_name", "bot_id").agg(
        F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("last_active_at"))
    cid = F.col("c_custkey").cast("string")
    users = firsts.select(
        cid.alias("id"), "bot_id", cid.alias("telegram_id"), F.col("c_name").alias("username"),
        F.lit(None).cast("string").alias("first_name"), F.lit(None).cast("string").alias("last_name"),
        "created_at", "last_active_at",
        F.col("c_custkey").alias("first_seq"), F.col("c_custkey").alias("last_seq"))
    oid = F.col("o_orderkey").cast("string")
    amount = F.col("o_totalprice").cast("decimal(12,2)")
    payments = co.select(oid.alias("id"), "bot_id", cid.alias("user_id"), amount.alias("amount"),
                         F.lit("USD").alias("currency"), F.col("o_orderdate").alias("created_at"))
    pending = F.col("o_orderstatus") == "P"
    health = co.select(
        oid.alias("id"), "bot_id", F.when(pending, "offline").otherwise("online").alias("status"),
        F.when(pending, F.lit(95)).otherwise(F.lit(100)).cast("decimal(5,2)").alias("uptime"),
        F.lit(1).alias("request_count"), F.col("o_orderdate").alias("created_at"))
    activity = co.select(
        oid.alias("id"), "bot_id", F.lit("payment").alias("event_type"),
        F.concat(F.lit("Payment of "), amount.cast("string"), F.lit(" USD")).alias("description"),
        F.lit("payment.received").alias("event_code"),
        F.concat(F.lit('{"user":'), X.json_string(cid), F.lit(',"amount":'),
                 X.js_number_text(amount), F.lit(',"currency":"USD"}')).alias("params"),
        F.col("o_orderdate").alias("created_at"))
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.col("l_shipdate").cast("timestamp").alias("l_shipdate"))
    lo = li.join(orders.select("o_orderkey", "o_custkey"), li.l_orderkey == orders.o_orderkey) \
           .join(cust, F.col("o_custkey") == cust.c_custkey)
    messages = lo.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
         .alias("id"), "bot_id", cid.alias("user_id"), F.col("l_returnflag").alias("text"),
        F.col("l_shipdate").alias("created_at"))
    return Tables(
        accounts=_accounts(spark, sf_dir), bots=_bots(spark, sf_dir),
        users=conform(users, "users"), messages=conform(messages, "messages"),
        payments=conform(payments, "payments"), bot_health_logs=conform(health, "bot_health_logs"),
        activity_logs=conform(activity, "activity_logs"))


# ---------------------------------------------------------------------------
# The same mappings as DuckDB SQL (oracle side).  ``{hmac}`` placeholders are
# filled by ``oracle_hmac_sql``.

def sql_hmac(expr: str, secret: str) -> str:
    ipad, opad = X._pads(secret)
    inner = f"unhex(sha256(unhex('{ipad}') || encode({expr})))"
    return f"sha256(unhex('{opad}') || {inner})"


def _sql_common() -> str:
    hm = sql_hmac("'key-' || CAST(r_regionkey AS VARCHAR)", FIXTURE_API_SECRET)
    return f"""
d_accounts AS (
  SELECT CAST(r_regionkey AS VARCHAR) AS id,
         'owner' || CAST(r_regionkey AS VARCHAR) || '@example.com' AS email,
         r_name AS name, {hm} AS api_key_hash,
         CAST(NULL AS VARCHAR) AS billing_provider_customer_id,
         CASE WHEN r_regionkey % 2 = 0 THEN 'starter' ELSE 'growth' END AS plan,
         TIMESTAMP '2023-11-01 00:00:00' AS created_at, TIMESTAMP '2023-11-01 00:00:00' AS updated_at
  FROM region),
d_bots AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(n_regionkey AS VARCHAR) AS owner_account_id,
         lower(n_name) AS bot_identifier,
         CASE WHEN n_nationkey % 2 = 0 THEN 'username' ELSE 'token' END AS bot_type,
         CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE '@' || lower(n_name) END AS display_name,
         CAST(NULL AS VARCHAR) AS telegram_bot_id, CAST(NULL AS VARCHAR) AS encrypted_token,
         CASE WHEN n_nationkey % 3 <> 0 THEN 'verified' ELSE 'pending' END AS verification_status,
         CASE WHEN n_nationkey % 3 <> 0 THEN 'enabled' ELSE 'disabled' END AS tracking_status,
         'pending' AS webhook_status,
         TIMESTAMP '2023-12-01 00:00:00' + n_nationkey * INTERVAL 1 DAY AS connected_at,
         CASE WHEN n_nationkey % 3 <> 0
              THEN TIMESTAMP '2023-12-02 00:00:00' + n_nationkey * INTERVAL 1 DAY END AS verified_at,
         CASE WHEN n_nationkey % 3 <> 0
              THEN TIMESTAMP '2023-12-02 00:00:00' + n_nationkey * INTERVAL 1 DAY END AS tracking_enabled_at,
         TIMESTAMP '2023-12-01 00:00:00' + n_nationkey * INTERVAL 1 DAY AS created_at,
         TIMESTAMP '2023-12-01 00:00:00' + n_nationkey * INTERVAL 1 DAY AS updated_at
  FROM nation)"""


def mapping_a_sql() -> str:
    """CTEs d_accounts, d_bots, d_users, d_messages, d_payments,
    d_bot_health_logs, d_activity_logs, ev (mapping A)."""
    return "WITH" + _sql_common() + f""",
ev AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, props,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         CAST(user_id % {N_BOTS_A} AS VARCHAR) AS bot_id,
         CAST(event_id AS VARCHAR) AS eid, CAST(user_id AS VARCHAR) AS uid,
         CAST(value AS DECIMAL(12,2)) AS amount
  FROM events),
d_users AS (
  SELECT eid AS id, bot_id, eid AS telegram_id, 'u' || uid AS username,
         CAST(NULL AS VARCHAR) AS first_name, CAST(NULL AS VARCHAR) AS last_name,
         ts AS created_at, ts + k * INTERVAL 1 HOUR AS last_active_at,
         event_id AS first_seq, event_id AS last_seq
  FROM ev WHERE event_type = 'signup'),
d_messages AS (
  SELECT eid AS id, bot_id, uid AS user_id, props AS text, ts AS created_at
  FROM ev WHERE event_type IN ('click', 'view')),
d_payments AS (
  SELECT eid AS id, bot_id, uid AS user_id, amount,
         CASE WHEN k % 10 = 0 THEN 'EUR' ELSE 'USD' END AS currency, ts AS created_at
  FROM ev WHERE event_type = 'purchase'),
d_bot_health_logs AS (
  SELECT eid AS id, bot_id,
         CASE WHEN event_type = 'error' THEN 'offline' ELSE 'online' END AS status,
         CAST(CASE WHEN event_type = 'error' THEN 95 ELSE 100 END AS DECIMAL(5,2)) AS uptime,
         1 AS request_count, ts AS created_at
  FROM ev),
ev_kind AS (
  SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'message'
                 WHEN event_type = 'purchase' THEN 'payment' ELSE 'user_joined' END AS kind,
         CASE WHEN k % 10 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
         event_id % 3 = 0 AS legacy
  FROM ev WHERE event_type <> 'error'),
d_activity_logs AS (
  SELECT eid AS id, bot_id, kind AS event_type,
         CASE WHEN legacy AND event_id % 7 = 0 THEN 'Imported ' || kind || ' record'
              WHEN kind = 'message' THEN 'Message received from ' || uid
              WHEN kind = 'payment' THEN 'Payment of ' || CAST(amount AS VARCHAR) || ' ' || currency
              ELSE 'User ' || uid || ' joined' END AS description,
         CASE WHEN legacy AND event_id % 2 = 0 THEN ''
              WHEN legacy THEN NULL
              WHEN kind = 'message' THEN 'message.received'
              WHEN kind = 'payment' THEN 'payment.received' ELSE 'user.joined' END AS event_code,
         CASE WHEN legacy THEN '{{}}'
              WHEN kind = 'payment' THEN '{{"user":' || to_json(uid) || ',"amount":'
                   || regexp_replace(CAST(CAST(amount AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', '')
                   || ',"currency":' || to_json(currency) || '}}'
              ELSE '{{"user":' || to_json(uid) || '}}' END AS params,
         ts AS created_at
  FROM ev_kind)"""


def mapping_b_sql() -> str:
    return "WITH" + _sql_common() + f""",
cust AS (SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS bot_id FROM customer),
ords AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate
         FROM orders),
co AS (SELECT * FROM ords JOIN cust ON o_custkey = c_custkey),
d_users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, bot_id, CAST(c_custkey AS VARCHAR) AS telegram_id,
         c_name AS username, CAST(NULL AS VARCHAR) AS first_name, CAST(NULL AS VARCHAR) AS last_name,
         min(o_orderdate) AS created_at, max(o_orderdate) AS last_active_at,
         c_custkey AS first_seq, c_custkey AS last_seq
  FROM co GROUP BY c_custkey, c_name, bot_id),
d_payments AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, bot_id, CAST(c_custkey AS VARCHAR) AS user_id,
         CAST(o_totalprice AS DECIMAL(12,2)) AS amount, 'USD' AS currency, o_orderdate AS created_at
  FROM co),
d_bot_health_logs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, bot_id,
         CASE WHEN o_orderstatus = 'P' THEN 'offline' ELSE 'online' END AS status,
         CAST(CASE WHEN o_orderstatus = 'P' THEN 95 ELSE 100 END AS DECIMAL(5,2)) AS uptime,
         1 AS request_count, o_orderdate AS created_at
  FROM co),
d_activity_logs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, bot_id, 'payment' AS event_type,
         'Payment of ' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) || ' USD' AS description,
         'payment.received' AS event_code,
         '{{"user":' || to_json(CAST(c_custkey AS VARCHAR)) || ',"amount":'
           || regexp_replace(CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', '')
           || ',"currency":"USD"}}' AS params,
         o_orderdate AS created_at
  FROM co),
d_messages AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, c.bot_id,
         CAST(c.c_custkey AS VARCHAR) AS user_id, l_returnflag AS text,
         CAST(l_shipdate AS TIMESTAMP) AS created_at
  FROM lineitem l JOIN ords o ON l.l_orderkey = o.o_orderkey JOIN cust c ON o.o_custkey = c.c_custkey)"""
