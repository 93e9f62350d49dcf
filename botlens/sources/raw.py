"""Raw JSON inputs derived from the driver tables (S2-S4 fixtures).

* ``api_events``: one HTTP body per ``events`` row (click/view -> message,
  signup -> user_joined, purchase -> payment); ``error`` rows become the
  bad-input cases of FIXTURES.md §2, chosen by k.
* ``platform_updates``: platform update JSON per ``events`` row.
* ``billing_webhooks``: billing notifications from ``orders``.

Each row carries ``ingest_seq`` and ``received_at``.  The bot dimension is
the 25-row ``nation`` table (fixed size), joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botlens.functions import exprs as X
from botlens.sources.fixtures import events_a, read

TOKEN_SECRET = "fixture-token-secret"
API_KEY_SECRET = "fixture-api-key-secret"


def _nation(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    return F.broadcast(n.select(F.col("n_nationkey").cast("string").alias("bot_id"),
                                "n_name", "n_regionkey"))


def api_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, api_key, body, ingest_seq, received_at) per events row."""
    ev = events_a(spark, sf_dir).join(_nation(spark, sf_dir), "bot_id")
    k, et = F.col("k"), F.col("event_type")
    is_username = F.col("bot_id").cast("int") % 2 == 0
    bot_value = F.when(is_username, F.concat(F.lit(" @"), F.col("n_name"), F.lit(" "))) \
        .otherwise(F.concat((F.lit(7000000) + F.col("bot_id").cast("int")).cast("string"),
                            F.lit(":AAH_token-"), F.lower("n_name"), F.lit("_xxxxxxxxxxxx")))
    user = F.struct(
        F.col("user_id").cast("string").alias("telegramId"),
        F.when(k % 7 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("username"),
        F.when(k % 3 == 0, F.lit("First")).alias("firstName"))
    kind = (F.when(et.isin("click", "view", "error"), "message")
             .when(et == "purchase", "payment").otherwise("user_joined"))
    staged = ev.select(
        "event_id", "ts", "user_id", "event_type", "value", "props", "k", "n_regionkey",
        kind.alias("kind"), bot_value.alias("bot_value"),
        F.when(is_username, "username").otherwise("token").alias("bot_type"),
        F.to_json(user).alias("user_json"))
    kind = F.col("kind")
    good = F.to_json(F.struct(
        F.col("bot_type").alias("botType"), F.col("bot_value").alias("botValue"),
        F.from_json("user_json", "telegramId string, username string, firstName string")
         .alias("user"),
        F.when(kind == "message", F.col("props")).alias("text"),
        F.when(kind == "payment", F.col("value")).alias("amount"),
        F.when(kind == "payment", F.when(k % 10 == 0, "eur").otherwise("usd")).alias("currency"),
        F.when(k % 5 != 0, X.iso_text("ts")).alias("createdAt")))
    staged = staged.select("*", good.alias("good"))
    value_json = X.json_string(F.col("bot_value"))
    head = F.concat(F.lit('{"botType":"username","botValue":'), value_json)
    bad_case = k % 10
    bad = (F.when(bad_case == 0, F.lit("not json"))
            .when(bad_case == 1, F.concat(F.lit('{"botValue":'), value_json, F.lit("}")))
            .when(bad_case == 2, F.concat(head, F.lit(',"user":{"telegramId":'),
                                          F.col("user_id").cast("string"), F.lit("}}")))
            .when(bad_case == 3, F.concat(head, F.lit(',"user":{"telegramId":"1"},"createdAt":null}')))
            .when(bad_case == 4, F.concat(head, F.lit(',"user":{"telegramId":"1"},"text":5}')))
            .when(bad_case == 5, F.concat(F.col("good"), F.lit(" trailing")))
            .when(bad_case == 6, F.concat(head, F.lit(',"user":{"telegramId":"1","username":"'),
                                          F.repeat(F.lit("n"), 256), F.lit('"}}')))
            .when(bad_case == 7, F.lit('{"botType":"email","botValue":"x","user":{"telegramId":"1"}}'))
            .when(bad_case == 8, F.concat(head, F.lit(',"user":'), F.col("user_json"),
                                          F.lit(',"createdAt":"not a date"}')))
            .otherwise(F.lit('{"botType":"token","botValue":"1","user":[1,2]}')))
    body = F.when(F.col("event_type") == "error", bad).otherwise(F.col("good"))
    api_key = F.when(k == 99, F.lit("key-unknown")).otherwise(
        F.concat(F.lit("key-"), F.col("n_regionkey").cast("string")))
    return staged.select("kind", api_key.alias("api_key"), body.alias("body"),
                         F.col("event_id").alias("ingest_seq"),
                         F.timestamp_add("SECOND", F.lit(5), F.col("ts")).alias("received_at"))


def platform_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bot_id, body, ingest_seq, received_at) per events row."""
    ev = events_a(spark, sf_dir)
    k, et, uid = F.col("k"), F.col("event_type"), F.col("user_id")
    sender = F.struct(uid.alias("id"), F.lit(False).alias("is_bot"),
                      F.lit("Ann").alias("first_name"),
                      F.concat(F.lit("u"), uid.cast("string")).alias("username"))
    members = F.array(
        F.struct((uid * 10 + 1).alias("id"), F.lit(False).alias("is_bot"),
                 F.lit("Joe").alias("first_name"), F.lit(None).cast("string").alias("username")),
        F.struct((uid * 10 + 2).alias("id"), (k % 2 == 0).alias("is_bot"),
                 F.lit("Bo").alias("first_name"), F.lit("bo").alias("username")))
    message = F.struct(
        F.col("event_id").alias("message_id"),
        F.when(et != "error", sender).alias("from"),
        F.struct(uid.alias("id"), F.lit("private").alias("type")).alias("chat"),
        F.unix_timestamp("ts").alias("date"),
        F.when(et.isin("click", "view"), F.col("props")).alias("text"),
        F.when(et == "signup", members).alias("new_chat_members"))
    body = F.to_json(F.struct(F.col("event_id").alias("update_id"), message.alias("message")))
    return ev.select("bot_id", body.alias("body"), F.col("event_id").alias("ingest_seq"),
                     F.timestamp_add("SECOND", F.lit(2), F.col("ts")).alias("received_at"))


def billing_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body, ingest_seq, received_at) per orders row (FIXTURES.md §3)."""
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "active") \
        .when(F.col("o_orderstatus") == "O", "past_due").otherwise("canceled")
    plan = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "growth").otherwise("starter")
    body = F.to_json(F.struct(
        F.lit("Stripe").alias("provider"),
        F.when(F.col("o_orderstatus") == "P", "subscription.canceled")
         .otherwise("subscription.updated").alias("type"),
        (key % 5000).cast("string").alias("providerEventId"),
        F.when(key % 97 == 0, F.lit("missing")).otherwise(F.col("n_regionkey").cast("string"))
         .alias("accountId"),
        plan.alias("plan"), status.alias("status"),
        F.when(key % 4 == 0, F.concat(F.lit("cus_"), F.col("o_custkey").cast("string")))
         .alias("providerCustomerId"),
        F.concat(F.lit("sub_"), F.col("o_custkey").cast("string")).alias("providerSubscriptionId"),
        F.when(key % 83 == 0, F.lit(-1.0))
         .when(key % 3 == 0, F.round(F.col("o_totalprice") / 1000, 2)).alias("amount"),
        F.when(key % 7 == 0, F.lit("eur")).alias("currency"),
        F.when(key % 89 == 0, F.lit("soon")).otherwise(X.iso_text("o_orderdate"))
         .alias("currentPeriodStart"),
        X.iso_text(F.timestamp_add("DAY", F.lit(30), F.col("o_orderdate"))).alias("currentPeriodEnd")))
    return x.select(body.alias("body"), key.alias("ingest_seq"),
                    F.timestamp_add("SECOND", key % 86400, F.col("o_orderdate")).alias("received_at"))


# --- malformed inputs ---------------------------------------------------------------------
# One case a row, chosen by the row's number, so every case occurs in proportion to the table.
# (body with {bot}, {key} placeholders, expected error code and field; no code: accepted)
_USER = '"user":{"telegramId":"7"}'
_NAMED = '"botType":"username","botValue":"@{bot}"'
BAD_API = [
    ("message", '{"a":1},"x":2', "INVALID_JSON", "body"),
    ("message", '1,"v":{"a":2}', "INVALID_JSON", "body"),
    ("message", "{" + _NAMED + "," + _USER + '} x', "INVALID_JSON", "body"),
    ("message", "", "VALIDATION_ERROR", "body"),
    ("message", "null", "INTERNAL_ERROR", "body"),
    ("payment", "{" + _NAMED + "," + _USER + ',"amount":"abc","currency":"usd"}', "VALIDATION_ERROR", "amount"),
    ("payment", "{" + _NAMED + "," + _USER + ',"amount":100000000000,"currency":"usd"}', "VALIDATION_ERROR", "amount"),
    ("message", "{" + _NAMED + "," + _USER + ',"createdAt":"12:30:00"}', "VALIDATION_ERROR", "createdAt"),
    ("message", "{" + _NAMED + "," + _USER + ',"createdAt":"T12:30"}', "VALIDATION_ERROR", "createdAt"),
    ("message", "{" + _NAMED + ',"user":{"telegramId":42}}', "VALIDATION_ERROR", "user.telegramId"),
    ("message", "{" + _NAMED + "," + _USER + ',"text":"fine"}', None, None),
    ("user_joined", "{" + _NAMED + ',"user":[1]}', "VALIDATION_ERROR", "user.telegramId"),
    ("user_joined", '{"botType":"username","botValue":"' + "v" * 513 + '",' + _USER + "}", "VALIDATION_ERROR", "botValue"),
    ("payment", "{" + _NAMED + "," + _USER + ',"amount":-1,"currency":"usd"}', "VALIDATION_ERROR", "amount"),
    ("user_joined", '{"botType":"x",' + _NAMED + "," + _USER + "}", None, None),
    ("payment", "{" + _NAMED + "," + _USER + ',"amount":1,"currency":"ABCDEFGHI"}', "VALIDATION_ERROR", "currency"),
]
# expected code ``ignored``: valid, but nothing to write
BAD_PLATFORM = [
    ("", "VALIDATION_ERROR", "body"),
    ("not json", "INVALID_JSON", "body"),
    ('{"message":{"from":{"id":1},"date":1704067200,"text":"x"}} x', "INVALID_JSON", "body"),
    ('{"a":1},"x":2', "INVALID_JSON", "body"),
    ("null", "INTERNAL_ERROR", "body"),
    ('{"message":{"from":{"id":1},"text":"x"}}', "INTERNAL_ERROR", "message.date"),
    ('{"message":{"from":{"id":1},"date":"abc","text":"x"}}', "INTERNAL_ERROR", "message.date"),
    ('{"message":{"from":{"id":1},"date":1e30,"text":"x"}}', "INTERNAL_ERROR", "message.date"),
    ('{"message":{"from":{"id":1}}}', "ignored", None),
    ('{"update_id":1}', "ignored", None),
    ('{"message":{"date":1704067200,"text":"no sender"}}', "ignored", None),
    ('{"message":{"from":{"id":1},"date":1704067200,"new_chat_members":[{"id":"text","is_bot":false}]}}', None, None),
    ('{"message":{"from":{"id":1},"date":1704067200,"text":""}}', None, None),
]
_PAID = '"provider":"stripe","type":"t","providerEventId":"{key}","plan":"growth","status":"active"'
BAD_BILLING = [
    ("{" + _PAID + ',"accountId":"1","amount":"abc"}', "VALIDATION_ERROR", "amount"),
    ("{" + _PAID + ',"accountId":"1","amount":100000000000}', "INTERNAL_ERROR", "amount"),
    ("{" + _PAID + ',"accountId":"1","amount":-1}', "INTERNAL_ERROR", "amount"),
    ("{" + _PAID + ',"accountId":"1","currentPeriodStart":"12:30:00"}', "VALIDATION_ERROR", "currentPeriod"),
    ("{" + _PAID + ',"accountId":"1","currentPeriodEnd":"soon"}', "VALIDATION_ERROR", "currentPeriod"),
    ("{" + _PAID + ',"accountId":"missing"}', "ACCOUNT_NOT_FOUND", "accountId"),
    ("{" + _PAID + ',"accountId":"1","plan":"gold"}', "VALIDATION_ERROR", "plan"),
    ("{" + _PAID + ',"accountId":"1","status":"paused"}', "VALIDATION_ERROR", "status"),
    ("{" + _PAID + ',"accountId":"1","provider":5}', "VALIDATION_ERROR", "provider"),
    ("{" + _PAID + ',"accountId":"1"} x', "INVALID_JSON", "body"),
    ('{"a":1},"x":2', "INVALID_JSON", "body"),
    ("", "VALIDATION_ERROR", "body"),
    ("null", "INTERNAL_ERROR", "body"),
    ("{" + _PAID + ',"accountId":"1","amount":5}', None, None),
]


def _case(number, values):
    """The value of the row's case."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def bad_api_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_a(spark, sf_dir).join(_nation(spark, sf_dir), "bot_id")
    number = F.col("event_id")
    return ev.select(
        _case(number, [c[0] for c in BAD_API]).alias("kind"),
        F.concat(F.lit("key-"), F.col("n_regionkey").cast("string")).alias("api_key"),
        F.replace(_case(number, [c[1] for c in BAD_API]), F.lit("{bot}"), F.concat(F.lit("bad"), F.col("n_regionkey"))).alias("body"),
        number.alias("ingest_seq"), F.col("ts").alias("received_at"))


def bad_platform_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 11th row names a bot that does not exist."""
    number = F.col("event_id")
    return events_a(spark, sf_dir).select(
        F.when(number % 11 == 0, "no-such-bot").otherwise(F.col("bot_id")).alias("bot_id"),
        _case(number, [c[0] for c in BAD_PLATFORM]).alias("body"), number.alias("ingest_seq"), F.col("ts").alias("received_at"))


def bad_billing_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.replace(_case(number, [c[0] for c in BAD_BILLING]), F.lit("{key}"), number.cast("string")).alias("body"),
        number.alias("ingest_seq"), F.col("o_orderdate").cast("timestamp").alias("received_at"))
