"""DDL constraints re-aimed as data-quality checks and bulk erasure.

Spark enforces no constraints, so ``check_contracts`` reports every NOT
NULL, CHECK, UNIQUE and FOREIGN KEY violation as rows
(table_name, rule, key): one pass over a table for its row rules, one for its keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlens import schemas as S
from botlens.sources.tables import Tables

# (table, column, allowed values)
ENUMS = [
    ("accounts", "plan", S.PLANS), ("bots", "bot_type", S.BOT_TYPES),
    ("bots", "verification_status", S.VERIFICATION_STATUSES),
    ("bots", "tracking_status", S.TRACKING_STATUSES),
    ("bots", "webhook_status", S.WEBHOOK_STATUSES),
    ("bot_health_logs", "status", S.HEALTH_STATUSES),
    ("subscriptions", "provider", S.BILLING_PROVIDERS), ("subscriptions", "plan", S.PLANS),
    ("subscriptions", "status", S.SUBSCRIPTION_STATUSES),
    ("billing_events", "provider", S.BILLING_PROVIDERS),
]
# (table, rule name, condition that must hold; built lazily)
CHECKS = [
    ("payments", "amount_non_negative", lambda: F.col("amount") >= 0),
    ("bot_health_logs", "uptime_range", lambda: (F.col("uptime") >= 0) & (F.col("uptime") <= 100)),
    ("bot_health_logs", "request_count_non_negative", lambda: F.col("request_count") >= 0),
    ("subscriptions", "amount_non_negative", lambda: F.col("amount_monthly") >= 0),
]
UNIQUE = [
    ("accounts", ["id"]), ("accounts", ["email"]), ("accounts", ["api_key_hash"]),
    ("bots", ["id"]), ("bots", ["bot_type", "bot_identifier"]),
    ("users", ["id"]), ("users", ["bot_id", "telegram_id"]),
    ("messages", ["id"]), ("payments", ["id"]), ("bot_health_logs", ["id"]),
    ("subscriptions", ["id"]), ("subscriptions", ["account_id"]),
    ("billing_events", ["id"]), ("billing_events", ["provider", "provider_event_id"]),
    ("activity_logs", ["id"]),
]
# (child table, column, parent table)
FOREIGN = [
    ("bots", "owner_account_id", "accounts"), ("users", "bot_id", "bots"),
    ("messages", "bot_id", "bots"), ("messages", "user_id", "users"),
    ("payments", "bot_id", "bots"), ("payments", "user_id", "users"),
    ("bot_health_logs", "bot_id", "bots"), ("subscriptions", "account_id", "accounts"),
    ("billing_events", "account_id", "accounts"), ("activity_logs", "bot_id", "bots"),
]


def _rule_breaks(t: Tables, name: str, df: DataFrame) -> DataFrame:
    """NOT NULL, CHECK and FOREIGN KEY violations of one table in one pass: the
    parents' key sets are joined on, and each row explodes the rules it breaks."""
    found = []
    for f in S.TABLE_SCHEMAS[name].fields:
        if not f.nullable:
            found.append((f"not_null:{f.name}", F.col(f.name).isNull()))
    found += [(f"check:{col}", ~F.col(col).isin(allowed)) for table, col, allowed in ENUMS if table == name]
    found += [(f"check:{rule}", ~cond()) for table, rule, cond in CHECKS if table == name]
    for child, col, parent in FOREIGN:
        if child == name and parent in t:
            keys = t[parent].select(F.col("id").alias(col)).distinct().withColumn(f"_has_{col}", F.lit(True))
            df = df.join(keys, col, "left")
            found.append((f"fk:{col}->{parent}", F.col(col).isNotNull() & F.col(f"_has_{col}").isNull()))
    broken = F.filter(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in found]), lambda x: x.isNotNull())
    return df.select(F.lit(name).alias("table_name"), F.explode(broken).alias("rule"),
                     F.col("id").cast("string").alias("key"))


def _duplicates(name: str, df: DataFrame) -> DataFrame | None:
    """UNIQUE violations of one table: all its keys are counted in one shuffle."""
    sets = [cols for table, cols in UNIQUE if table == name]
    if not sets:
        return None
    keys = F.array(*[F.struct(
        F.lit("unique:" + ",".join(cols)).alias("rule"),
        F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]),
               F.concat_ws("|", *[F.col(c).cast("string") for c in cols])).alias("key")) for cols in sets])
    return (df.select(F.explode(keys).alias("k")).select("k.*").filter("key is not null")
            .groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select(F.lit(name).alias("table_name"), "rule", "key"))


def check_contracts(t: Tables) -> DataFrame:
    """One row per violation: (table_name, rule, key)."""
    parts = []
    for name, df in t.items():
        if name in S.TABLE_SCHEMAS:
            parts += [_rule_breaks(t, name, df), _duplicates(name, df)]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def erase_bots(t: Tables, bot_ids: DataFrame) -> Tables:
    """Delete bots and, by cascade, their users and facts."""
    keys = bot_ids.select(F.col("bot_id")).distinct()
    out = Tables(t)
    out["bots"] = t.bots.join(keys.withColumnRenamed("bot_id", "id"), "id", "left_anti")
    for name in ("users", "messages", "payments", "bot_health_logs", "activity_logs"):
        if name in t:
            out[name] = t[name].join(keys, "bot_id", "left_anti")
    return out


def erase_accounts(t: Tables, account_ids: DataFrame) -> Tables:
    """Delete accounts; cascade to bots (and their data) and
    subscriptions; billing events keep their rows with account_id NULL."""
    keys = account_ids.select(F.col("account_id")).distinct()
    bots = t.bots.join(keys.withColumnRenamed("account_id", "owner_account_id"),
                       "owner_account_id", "left_semi").select(F.col("id").alias("bot_id"))
    out = erase_bots(t, bots)
    out["accounts"] = t.accounts.join(keys.withColumnRenamed("account_id", "id"), "id", "left_anti")
    if "subscriptions" in t:
        out["subscriptions"] = t.subscriptions.join(keys, "account_id", "left_anti")
    if "billing_events" in t:
        gone = keys.withColumn("_gone", F.lit(True))
        be = t.billing_events.join(gone, "account_id", "left")
        out["billing_events"] = be.withColumn(
            "account_id", F.when(F.col("_gone").isNull(), F.col("account_id"))).drop("_gone") \
            .select(*t.billing_events.columns)
    return out


def row_counts(t: Tables) -> DataFrame:
    """(table_name, row_count) for every table (used to report erasures)."""
    parts = [df.select(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for name, df in t.items()]
    return reduce(DataFrame.unionByName, parts)
