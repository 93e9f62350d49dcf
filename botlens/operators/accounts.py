"""Per-owner analytics and lookups.

Usage counts are pre-aggregated per bot before they meet the bot -> owner
dimension, so the shuffle carries one row per bot and partition, never the
activity rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlens.functions import exprs as X
from botlens.functions.clock import Clock, ts_lit
from botlens.schemas import plan_catalogue
from botlens.sources.tables import Tables


def _clock(as_of) -> Clock:
    return as_of if isinstance(as_of, Clock) else Clock.at(as_of)


def _restrict_owner(df: DataFrame, owners, col: str) -> DataFrame:
    if owners is None:
        return df
    if isinstance(owners, DataFrame):
        return df.join(owners.select(F.col("account_id").alias(col)).distinct(), col, "left_semi")
    return df.filter(F.col(col).isin([str(o) for o in owners]))


def account_usage(t: Tables, as_of, owners=None) -> DataFrame:
    """Q19: bots per owner and activity rows of its bots since the 1st."""
    c = _clock(as_of)
    accounts = _restrict_owner(t.accounts.select(F.col("id").alias("account_id")), owners,
                               "account_id")
    bots = t.bots.select(F.col("id").alias("bot_id"), F.col("owner_account_id").alias("account_id"))
    bot_count = bots.groupBy("account_id").agg(F.count(F.lit(1)).alias("total_bots"))
    per_bot = (t.activity_logs.filter(F.col("created_at") >= ts_lit(c.month_start))
               .groupBy("bot_id").agg(F.count(F.lit(1)).alias("n")))
    events = (per_bot.join(bots, "bot_id")
              .groupBy("account_id").agg(F.sum("n").cast("long").alias("monthly_events")))
    return (accounts.join(bot_count, "account_id", "left").join(events, "account_id", "left")
            .select("account_id",
                    F.coalesce("total_bots", F.lit(0).cast("long")).alias("total_bots"),
                    F.coalesce("monthly_events", F.lit(0).cast("long")).alias("monthly_events")))


def account_summary(t: Tables, as_of, owners=None) -> DataFrame:
    """Q20: account, its plan limits and its usage."""
    spark = t.accounts.sparkSession
    plans = F.broadcast(plan_catalogue(spark).select(
        "plan", "max_bots", F.col("monthly_events").alias("monthly_event_limit")))
    acc = _restrict_owner(t.accounts, owners, "id")
    return (acc.join(plans, "plan", "left")
            .join(account_usage(t, as_of, owners), acc.id == F.col("account_id"), "left")
            .select(F.col("id").alias("account_id"), "email", "name", "plan", "max_bots",
                    "monthly_event_limit",
                    F.coalesce("total_bots", F.lit(0).cast("long")).alias("total_bots"),
                    F.coalesce("monthly_events", F.lit(0).cast("long")).alias("monthly_events")))


def owner_bots(t: Tables, as_of, owners=None, ordered: bool = False) -> DataFrame:
    """Q21: every bot of each owner with users, messages and month revenue."""
    c = _clock(as_of)
    bots = _restrict_owner(t.bots, owners, "owner_account_id")
    users = t.users.groupBy("bot_id").agg(F.count(F.lit(1)).alias("total_users"))
    msgs = t.messages.groupBy("bot_id").agg(F.count(F.lit(1)).alias("total_messages"))
    rev = t.payments.groupBy("bot_id").agg(
        F.sum(F.when(F.col("created_at") >= ts_lit(c.month_start), F.col("amount")))
         .alias("revenue_this_month"))
    out = (bots.withColumnRenamed("id", "bot_id")
           .join(users, "bot_id", "left").join(msgs, "bot_id", "left").join(rev, "bot_id", "left")
           .select("owner_account_id", "bot_id",
                   X.display_name("display_name", "bot_type", "bot_identifier").alias("display_name"),
                   "bot_type", "verification_status", "tracking_status",
                   X.iso_text("connected_at").alias("connected_at"),
                   F.coalesce("total_users", F.lit(0).cast("long")).alias("total_users"),
                   F.coalesce("total_messages", F.lit(0).cast("long")).alias("total_messages"),
                   F.coalesce("revenue_this_month", F.lit(0).cast("decimal(22,2)"))
                    .alias("revenue_this_month")))
    if ordered:
        out = out.orderBy("owner_account_id", F.col("connected_at").desc())
    return out


def current_subscription(subscriptions: DataFrame) -> DataFrame:
    """Q22: newest row by updated_at per account (status is not filtered)."""
    latest = subscriptions.groupBy("account_id").agg(
        F.max_by(F.struct(*subscriptions.columns), F.struct("updated_at", "id")).alias("s"))
    return latest.select("s.*")


def lookup_bots(bots: DataFrame, keys: DataFrame) -> DataFrame:
    """Q24: batch lookup of bots by any unique key combination.

    ``keys`` holds one of (owner_account_id, bot_type, bot_identifier),
    (id) or (id, owner_account_id); the lookup is an inner equi-join.
    """
    on = [c for c in ("id", "owner_account_id", "bot_type", "bot_identifier") if c in keys.columns]
    return bots.join(keys.select(on).distinct(), on, "inner")


def lookup_accounts(accounts: DataFrame, keys: DataFrame) -> DataFrame:
    """Q25: batch lookup of accounts by api_key_hash or by id."""
    on = [c for c in ("id", "api_key_hash") if c in keys.columns]
    return accounts.join(keys.select(on).distinct(), on, "inner")
