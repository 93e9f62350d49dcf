"""One micro-batch of raw events -> facts, state deltas, rejections.

Order of checks per API event follows the reference's request path:
API key (I5) -> monthly quota (I8) -> body validation (I1-I3) -> bot
find-or-create (I6) -> date parse / numeric range -> writes (I9-I13).
A bad date is detected after the bot was resolved, so it still creates or
touches the bot, as in the reference.

The batch is all-or-nothing at the storage level: the caller writes every
output under the batch id and the batch's own row last
(``botlens.sources.sink``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlens.functions.clock import Clock, date_lit
from botlens.functions.sequential import CHUNK
from botlens.operators import accounts as A
from botlens.operators import bots as BO
from botlens.operators import ingest as I
from botlens.operators.validate import MSG_DATE, check_api_events, parse_event_time
from botlens.schemas import conform
from botlens.session import stage
from botlens.sources.tables import Tables

REJECTED_COLS = ["source", "ingest_seq", "received_at", "kind", "body",
                 "error_code", "error_field", "error_detail"]


@dataclass
class Secrets:
    api_key: str
    token: str


@dataclass
class IngestOutput:
    facts: dict = field(default_factory=dict)      # table -> rows to append
    users_delta: DataFrame | None = None           # mergeable users rows
    bots: DataFrame | None = None                  # full bots state
    rejected: DataFrame | None = None
    staged: list[str] = field(default_factory=list)  # folders to remove once the outputs are written


def _rejected(df: DataFrame, source: str) -> DataFrame:
    cols = []
    for c in REJECTED_COLS:
        if c == "source":
            cols.append(F.lit(source).alias("source"))
        elif c in df.columns:
            cols.append(F.col(c).cast("timestamp" if c == "received_at" else
                                      "long" if c == "ingest_seq" else "string").alias(c))
        else:
            cols.append(F.lit(None).cast("string").alias(c))
    return df.select(cols)


def _facts(events: DataFrame) -> dict:
    """events: bot_id, kind, telegram_id, profile, text, amount, currency,
    created_at, source, seq, sub_seq."""
    return {
        "messages": I.derive_messages(events),
        "payments": I.derive_payments(events),
        "bot_health_logs": I.derive_health_logs(events),
        "activity_logs": I.derive_activity_logs(events),
    }


def _users_delta(events: DataFrame) -> DataFrame:
    """Mergeable users rows.  The events of one input row are ordered by
    ``sub_seq`` here, so the merged state needs only the row's own number."""
    first = events.groupBy("bot_id", "telegram_id").agg(
        F.min(F.struct("seq", "sub_seq", "created_at")).alias("first"),
        F.max(F.struct("seq", "sub_seq", "username", "first_name", "last_name")).alias("last"),
        F.max("created_at").alias("last_active_at"))
    return conform(first.select(
        I.user_id_of("bot_id", "telegram_id").alias("id"), "bot_id", "telegram_id", "last.username",
        "last.first_name", "last.last_name", "first.created_at", "last_active_at",
        F.col("first.seq").alias("first_seq"), F.col("last.seq").alias("last_seq")), "users")


ERRORS = ["error_code", "error_field", "error_detail"]


def usage_by_month(raw: DataFrame, usage_at) -> DataFrame:
    """(account_id, month, monthly_events) for each month in which rows of ``raw`` arrived;
    ``usage_at`` gives the usage at a point in time.  A batch spans few months."""
    months = sorted(r.m for r in raw.select(F.trunc("received_at", "MM").alias("m"))
                    .filter("m is not null").distinct().collect())
    parts = [usage_at(Clock.at(m)).withColumn("month", date_lit(m)) for m in months]
    return reduce(DataFrame.unionByName, parts) if parts else \
        usage_at(Clock.at("1970-01-01")).withColumn("month", F.lit(None).cast("date")).limit(0)


def ingest_api_batch(raw: DataFrame, state: Tables, secrets: Secrets, chunk: int = CHUNK,
                     usage_at=None, plan_changes: DataFrame | None = None) -> IngestOutput:
    """raw: kind, api_key, body, ingest_seq, received_at.

    The quota is that of the month an event arrives in.  ``usage_at`` (clock ->
    account_id, monthly_events before the batch) defaults to the activity facts
    (Q19); a streaming job passes the daily rollup's.  ``plan_changes``
    (owner_account_id, ingest_seq, plan) count from their place in the arrival
    order on; without them the plans at batch start hold.  Typed rows are staged
    without the body; rejected rows get theirs back by ``ingest_seq``.
    """
    staged: list[str] = []
    # validation reads nothing but the row: it runs where the bodies lie, before any shuffle
    checked = check_api_events(raw).drop("body")
    created = parse_event_time(F.col("created_at_text"), F.col("received_at"))
    post_err = (F.when(created.isNull(), F.lit("createdAt"))
                 .when((F.col("kind") == "payment") & F.col("amount").isNull(), F.lit("amount")))
    checked = stage(checked.withColumn("created_at", created).withColumn("_post", post_err), "api-checked", staged)
    owned, _ = I.resolve_owners(checked, state.accounts, secrets.api_key, keep_unknown=True)
    counts = F.col("owner_account_id").isNotNull() & F.col("error_code").isNull() & F.col("_post").isNull() \
        & (F.col("created_at") >= F.trunc("received_at", "MM"))
    usage = usage_by_month(checked, usage_at or (lambda c: A.account_usage(state, c)))
    owned = owned.drop("api_key")
    with_owner = owned.filter(F.col("owner_account_id").isNotNull())
    limited = I.decide_event_quota(with_owner, usage, counts, chunk=chunk) if plan_changes is None else \
        I.decide_event_quota_as_of(with_owner, usage, plan_changes, counts, chunk=chunk)
    # the first of: unknown key, quota, body
    over = {"error_code": F.lit("PLAN_LIMIT_REACHED"), "error_field": F.lit("monthlyEvents"),
            "error_detail": I.quota_detail()}
    limited = limited.withColumns({n: F.when(F.col("_ok"), F.col(n)).otherwise(over[n]) for n in ERRORS})
    unknown = owned.filter(F.col("owner_account_id").isNull()).withColumns({
        "error_code": F.lit("INVALID_API_KEY"), "error_field": F.lit("api_key"), "error_detail": F.lit("Invalid API key")})
    decided = stage(limited.drop("_limit", "_ok", "_used").unionByName(unknown), "api-decided", staged)
    to_resolve = decided.filter(F.col("error_code").isNull()).drop(*ERRORS)
    resolved, bots, rej_conflict = BO.resolve_bots(to_resolve, state.bots, secrets.token)
    resolved = stage(resolved, "api-resolved", staged)   # feeds every output below
    bad_post = resolved.filter(F.col("_post").isNotNull()).select(
        "ingest_seq", F.lit("VALIDATION_ERROR").alias("error_code"), F.col("_post").alias("error_field"),
        F.when(F.col("_post") == "createdAt", F.lit(MSG_DATE))
         .otherwise(F.lit("numeric field overflow")).alias("error_detail"))
    good = resolved.filter(F.col("_post").isNull()).select(
        "*", F.lit("api").alias("source"), F.col("ingest_seq").alias("seq"), F.lit(0).alias("sub_seq"))
    errors = [bad_post] + [df.select("ingest_seq", *ERRORS) for df in (
        decided.filter(F.col("error_code").isNotNull()), rej_conflict)]
    refused = stage(reduce(DataFrame.unionByName, errors), "api-refused", staged)
    return IngestOutput(facts=_facts(good), users_delta=_users_delta(good), bots=bots,
                        rejected=_rejected(raw.join(refused, "ingest_seq"), "api"), staged=staged)


def ingest_platform_batch(raw: DataFrame, state: Tables) -> IngestOutput:
    """raw: bot_id, body, ingest_seq, received_at (platform updates).

    Platform updates are not quota-limited and need no owner; an unknown
    bot id is BOT_NOT_FOUND (checked before the body).  The bot state is unchanged.
    """
    known = state.bots.select(F.col("id").alias("bot_id"))
    missing = raw.join(known, "bot_id", "left_anti").select(
        "*", F.lit("BOT_NOT_FOUND").alias("error_code"),
        F.lit("botId").alias("error_field"), F.lit("Bot not found").alias("error_detail"))
    events, malformed = I.flatten_telegram_updates(raw.join(known, "bot_id", "left_semi"))
    good = events.select(
        "*", F.lit("platform").alias("source"), F.col("ingest_seq").alias("seq"),
        F.lit(None).cast("decimal(12,2)").alias("amount"), F.lit(None).cast("string").alias("currency"))
    return IngestOutput(facts=_facts(good), users_delta=_users_delta(good), bots=state.bots,
                        rejected=_rejected(missing, "platform").unionByName(_rejected(malformed, "platform")))
