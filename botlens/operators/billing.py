"""Billing notifications and account state.

All state updates are keyed reduces over ``state ∪ batch`` with the batch
ordered by ``ingest_seq`` (state rows sort before every batch row), so a
retried or split batch converges to the same state.  The price book is a
2-row literal and always broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botlens.functions import exprs as X
from botlens.functions.sequential import last_non_null
from botlens.operators.ingest import stable_id
from botlens.functions.dates import parse_js_date
from botlens.operators.validate import check_billing_events, split_checked
from botlens.session import stage
from botlens.schemas import ACTIVE_SUBSCRIPTION_STATUSES, PLANS, TABLE_SCHEMAS, conform, plan_catalogue
from botlens.sources.tables import Tables

STATE_SEQ = -1


def accept_billing_events(raw: DataFrame, accounts: DataFrame, staged: list[str] | None = None):
    """I14 + account lookup + date / amount checks -> (accepted, rejected).

    Order as in the reference: body validation, unknown account
    (ACCOUNT_NOT_FOUND), then inside the transaction the period dates and
    the NUMERIC(12,2) amount (negative or too large rolls everything back).
    """
    checked = stage(check_billing_events(raw), "billing-checked", staged)
    valid, rej_body = split_checked(checked, raw.columns)
    known = accounts.select(F.col("id").alias("account_id"), F.lit(True).alias("_known"))
    v = valid.join(known, "account_id", "left")
    # an empty text is no date, as null
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    start, end = parse_js_date(given("period_start_text")), parse_js_date(given("period_end_text"))
    err = (F.when(F.col("_known").isNull(),
                  F.struct(F.lit("ACCOUNT_NOT_FOUND").alias("code"), F.lit("accountId").alias("field"),
                           F.lit("Account not found").alias("detail")))
            .when((given("period_start_text").isNotNull() & start.isNull())
                  | (given("period_end_text").isNotNull() & end.isNull()),
                  F.struct(F.lit("VALIDATION_ERROR").alias("code"), F.lit("currentPeriod").alias("field"),
                           F.lit("Invalid billing date").alias("detail")))
            .when(F.col("amount_raw").isNotNull()
                  & (F.col("amount").isNull() | (F.col("amount_raw") < 0)),
                  F.struct(F.lit("INTERNAL_ERROR").alias("code"), F.lit("amount").alias("field"),
                           F.lit("amount out of range").alias("detail"))))
    v = v.withColumn("_err", err).withColumn("current_period_start", start) \
         .withColumn("current_period_end", end)
    accepted = v.filter(F.col("_err").isNull()).drop("_err", "_known")
    rej_more = v.filter(F.col("_err").isNotNull()).select(
        *raw.columns, F.col("_err.code").alias("error_code"), F.col("_err.field").alias("error_field"),
        F.col("_err.detail").alias("error_detail"))
    return accepted, rej_body.unionByName(rej_more)


BILLING_DELTA = T.StructType([*TABLE_SCHEMAS["billing_events"].fields,
                              T.StructField("first_seq", T.LongType()), T.StructField("last_seq", T.LongType())])


def billing_delta(batch: DataFrame, seq_col: str = "ingest_seq") -> DataFrame:
    """Mergeable billing event rows of one batch: one for each delivery, to be merged."""
    return batch.select(
        stable_id(F.lit("billing"), F.col("provider"), F.col("provider_event_id")).alias("id"),
        "account_id", "provider", "provider_event_id", "event_type", "payload",
        F.col("received_at").alias("processed_at"), F.col("received_at").alias("created_at"),
        F.col(seq_col).cast("long").alias("first_seq"), F.col(seq_col).cast("long").alias("last_seq"))


def merge_billing_events(state: DataFrame | None, delta: DataFrame, delta_out: bool = False) -> DataFrame:
    """Key (provider, provider_event_id); the last delivery sets payload,
    event_type and processed_at; id, account_id and created_at stay first.
    State rows come before every delta row.  With ``delta_out`` the sequence
    numbers are kept, so that the result is a delta again."""
    rows = delta
    if state is not None:
        old = conform(state, "billing_events").withColumns({
            "first_seq": F.lit(STATE_SEQ).cast("long"), "last_seq": F.lit(STATE_SEQ).cast("long")})
        rows = old.unionByName(delta)
    merged = rows.groupBy("provider", "provider_event_id").agg(
        F.min_by(F.struct("id", "account_id", "created_at"), "first_seq").alias("f"),
        F.max_by(F.struct("event_type", "payload", "processed_at"), "last_seq").alias("l"),
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq")).select("*", "f.*", "l.*")
    return merged.select(*BILLING_DELTA.fieldNames()) if delta_out else conform(merged, "billing_events")


def upsert_billing_events(state: DataFrame, batch: DataFrame, seq_col: str = "ingest_seq") -> DataFrame:
    """I15 for one batch of accepted notifications."""
    return merge_billing_events(state, billing_delta(batch, seq_col))


def resolve_customer_ids(batch: DataFrame, accounts: DataFrame, seq_col: str = "ingest_seq") -> DataFrame:
    """Customer id per event: given, else the account's (as updated by the
    earlier events of the batch), else a new id that then sticks."""
    acc = accounts.select(F.col("id").alias("account_id"),
                          F.col("billing_provider_customer_id").alias("_acct_cust"))
    b = batch.join(acc, "account_id", "left")
    b = last_non_null(b, ["account_id"], seq_col, "provider_customer_id", "_given_so_far")
    # one row an account, by a partial aggregation: an account's events are not gathered in one task
    b = b.join(batch.groupBy("account_id").agg(F.min(seq_col).alias("_first_seq")), "account_id")
    fresh = F.concat(F.lit("cust_"), stable_id(F.lit("cust"), F.col("account_id"), F.col("_first_seq").cast("string")))
    return b.withColumn("resolved_customer_id",
                        F.coalesce("_given_so_far", "_acct_cust", fresh)).drop("_given_so_far", "_acct_cust", "_first_seq")


def upsert_subscriptions(state: DataFrame, accounts: DataFrame, batch: DataFrame,
                         seq_col: str = "ingest_seq") -> DataFrame:
    """I16: one subscription per account; the last arrival wins every field
    (a redelivered event is applied again).  Amount and currency default
    from the price book."""
    spark = batch.sparkSession
    prices = F.broadcast(plan_catalogue(spark).select(
        "plan", F.col("price_monthly").alias("_price"), F.col("currency").alias("_price_cur")))
    b = resolve_customer_ids(batch, accounts, seq_col).join(prices, "plan", "left")
    rows = b.select(
        stable_id(F.lit("sub"), F.col("account_id")).alias("id"), "account_id", "provider",
        F.col("resolved_customer_id").alias("provider_customer_id"),
        "provider_subscription_id", "plan", "status",
        F.coalesce("amount", "_price").cast("decimal(12,2)").alias("amount_monthly"),
        F.upper(F.coalesce("currency", "_price_cur")).alias("currency"),
        "current_period_start", "current_period_end",
        (F.col("event_type") == "subscription.canceled").alias("cancel_at_period_end"),
        F.col("received_at").alias("created_at"), F.col("received_at").alias("updated_at"),
        F.col(seq_col).cast("long").alias("_seq"))
    allr = conform(state, "subscriptions").withColumn("_seq", F.lit(STATE_SEQ).cast("long")) \
        .unionByName(rows)
    fields = [c for c in conform(state, "subscriptions").columns
              if c not in ("id", "account_id", "created_at")]
    merged = allr.groupBy("account_id").agg(
        F.min_by("id", "_seq").alias("id"), F.min_by("created_at", "_seq").alias("created_at"),
        F.max_by(F.struct(*fields), "_seq").alias("s"))
    return conform(merged.select("id", "account_id", "created_at", "s.*"), "subscriptions")


def project_account_plan(accounts: DataFrame, batch: DataFrame, seq_col: str = "ingest_seq") -> DataFrame:
    """plan = webhook plan if status is active/trialing else starter;
    the customer id is stored; the last event per account wins."""
    b = resolve_customer_ids(batch, accounts, seq_col)
    plan = F.when(F.col("status").isin(ACTIVE_SUBSCRIPTION_STATUSES), F.col("plan")) \
        .otherwise(F.lit("starter"))
    last = b.groupBy("account_id").agg(F.max_by(F.struct(
        plan.alias("_plan"), F.col("resolved_customer_id").alias("_cust"),
        F.col("received_at").alias("_at")), seq_col).alias("l"))
    a = accounts.join(last, accounts.id == last.account_id, "left")
    return conform(a.select(
        "id", "email", "name", "api_key_hash",
        F.coalesce("l._cust", "billing_provider_customer_id").alias("billing_provider_customer_id"),
        F.coalesce("l._plan", "plan").alias("plan"), "created_at",
        F.coalesce("l._at", "updated_at").alias("updated_at")), "accounts")


def apply_billing_batch(raw: DataFrame, state: Tables, staged: list[str] | None = None):
    """I14-I17 for one batch -> (billing delta, subscriptions, accounts, rejected)."""
    accepted, rejected = accept_billing_events(raw, state.accounts, staged)
    accepted = stage(accepted, "billing-accepted", staged)
    subs = upsert_subscriptions(state.get_or_empty(raw.sparkSession, "subscriptions"), state.accounts, accepted)
    accounts = project_account_plan(state.accounts, accepted)
    return merge_billing_events(None, billing_delta(accepted), delta_out=True), subs, accounts, rejected


# --- I18 --------------------------------------------------------------------------------

def _text_errors(col: str, field: str, limit: int, optional: bool = False):
    """First failing rule of a required (or optional) text, as struct(code, field, detail), else null."""
    text, value = X.js_trim(col), F.col(col)
    bad = lambda detail: F.struct(F.lit("VALIDATION_ERROR").alias("code"), F.lit(field).alias("field"),
                                  F.lit(detail).alias("detail"))
    missing = F.lit(False) if optional else value.isNull()
    return (F.when(missing, bad("must be a string")).when(X.utf16_length(text) == 0, bad("must not be empty"))
            .when(X.utf16_length(text) > limit, bad(f"must be at most {limit} characters")))


def apply_account_changes(accounts: DataFrame, changes: DataFrame, seq_col: str = "ingest_seq"):
    """Account creation and direct plan changes from a change log.

    ``changes``: change ('create' | 'plan'), email, name, api_key_hash,
    account_id, plan, received_at, ingest_seq.  Emails are trimmed, lower-cased
    and unique (a second registration of an email is EMAIL_TAKEN), names
    trimmed; a plan must be known (VALIDATION_ERROR), the account too
    (ACCOUNT_NOT_FOUND; checked first, as the key is resolved before the
    body).  Any other change is a VALIDATION_ERROR.  Returns (accounts, rejected).
    """
    error = lambda code, field, detail: F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"),
                                                 F.lit(detail).alias("detail"))
    refuse = lambda df: df.filter(F.col("_err").isNotNull()).select(
        *changes.columns, F.col("_err.code").alias("error_code"), F.col("_err.field").alias("error_field"),
        F.col("_err.detail").alias("error_detail"))
    kind = F.coalesce(F.col("change"), F.lit(""))
    other = changes.filter(~kind.isin("create", "plan")).withColumn(
        "_err", error("VALIDATION_ERROR", "change", 'must be "create" or "plan"'))

    creates = changes.filter(kind == "create").select(
        "*", F.lower(X.js_trim("email")).alias("_email"), X.js_trim("name").alias("_name"),
        F.coalesce(_text_errors("email", "email", 255), _text_errors("name", "name", 255, optional=True)).alias("_bad"))
    existing = accounts.select(F.col("email").alias("_email"), F.lit(True).alias("_taken"))
    firsts = creates.filter(F.col("_bad").isNull()).groupBy("_email").agg(F.min(seq_col).alias("_first"))
    c = creates.join(existing, "_email", "left").join(firsts, "_email", "left").withColumn("_err", F.coalesce(
        "_bad", F.when(F.col("_taken").isNotNull() | (F.col(seq_col) != F.col("_first")),
                       error("EMAIL_TAKEN", "email", "email already registered"))))
    new_acc = c.filter(F.col("_err").isNull()).select(
        stable_id(F.lit("account"), F.col("_email")).alias("id"), F.col("_email").alias("email"),
        F.col("_name").alias("name"), "api_key_hash",
        F.lit(None).cast("string").alias("billing_provider_customer_id"),
        F.lit("starter").alias("plan"), F.col("received_at").alias("created_at"),
        F.col("received_at").alias("updated_at"))
    allacc = conform(accounts, "accounts").unionByName(conform(new_acc, "accounts"))

    plan = F.lower(X.js_trim("plan"))
    ids = allacc.select(F.col("id").alias("account_id"), F.lit(True).alias("_ok"))
    p = changes.filter(kind == "plan").join(ids, "account_id", "left").withColumn("_err", F.coalesce(
        F.when(F.col("_ok").isNull(), error("ACCOUNT_NOT_FOUND", "accountId", "Account not found")),
        _text_errors("plan", "plan", 20),
        F.when(~plan.isin(PLANS), error("VALIDATION_ERROR", "plan", 'must be "starter" or "growth"'))))
    last = p.filter(F.col("_err").isNull()).groupBy("account_id").agg(
        F.max_by(F.struct(plan.alias("_plan"), F.col("received_at").alias("_at")), seq_col).alias("l"))
    out = allacc.join(last, allacc.id == last.account_id, "left").select(
        "id", "email", "name", "api_key_hash", "billing_provider_customer_id",
        F.coalesce("l._plan", "plan").alias("plan"), "created_at",
        F.coalesce("l._at", "updated_at").alias("updated_at"))
    return conform(out, "accounts"), refuse(c).unionByName(refuse(p)).unionByName(refuse(other))
