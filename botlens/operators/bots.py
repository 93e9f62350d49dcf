"""Bot identity, lifecycle and token protection.

Bot identities in a batch are reduced to one row per (owner, type,
identifier) and stretch of the arrival order before they meet the ``bots``
state, so that join's input is far smaller than the events, and the events of
a hot bot meet their bot by stretches, not in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from botlens.functions import exprs as X
from botlens.operators.ingest import stable_id
from botlens.schemas import conform, plan_catalogue


STRETCH = 1 << 17         # arrivals of a stretch


def bot_identifier(bot_type, bot_value, token_secret: str):
    """Token bots are keyed by HMAC(token); username bots by F5."""
    return F.when(X.col_(bot_type) == "token", X.hmac_sha256_hex(bot_value, token_secret)) \
            .otherwise(X.normalize_username(bot_value))


def new_bot_id(bot_type, identifier):
    return stable_id(F.lit("bot"), X.col_(bot_type), X.col_(identifier))


def _input_display_name(bot_type, identifier):
    """``identifier``: the normalized name of a username bot."""
    return F.when(X.col_(bot_type) == "username", F.concat(F.lit("@"), X.col_(identifier))) \
            .otherwise(F.lit(X.GENERIC_BOT_NAME))


def resolve_bots(events: DataFrame, bots: DataFrame, token_secret: str,
                 seq_col: str = "ingest_seq"):
    """Find or create the bot of each event -> (events, bots, rejected).

    Existing bot of the same owner: ``connected_at`` moves to the last
    arrival.  Unknown identity: a bot is created (first arrival wins its
    ``created_at``, last arrival its ``connected_at``).  The identity is
    globally unique, so an identity held by another owner, or created in the
    same batch by an earlier owner, is a ``BOT_CONFLICT``.
    """
    identity = ["owner_account_id", "bot_type", "bot_identifier"]
    ev = events.withColumn("bot_identifier", bot_identifier("bot_type", "bot_value", token_secret)) \
        .withColumn("_part", F.coalesce(F.floor(F.col(seq_col) / F.lit(STRETCH)), F.lit(-1).cast("long")))
    whole = Window.partitionBy(*identity)
    # fixed-width sums only, so that Spark aggregates by hash; every row has the values of its whole identity
    ident = ev.groupBy(*identity, "_part").agg(
        F.min(seq_col).alias("_first_seq"), F.min("received_at").alias("_first_at"),
        F.max("received_at").alias("_last_at")).select(
        *identity, "_part", (F.col("_part") == F.min("_part").over(whole)).alias("_once"),
        F.min("_first_seq").over(whole).alias("_first_seq"), F.min("_first_at").over(whole).alias("_first_at"),
        F.max("_last_at").over(whole).alias("_last_at"))
    known = bots.select(F.col("id").alias("_known_id"), F.col("owner_account_id").alias("_known_owner"),
                        "bot_type", "bot_identifier")
    matched = ident.join(known, ["bot_type", "bot_identifier"], "left")
    first_owner = Window.partitionBy("bot_type", "bot_identifier").orderBy("_first_seq")
    decided = (matched
               .withColumn("_winner", F.first("owner_account_id").over(first_owner))
               .withColumn("_status",
                           F.when(F.col("_known_id").isNotNull(),
                                  F.when(F.col("_known_owner") == F.col("owner_account_id"), "hit")
                                   .otherwise("conflict"))
                            .when(F.col("_winner") == F.col("owner_account_id"), "new")
                            .otherwise("conflict"))
               .withColumn("bot_id", F.when(F.col("_status") == "hit", F.col("_known_id"))
                           .when(F.col("_status") == "new",
                                 new_bot_id("bot_type", "bot_identifier"))))
    touched = decided.filter((F.col("_status") == "hit") & F.col("_once")).select(
        F.col("bot_id").alias("id"), F.col("_last_at").alias("_touch_at"))
    created = decided.filter((F.col("_status") == "new") & F.col("_once")).select(
        F.col("bot_id").alias("id"), "owner_account_id", "bot_identifier", "bot_type",
        _input_display_name("bot_type", "bot_identifier").alias("display_name"),
        F.lit(None).cast("string").alias("telegram_bot_id"),
        F.lit(None).cast("string").alias("encrypted_token"),
        F.lit("pending").alias("verification_status"), F.lit("disabled").alias("tracking_status"),
        F.lit("pending").alias("webhook_status"), F.col("_last_at").alias("connected_at"),
        F.lit(None).cast("timestamp").alias("verified_at"),
        F.lit(None).cast("timestamp").alias("tracking_enabled_at"),
        F.col("_first_at").alias("created_at"), F.col("_last_at").alias("updated_at"))
    updated = (bots.join(touched, "id", "left")
               .withColumn("connected_at", F.coalesce(F.greatest("connected_at", "_touch_at"),
                                                      F.col("connected_at")))
               .withColumn("updated_at", F.coalesce(F.greatest("updated_at", "_touch_at"),
                                                    F.col("updated_at")))
               .drop("_touch_at"))
    new_bots = conform(updated, "bots").unionByName(conform(created, "bots"))
    keyed = decided.select(*identity, "_part", "bot_id", "_status")
    joined = ev.join(keyed, [*identity, "_part"]).drop("_part")
    ok = joined.filter(F.col("_status") != "conflict").drop("_status")
    rejected = joined.filter(F.col("_status") == "conflict").select(
        *events.columns, F.lit("BOT_CONFLICT").alias("error_code"),
        F.lit("botValue").alias("error_field"),
        F.lit("bot identity belongs to another account").alias("error_detail"))
    return ok, new_bots, rejected


def enforce_bot_cap(connects: DataFrame, bots: DataFrame, accounts: DataFrame,
                    token_secret: str, seq_col: str = "ingest_seq"):
    """I7: "connect" requests may create a bot only below the plan's cap.

    Known identities always pass.  New identities of an owner are ranked by
    first arrival; the k-th new one passes iff current bots + k <= max_bots.
    An identity that another owner holds, or creates earlier in the batch, takes
    no slot: it passes while a slot is left and is refused as a conflict when
    the bot is resolved.  A plan that the catalogue does not know allows none.
    Ranking runs over distinct identities (bounded by bots), not events.
    """
    identity = ["bot_type", "bot_identifier"]
    ev = connects.withColumn("bot_identifier",
                             bot_identifier("bot_type", "bot_value", token_secret))
    holders = bots.select(F.col("owner_account_id").alias("_holder"), *identity)
    ident = ev.groupBy("owner_account_id", *identity).agg(
        F.min(seq_col).alias("_first_seq")).join(holders, identity, "left")
    winners = ident.filter(F.col("_holder").isNull()).groupBy(*identity).agg(
        F.min(F.struct("_first_seq", "owner_account_id"))["owner_account_id"].alias("_winner"))
    counts = bots.groupBy("owner_account_id").agg(F.count(F.lit(1)).alias("_have"))
    caps = F.broadcast(plan_catalogue(connects.sparkSession).select("plan", "max_bots"))
    plans = accounts.select(F.col("id").alias("owner_account_id"), "plan").join(caps, "plan")
    before = Window.partitionBy("owner_account_id").orderBy("_first_seq").rowsBetween(
        Window.unboundedPreceding, -1)
    is_new = F.col("_holder").isNull() & (F.col("_winner") == F.col("owner_account_id"))
    have = F.coalesce(F.col("_have"), F.lit(0))
    new = (ident.join(winners, identity, "left")
           .filter(F.coalesce(F.col("_holder") != F.col("owner_account_id"), F.lit(True)))
           .withColumn("_new_before", F.coalesce(F.sum(F.when(is_new, 1).otherwise(0)).over(before), F.lit(0)))
           .join(counts, "owner_account_id", "left").join(plans, "owner_account_id", "left")
           .select("owner_account_id", *identity, F.coalesce(
               have + F.col("_new_before") < F.col("max_bots"), F.lit(False)).alias("_allowed")))
    decided = ev.join(new, ["owner_account_id", *identity], "left") \
        .withColumn("_allowed", F.coalesce("_allowed", F.lit(True)))
    ok = decided.filter("_allowed").drop("_allowed")
    rejected = decided.filter(~F.col("_allowed")).select(
        *connects.columns, F.lit("PLAN_LIMIT_REACHED").alias("error_code"),
        F.lit("maxBots").alias("error_field"), F.lit("Plan bot limit reached").alias("error_detail"))
    return ok, rejected


# --- I19 ------------------------------------------------------------------------------

def apply_bot_changes(bots: DataFrame, changes: DataFrame, seq_col: str = "ingest_seq"):
    """Verification / credentials / tracking change log -> (bots, rejected).

    ``changes``: bot_id, change ('verify' | 'credentials' | 'track'),
    token_ok (bool, token shape for token bots), display_name,
    telegram_bot_id, encrypted_token, received_at, ingest_seq.
    Rules: unknown bot -> BOT_NOT_FOUND; token of the wrong shape ->
    INVALID_TOKEN; a username bot without display name cannot verify;
    tracking needs the bot verified by then (state or earlier change).
    """
    cur = bots.select(F.col("id").alias("bot_id"), "bot_type",
                      F.col("display_name").alias("_cur_name"),
                      F.col("encrypted_token").alias("_cur_token"),
                      F.col("verification_status").alias("_cur_status"))
    ch = changes.join(cur, "bot_id", "left")
    is_verify = F.col("change").isin("verify", "credentials")
    err = (F.when(F.col("bot_type").isNull(), F.struct(F.lit("BOT_NOT_FOUND").alias("code"),
                                                        F.lit("Bot not found").alias("detail")))
           .when(is_verify & (F.col("bot_type") == "token") & ~F.coalesce("token_ok", F.lit(False)),
                 F.struct(F.lit("INVALID_TOKEN").alias("code"), F.lit("Invalid bot token").alias("detail")))
           .when((F.col("change") == "verify") & (F.col("bot_type") == "username")
                 & F.col("_cur_name").isNull(),
                 F.struct(F.lit("VERIFICATION_FAILED").alias("code"),
                          F.lit("Verification failed").alias("detail"))))
    ch = ch.withColumn("_err", err)
    # a bot stays verified, so "verified by then" is: in state, or after its first accepted verify
    firsts = ch.filter(F.col("_err").isNull() & is_verify).groupBy("bot_id").agg(
        F.min(seq_col).alias("_verified_seq"),
        F.min(F.when(F.col("encrypted_token").isNotNull(), F.col(seq_col))).alias("_token_seq"))
    ch = ch.join(firsts, "bot_id", "left")
    verified = (F.col("_cur_status") == "verified") | (F.col("_verified_seq") < F.col(seq_col))
    known = F.col("change").isin("verify", "credentials", "track")
    ch = ch.withColumn("_err", F.coalesce(
        "_err",
        F.when(~F.coalesce(known, F.lit(False)),
               F.struct(F.lit("VALIDATION_ERROR").alias("code"), F.lit("Unknown change").alias("detail"))),
        F.when((F.col("change") == "track") & ~F.coalesce(verified, F.lit(False)),
               F.struct(F.lit("VERIFICATION_FAILED").alias("code"),
                        F.lit("Verification failed").alias("detail")))))
    ok = ch.filter(F.col("_err").isNull())
    rejected = ch.filter(F.col("_err").isNotNull()).select(
        *changes.columns, F.col("_err.code").alias("error_code"), F.lit("bot").alias("error_field"),
        F.col("_err.detail").alias("error_detail"))
    last_verify = ok.filter(is_verify).groupBy("bot_id").agg(F.max_by(F.struct(
        "change", "display_name", "telegram_bot_id", "encrypted_token", "received_at"), seq_col)
        .alias("v"))
    any_token = ok.filter(F.col("change") == "credentials").groupBy("bot_id").agg(
        F.max_by("encrypted_token", seq_col).alias("_new_token"))
    # the webhook is set up when tracking is enabled, with the token the bot has then
    has_token = F.col("_cur_token").isNotNull() | F.coalesce(F.col("_token_seq") < F.col(seq_col), F.lit(False))
    last_track = ok.filter(F.col("change") == "track").groupBy("bot_id").agg(F.max_by(F.struct(
        F.col("received_at").alias("at"), has_token.alias("hooked")), seq_col).alias("t"))
    last_any = ok.groupBy("bot_id").agg(F.max_by("received_at", seq_col).alias("_touch"))
    b = (bots.withColumnRenamed("id", "bot_id")
         .join(last_verify, "bot_id", "left").join(any_token, "bot_id", "left")
         .join(last_track, "bot_id", "left").join(last_any, "bot_id", "left"))
    creds = F.col("v.change") == "credentials"
    token_now = F.coalesce("_new_token", "encrypted_token")
    out = b.select(
        F.col("bot_id").alias("id"), "owner_account_id", "bot_identifier", "bot_type",
        F.when(creds, F.col("v.display_name")).otherwise(F.col("display_name")).alias("display_name"),
        F.when(creds, F.col("v.telegram_bot_id")).otherwise(F.col("telegram_bot_id")).alias("telegram_bot_id"),
        token_now.alias("encrypted_token"),
        F.when(F.col("v").isNotNull(), F.lit("verified")).otherwise(F.col("verification_status"))
         .alias("verification_status"),
        F.when(F.col("t").isNotNull(), F.lit("enabled")).otherwise(F.col("tracking_status"))
         .alias("tracking_status"),
        F.when(F.col("t").isNotNull(), F.when(F.col("t.hooked"), "enabled").otherwise("pending"))
         .otherwise(F.col("webhook_status")).alias("webhook_status"),
        "connected_at",
        F.coalesce(F.col("v.received_at"), F.col("verified_at")).alias("verified_at"),
        F.coalesce(F.col("t.at"), F.col("tracking_enabled_at")).alias("tracking_enabled_at"),
        "created_at", F.coalesce(F.col("_touch"), F.col("updated_at")).alias("updated_at"))
    return conform(out, "bots"), rejected


# --- I21 ------------------------------------------------------------------------------

def _key(secret: str):
    return F.unhex(F.sha2(F.lit(secret), 256))


def _bind(value, fn):
    """Evaluate ``value`` once and apply ``fn`` to it (a lambda variable is
    bound per row, so a random IV is not re-drawn per reference)."""
    return F.transform(F.array(value), fn)[0]


def protect_tokens(df: DataFrame, col: str, secret: str, out: str | None = None) -> DataFrame:
    """AES-256-GCM, key = SHA-256(secret); text ``iv:tag:cipher``
    in base64 (Spark's output is iv || cipher || tag, re-arranged)."""
    blob = F.aes_encrypt(F.encode(F.col(col), "UTF-8"), _key(secret), F.lit("GCM"))

    def text(b):
        n = F.length(b)
        return F.concat_ws(":", F.base64(F.substring(b, 1, 12)),
                           F.base64(F.substring(b, n - 15, 16)),
                           F.base64(F.substring(b, 13, n - 28)))
    return df.withColumn(out or col, F.when(F.col(col).isNotNull(), _bind(blob, text)))


def reveal_tokens(df: DataFrame, col: str, secret: str, out: str | None = None) -> DataFrame:
    """Inverse of ``protect_tokens``; malformed or forged text -> null."""
    def opened(parts):
        blob = F.concat(F.unbase64(parts[0]), F.unbase64(parts[2]), F.unbase64(parts[1]))
        plain = F.try_aes_decrypt(blob, _key(secret), F.lit("GCM"))
        return F.when(F.size(parts) == 3, F.decode(plain, "UTF-8"))
    return df.withColumn(out or col, _bind(F.split(F.col(col), ":"), opened))
