"""Event ingestion operators.

Inputs carry ``ingest_seq`` (total arrival order) and ``received_at`` (the
reference's "now").  Every derived id is a function of the natural key or
of the sequence number, so re-running a batch yields identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botlens.functions import exprs as X
from botlens.functions.sequential import CHUNK, exclusive_running_sum, last_non_null
from botlens.operators.validate import MSG_BODY, NUMERIC_TYPE, parse_body
from botlens.schemas import conform, plan_catalogue

SENDER_SUB = (1 << 20) - 1      # the sender's message sorts after all joins

EVENT_LIST = ("array<struct<kind:string,sub_seq:int,telegram_id:string,username:string,first_name:string,"
              "last_name:string,text:string>>")
EPOCH_LIMIT = 8_640_000_000_000      # seconds from 1970 that a JavaScript date can hold


def stable_id(*parts: Column) -> Column:
    """UUID-shaped id from the md5 of the given parts."""
    h = F.md5(F.concat_ws("\u001f", *parts))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def user_id_of(bot_id, telegram_id) -> Column:
    """Users are keyed by (bot, telegram id); the id is derived from it so
    facts never need a join with the users state."""
    return stable_id(F.lit("user"), X.col_(bot_id), X.col_(telegram_id))


# --- I4 ------------------------------------------------------------------------------

def flatten_telegram_updates(raw: DataFrame, body_col: str = "body"):
    """I4: platform updates -> (events, rejected).

    One ``user_joined`` per non-bot new chat member (in array order), then
    one ``message`` from the sender if ``text`` is a JSON string (empty
    included).  Updates without ``message`` or ``message.from`` produce
    nothing, as in the reference.  An empty body is a VALIDATION_ERROR, text
    that is not JSON INVALID_JSON, and an update that would write rows without
    a usable date INTERNAL_ERROR.  ``sub_seq`` orders the events of one update.
    """
    v, json_ok = parse_body(F.col(body_col))
    b = raw.select("*", v.alias("_v"), json_ok.alias("_json_ok"))
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    type_of = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    has_from = F.coalesce(type_of("$.message.from") != "VOID", F.lit(False))
    seconds = get("$.message.date", "double")
    created = F.when(type_of("$.message.date").rlike(NUMERIC_TYPE) & seconds.between(-EPOCH_LIMIT, EPOCH_LIMIT),
                     F.timestamp_millis((seconds * 1000).cast("long")))
    members = F.coalesce(get("$.message.new_chat_members", "array<variant>"),
                         F.array().cast("array<variant>"))
    text_is_string = F.coalesce(type_of("$.message.text") == "STRING", F.lit(False))
    sender = F.struct(
        F.lit("message").alias("kind"),
        F.lit(SENDER_SUB).alias("sub_seq"),
        F.coalesce(get("$.message.from.id"), F.lit("undefined")).alias("telegram_id"),
        get("$.message.from.username").alias("username"),
        get("$.message.from.first_name").alias("first_name"),
        get("$.message.from.last_name").alias("last_name"),
        get("$.message.text").alias("text"))
    of = lambda m, path, kind="string": F.try_variant_get(m, path, kind)
    joins = F.transform(
        F.filter(F.transform(members, lambda m, i: F.struct(m.alias("m"), i.alias("i"))),
                 lambda x: ~F.coalesce(of(x["m"], "$.is_bot", "boolean"), F.lit(False))),
        lambda x: F.struct(
            F.lit("user_joined").alias("kind"), x["i"].alias("sub_seq"),
            # String(id): a number's or the text's own characters
            F.coalesce(of(x["m"], "$.id"), F.lit("undefined")).alias("telegram_id"),
            of(x["m"], "$.username").alias("username"),
            of(x["m"], "$.first_name").alias("first_name"), of(x["m"], "$.last_name").alias("last_name"),
            F.lit(None).cast("string").alias("text")))
    all_events = F.when(text_is_string, F.concat(joins, F.array(sender))).otherwise(joins)
    base_cols = [c for c in raw.columns if c != body_col]
    missing = F.col(body_col).isNull() | (F.col(body_col) == "")
    found = b.select(
        *raw.columns, created.alias("created_at"),
        F.when(has_from, all_events).otherwise(F.array().cast(EVENT_LIST)).alias("_events"),
        F.when(missing, F.lit("VALIDATION_ERROR")).when(~F.col("_json_ok"), F.lit("INVALID_JSON"))
         .when(F.schema_of_variant("_v") == "VOID", F.lit("INTERNAL_ERROR")).alias("_code"),
        # barrier: a filter on the error column is not pushed into the extraction
        F.spark_partition_id().alias("_task"))
    found = found.withColumn("_code", F.when(F.col("_task") >= 0, F.coalesce("_code", F.when(
        (F.size("_events") > 0) & F.col("created_at").isNull(), F.lit("DATE")))))
    rejected = found.filter(F.col("_code").isNotNull()).select(
        *raw.columns, F.when(F.col("_code") == "DATE", "INTERNAL_ERROR").otherwise(F.col("_code")).alias("error_code"),
        F.when(F.col("_code") == "DATE", "message.date").otherwise("body").alias("error_field"),
        F.when(F.col("_code") == "VALIDATION_ERROR", MSG_BODY).when(F.col("_code") == "INVALID_JSON", "Invalid JSON body")
         .when(F.col("_code") == "DATE", "must be a time in seconds").otherwise("body is null").alias("error_detail"))
    events = (found.filter(F.col("_code").isNull())
              .select(*base_cols, "created_at", F.explode("_events").alias("e"))
              .select(*base_cols, "created_at", "e.*"))
    return events, rejected


# --- I5 / I8 -------------------------------------------------------------------------

def resolve_owners(events: DataFrame, accounts: DataFrame, api_key_secret: str,
                   key_col: str = "api_key", keep_unknown: bool = False):
    """API key -> owning account; unknown keys are INVALID_API_KEY.

    With ``keep_unknown`` the first result holds all rows, those of unknown
    keys without an owner."""
    hashed = events.withColumn("_hash", X.hmac_sha256_hex(X.js_trim(F.col(key_col)),
                                                          api_key_secret))
    acc = accounts.select(F.col("api_key_hash").alias("_hash"),
                          F.col("id").alias("owner_account_id"), F.col("plan"))
    joined = hashed.join(acc, "_hash", "left").drop("_hash")
    ok = joined if keep_unknown else joined.filter(F.col("owner_account_id").isNotNull())
    rejected = joined.filter(F.col("owner_account_id").isNull()).select(
        *events.columns, F.lit("INVALID_API_KEY").alias("error_code"),
        F.lit(key_col).alias("error_field"), F.lit("Invalid API key").alias("error_detail"))
    return ok, rejected


def decide_event_quota(events: DataFrame, usage: DataFrame, counts: Column,
                       seq_col: str = "ingest_seq", chunk: int = CHUNK) -> DataFrame:
    """I8: every event with ``_ok`` (accepted), ``_used`` (the count it meets) and ``_limit``.

    ``usage`` is (account_id, monthly_events) at batch start (Q19), or with a
    column ``month`` one row per month; ``counts`` marks events that add an
    activity row dated in or after the month they arrive in.  An event is
    accepted iff base + (counting events of its arrival month before it) <
    limit; the count only grows, so this equals the one-at-a-time rule.  A plan
    that the catalogue does not know has no allowance: its events are rejected.
    """
    limits = F.broadcast(plan_catalogue(events.sparkSession)
                         .select("plan", F.col("monthly_events").alias("_limit")))
    by_month = "month" in usage.columns
    base = usage.select(F.col("account_id").alias("owner_account_id"),
                        (F.col("month") if by_month else F.lit(0)).alias("_month"),
                        F.col("monthly_events").alias("_base"))
    flagged = (events.withColumn("_counts", F.when(counts, 1).otherwise(0))
               .withColumn("_month", F.trunc("received_at", "MM") if by_month else F.lit(0))
               .join(limits, "plan", "left"))
    ran = exclusive_running_sum(flagged, ["owner_account_id", "_month"], seq_col, "_counts", "_before",
                                chunk=chunk, of_keys=base)
    base_count = F.coalesce(F.col("_base"), F.lit(0))
    used = base_count + F.col("_before")
    # refused events do not count, so the count an event meets stops at the limit (or at a base above it)
    met = F.greatest(base_count, F.least(used, F.coalesce(F.col("_limit").cast("long"), base_count)))
    decided = ran.withColumn("_ok", F.coalesce(used < F.col("_limit"), F.lit(False))).withColumn("_used", met)
    return decided.drop("_counts", "_base", "_before", "_month")


def with_plan_in_force(events: DataFrame, changes: DataFrame, seq_col: str = "ingest_seq",
                       chunk: int = CHUNK) -> DataFrame:
    """Events with the ``plan`` of their owner at their arrival, and ``_since``, the arrival of the change
    that set it (-1: the plan at batch start).

    ``changes`` is (owner_account_id, seq_col, plan) in the same arrival order (I16 and I18 write such plans).
    An as-of join: the last change is carried along the arrival order, a hot owner being split into chunks.
    """
    change = F.struct(F.col("plan"), F.col(seq_col).cast("long").alias("seq"))
    both = (events.withColumn("_event", F.lit(True)).withColumn("_change", F.when(F.lit(False), change))
            .unionByName(changes.select("owner_account_id", F.col(seq_col).cast(events.schema[seq_col].dataType).alias(seq_col),
                                        change.alias("_change"), F.lit(False).alias("_event")), allowMissingColumns=True))
    return (last_non_null(both, ["owner_account_id"], seq_col, "_change", "_now", chunk).filter("_event")
            .withColumn("plan", F.when(F.col("_now").isNotNull(), F.col("_now.plan")).otherwise(F.col("plan")))
            .withColumn("_since", F.coalesce("_now.seq", F.lit(-1).cast("long")))
            .drop("_event", "_change", "_now"))


def decide_event_quota_as_of(events: DataFrame, usage: DataFrame, changes: DataFrame, counts: Column,
                             seq_col: str = "ingest_seq", chunk: int = CHUNK) -> DataFrame:
    """I8 with plans that change inside the batch: as decide_event_quota, by the plan in force at each arrival.

    Between two changes the limit stands, so a stretch with n counting events takes
    the count from u to max(u, min(u + n, limit)).  These steps are folded for each
    owner and month over one row a stretch (as many as the owner's changes, not its
    events); within a stretch the running count decides.  Rows of a null owner or
    of an unknown plan are rejected.
    """
    by_month = "month" in usage.columns
    keys = ["owner_account_id", "_month"]
    limits = F.broadcast(plan_catalogue(events.sparkSession).select("plan", F.col("monthly_events").cast("long").alias("_limit")))
    base = usage.select(F.col("account_id").alias("owner_account_id"),
                        (F.col("month") if by_month else F.lit(0)).alias("_month"), F.col("monthly_events").cast("long").alias("_base"))
    owned = (with_plan_in_force(events.filter("owner_account_id is not null"), changes, seq_col, chunk)
             .withColumn("_counts", F.when(counts, 1).otherwise(0))
             .withColumn("_month", F.trunc("received_at", "MM") if by_month else F.lit(0)).join(limits, "plan", "left"))
    stretches = owned.groupBy(*keys, "_since").agg(F.sum("_counts").alias("n"), F.first("_limit").alias("l"))
    start = F.coalesce("_base", F.lit(0).cast("long"))

    def step(done, s):
        u = done["u"]
        after = F.when(s["l"].isNull(), u).otherwise(F.greatest(u, F.least(u + s["n"], s["l"])))
        return F.struct(after.alias("u"), F.concat(done["met"], F.array(F.struct(s["_since"].alias("since"), u.alias("u")))).alias("met"))

    none = F.array().cast("array<struct<since:bigint,u:bigint>>")
    folded = (stretches.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_since", "n", "l"))).alias("s"))
              .join(base, keys, "left")
              .select(*keys, F.explode(F.aggregate("s", F.struct(start.alias("u"), none.alias("met")), step)["met"]).alias("m"))
              .select(*keys, F.col("m.since").alias("_since"), F.col("m.u").alias("_start")))
    ran = exclusive_running_sum(owned, [*keys, "_since"], seq_col, "_counts", "_before", chunk=chunk)
    used = F.col("_start") + F.col("_before")
    met = F.greatest(F.col("_start"), F.least(used, F.coalesce(F.col("_limit"), F.col("_start"))))
    decided = (ran.join(folded, [*keys, "_since"]).withColumn("_ok", F.coalesce(used < F.col("_limit"), F.lit(False)))
               .withColumn("_used", met).drop("_counts", "_before", "_start", "_since", "_month"))
    return decided.unionByName(events.filter("owner_account_id is null").withColumn("_ok", F.lit(False)), allowMissingColumns=True)


def quota_detail() -> Column:
    """The error detail of an event that ``decide_event_quota`` refused."""
    return F.concat(F.lit("current "), F.col("_used").cast("string"), F.lit(", limit "),
                    F.coalesce(F.col("_limit").cast("string"), F.lit("none")))


def enforce_event_quota(events: DataFrame, usage: DataFrame, counts: Column,
                        seq_col: str = "ingest_seq", chunk: int = CHUNK):
    """I8 as (accepted, rejected): reject an owner's event once its monthly count reached the limit."""
    decided = decide_event_quota(events, usage, counts, seq_col, chunk)
    accepted = decided.filter("_ok").drop("_limit", "_ok", "_used")
    keep = [c for c in events.columns if c not in ("error_code", "error_field", "error_detail")]
    rejected = decided.filter(~F.col("_ok")).select(
        *keep, F.lit("PLAN_LIMIT_REACHED").alias("error_code"),
        F.lit("monthlyEvents").alias("error_field"), quota_detail().alias("error_detail"))
    return accepted, rejected


# --- I9 ---------------------------------------------------------------------------------

def arrivals_to_users(arrivals: DataFrame) -> DataFrame:
    """(bot_id, telegram_id, profile, event_time, seq) -> users rows."""
    return conform(arrivals.select(
        user_id_of("bot_id", "telegram_id").alias("id"), "bot_id", "telegram_id", "username",
        "first_name", "last_name", F.col("event_time").alias("created_at"),
        F.col("event_time").alias("last_active_at"), F.col("seq").alias("first_seq"),
        F.col("seq").alias("last_seq")), "users")


def upsert_users(users: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Merge arrivals into the users state (keyed by bot, telegram id).

    First arrival sets id and created_at; the latest arrival overwrites the
    profile (nulls included); last_active_at is the maximum.  All parts are
    mergeable aggregates, so Spark combines them map-side and a hot user is
    harmless; snapshot and deltas can be merged in any grouping.
    """
    return merge_users(users.unionByName(arrivals_to_users(arrivals)))


def merge_users(rows: DataFrame) -> DataFrame:
    """Reduce users-schema rows (snapshot and/or deltas) to one per key."""
    merged = rows.groupBy("bot_id", "telegram_id").agg(
        # two streams number their rows apart: the time settles which of two like numbers comes first
        F.min_by("id", F.struct("first_seq", "created_at")).alias("id"),
        F.min_by("created_at", F.struct("first_seq", "created_at")).alias("created_at"),
        F.max_by(F.struct("username", "first_name", "last_name"), F.struct("last_seq", "last_active_at")).alias("p"),
        F.max("last_active_at").alias("last_active_at"),
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))
    return conform(merged.select("*", "p.*").drop("p"), "users")


# --- I10 - I13 -------------------------------------------------------------------------

def _fact_id(kind: str) -> Column:
    """``source`` keeps the ids of two streams apart; (seq, sub_seq) is unique in one."""
    return stable_id(F.lit(kind), F.col("source"), F.col("seq").cast("string"), F.col("sub_seq").cast("string"))


def derive_messages(events: DataFrame) -> DataFrame:
    """Message events -> messages rows."""
    m = events.filter(F.col("kind") == "message")
    return conform(m.select(_fact_id("message").alias("id"), "bot_id",
                            user_id_of("bot_id", "telegram_id").alias("user_id"), "text",
                            "created_at"), "messages")


def derive_payments(events: DataFrame) -> DataFrame:
    """Payment events -> payments rows (amount as NUMERIC(12,2))."""
    p = events.filter(F.col("kind") == "payment")
    return conform(p.select(_fact_id("payment").alias("id"), "bot_id",
                            user_id_of("bot_id", "telegram_id").alias("user_id"),
                            F.col("amount").cast("decimal(12,2)").alias("amount"), "currency",
                            "created_at"), "payments")


def derive_health_logs(events: DataFrame) -> DataFrame:
    """Every accepted event writes (online, 100, 1 request)."""
    return conform(events.select(
        _fact_id("health").alias("id"), "bot_id", F.lit("online").alias("status"),
        F.lit(100).cast("decimal(5,2)").alias("uptime"), F.lit(1).alias("request_count"),
        "created_at"), "bot_health_logs")


def derive_activity_logs(events: DataFrame) -> DataFrame:
    """Activity row with description, code and params by event kind.

    params keys are in the order PostgreSQL's jsonb keeps them (shorter
    keys first), which is what the reference returns after a round trip.
    """
    kind, tg = F.col("kind"), F.col("telegram_id")
    amount = F.col("amount").cast("decimal(12,2)")
    description = (
        F.when(kind == "message", F.concat(F.lit("Message received from "), tg))
         .when(kind == "payment", F.concat(F.lit("Payment of "), amount.cast("string"),
                                           F.lit(" "), F.col("currency")))
         .otherwise(F.concat(F.lit("User "), tg, F.lit(" joined"))))
    code = (F.when(kind == "message", "message.received")
             .when(kind == "payment", "payment.received").otherwise("user.joined"))
    user_json = X.json_string(tg)
    params = F.when(kind == "payment", F.concat(
        F.lit('{"user":'), user_json, F.lit(',"amount":'), X.js_number_text(amount),
        F.lit(',"currency":'), X.json_string(F.col("currency")), F.lit("}"))) \
        .otherwise(F.concat(F.lit('{"user":'), user_json, F.lit("}")))
    return conform(events.select(
        _fact_id("activity").alias("id"), "bot_id", kind.alias("event_type"),
        description.alias("description"), code.alias("event_code"), params.alias("params"),
        "created_at"), "activity_logs")
