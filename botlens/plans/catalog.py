"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracles.

Queries ending in ``_star`` run on the star-schema mapping (B) whose facts
are the TPC-H-like tables (line items as messages), the others on the
``events`` mapping (A).  Every query reads the whole driver tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from botlens.functions import exprs as X
from botlens.functions.clock import Clock, date_lit
from botlens.functions.dates import parse_js_date
from botlens.operators import accounts as AC
from botlens.operators import billing as BL
from botlens.operators import bots as BO
from botlens.operators import ingest as IN
from botlens.operators import quality as QU
from botlens.operators import recent as RE
from botlens.operators import rollup as RU
from botlens.operators import stats
from botlens.operators.validate import validate_api_events
from botlens.plans.ingest_batch import Secrets, ingest_api_batch, ingest_platform_batch
from botlens.sources import raw as RAW
from botlens.plans import oracle_sql as O
from botlens.schemas import plan_catalogue
from botlens.session import scratch_path
from botlens.sources import fixtures as FX
from botlens.sources import keyed as KE
from botlens.sources.sink import Sink
from botlens.streaming.stream import api_batch_writer, drop_redelivered
from botlens.streaming.totals import add_up, read_totals

Query = Callable[[SparkSession, str], DataFrame]

def tables_a(spark: SparkSession, sf_dir: str):
    return FX.mapping_a(spark, sf_dir)


def tables_b(spark: SparkSession, sf_dir: str):
    return FX.mapping_b(spark, sf_dir)


def _stat(fn, mapping, as_of, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(mapping(spark, sf_dir), as_of, **kw)
    return run


def _series_text(df: DataFrame, *names: str) -> DataFrame:
    return df.select([X.series_json(c).alias(c) if c in names else F.col(c) for c in df.columns])


def _composite(fn, mapping, as_of, series_cols) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _series_text(fn(mapping(spark, sf_dir), as_of), *series_cols)
    return run


def _recent(mapping, limit=10) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stats.recent_activity(mapping(spark, sf_dir), limit)
    return run


A, B = FX.AS_OF_A, FX.AS_OF_B
SECRETS = Secrets(api_key=RAW.API_KEY_SECRET, token=RAW.TOKEN_SECRET)
TOKEN_KEY = "fixture-token-encryption-secret"


def _iso(df: DataFrame, *cols: str) -> DataFrame:
    return df.select([X.iso_text(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def _landed(df: DataFrame, name: str) -> DataFrame:
    """Raw inputs are landed as a table of several files first, as a deployment receives them."""
    from botlens.session import stage
    return stage(df.repartition(df.sparkSession.sparkContext.defaultParallelism), name)


def _raw_api(spark, sf_dir):
    return _landed(RAW.api_events(spark, sf_dir), "raw-api")


def _raw_billing(spark, sf_dir):
    return _landed(RAW.billing_webhooks(spark, sf_dir), "raw-billing")


def _dashboard(mapping, as_of) -> Query:
    def run(spark, sf_dir):
        return stats.to_document_json(stats.dashboard(mapping(spark, sf_dir), as_of))
    return run


def _upsert_users(spark, sf_dir):
    t = tables_a(spark, sf_dir)
    arrivals = FX.user_arrivals_a(spark, sf_dir).withColumn(
        "seq", F.col("seq") + F.lit(O.ARRIVAL_SEQ_BASE))
    return _iso(IN.upsert_users(t.users, arrivals), "created_at", "last_active_at")


def _telegram_events(spark, sf_dir):
    ev, _ = IN.flatten_telegram_updates(RAW.platform_updates(spark, sf_dir))
    return _iso(ev.select("bot_id", "ingest_seq", "kind", "sub_seq", "telegram_id", "username",
                          "first_name", "last_name", "text", "created_at"), "created_at")


def _api_validation_errors(spark, sf_dir):
    _, rej = validate_api_events(_raw_api(spark, sf_dir))
    return rej.groupBy("error_code", "error_field", "error_detail").agg(
        F.count(F.lit(1)).alias("events"))


def _accepted_billing(spark, sf_dir):
    t = tables_a(spark, sf_dir)
    acc, rej = BL.accept_billing_events(_raw_billing(spark, sf_dir), t.accounts)
    return t, acc, rej


def _billing_events_state(spark, sf_dir):
    t, acc, _ = _accepted_billing(spark, sf_dir)
    from botlens.schemas import empty
    ev = BL.upsert_billing_events(empty(spark, "billing_events"), acc)
    return _iso(ev, "processed_at", "created_at")


def _current_subscription(spark, sf_dir):
    t, acc, _ = _accepted_billing(spark, sf_dir)
    from botlens.schemas import empty
    subs = BL.upsert_subscriptions(empty(spark, "subscriptions"), t.accounts, acc)
    return _iso(AC.current_subscription(subs), "current_period_start", "current_period_end",
                "created_at", "updated_at")


def _billing_rejections(spark, sf_dir):
    _, _, rej = _accepted_billing(spark, sf_dir)
    return rej.groupBy("error_code", "error_field").agg(F.count(F.lit(1)).alias("events"))


def _contracts_report(spark, sf_dir):
    return QU.check_contracts(FX.contract_tables(spark, sf_dir))


def _erase_starter_accounts(spark, sf_dir):
    """What is left of every table, by owner where it has one: billing events lose theirs."""
    t = FX.contract_tables(spark, sf_dir)
    keys = t.accounts.filter(F.col("plan") == "starter").select(F.col("id").alias("account_id"))
    left = QU.erase_accounts(t, keys)
    owner = {"accounts": "id", "bots": "owner_account_id", "subscriptions": "account_id", "billing_events": "account_id"}
    parts = [df.groupBy(F.col(owner.get(n, "bot_id")).alias("owner")).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(n).alias("table_name"), "owner", "row_count") for n, df in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _api_keys(spark, sf_dir):
    return RAW.api_events(spark, sf_dir).select("api_key").distinct()


def _lookup_accounts_by_key(spark, sf_dir):
    t = tables_a(spark, sf_dir)
    keys = _api_keys(spark, sf_dir).withColumn(
        "api_key_hash", X.hmac_sha256_hex("api_key", FX.FIXTURE_API_SECRET))
    found = AC.lookup_accounts(t.accounts, keys.select("api_key_hash"))
    return keys.join(found, "api_key_hash").select(
        "api_key", F.col("id").alias("account_id"), "email", "plan")


def _identities(spark, sf_dir):
    n = FX.read(spark, sf_dir, "nation")
    ev = FX.events_a(spark, sf_dir).select("bot_id").distinct()
    return ev.join(F.broadcast(n), ev.bot_id == n.n_nationkey.cast("string")).select(
        F.col("n_regionkey").cast("string").alias("owner_account_id"),
        F.when(F.col("n_nationkey") % 2 == 0, "username").otherwise("token").alias("bot_type"),
        F.lower("n_name").alias("bot_identifier"), "n_nationkey", "n_name")


def _lookup_bots_by_identity(spark, sf_dir):
    t = tables_a(spark, sf_dir)
    keys = _identities(spark, sf_dir).select("owner_account_id", "bot_type", "bot_identifier")
    return AC.lookup_bots(t.bots, keys).select(
        F.col("id").alias("bot_id"), "owner_account_id", "bot_type", "bot_identifier", "display_name")


def _lookup_bots_by_id(spark, sf_dir):
    """The bots of all events, by id."""
    keys = FX.events_a(spark, sf_dir).select(F.col("bot_id").alias("id")).distinct()
    return AC.lookup_bots(tables_a(spark, sf_dir).bots, keys).select("id", "owner_account_id", "bot_identifier")


def _lookup_bots_by_owner(spark, sf_dir):
    """Each event asks for its bot in the name of owner user_id % 5; only the right owners find it."""
    keys = FX.events_a(spark, sf_dir).select(
        F.col("bot_id").alias("id"), (F.col("user_id") % 5).cast("string").alias("owner_account_id"))
    return AC.lookup_bots(tables_a(spark, sf_dir).bots, keys).select("id", "owner_account_id", "bot_identifier")


def _lookup_accounts_by_id(spark, sf_dir):
    """Accounts named by billing webhooks, by id (one of them unknown)."""
    keys = RAW.billing_webhooks(spark, sf_dir).select(F.get_json_object("body", "$.accountId").alias("id"))
    return AC.lookup_accounts(tables_a(spark, sf_dir).accounts, keys).select("id", "email", "plan")


def _current_subscription_of_many(spark, sf_dir):
    """Q22 where accounts have many rows; like times are settled by the id."""
    subs = FX.contract_tables(spark, sf_dir)["subscriptions"]
    return AC.current_subscription(subs).select("account_id", "id", "provider", "plan", "status", "amount_monthly")


def _token_round_trip(spark, sf_dir):
    """One token an event."""
    token = F.concat((F.lit(7000000) + F.col("event_id")).cast("string"), F.lit(":AAH_token-"),
                     F.col("event_type"), F.lit("_xxxxxxxxxxxx"))
    tokens = FX.events_a(spark, sf_dir).select("event_id", token.alias("token"))
    sealed = BO.protect_tokens(tokens, "token", TOKEN_KEY, out="sealed")
    opened = BO.reveal_tokens(sealed, "sealed", TOKEN_KEY, out="opened")
    return opened.select("event_id", "token", (F.col("opened") == F.col("token")).alias("round_trip_ok"))


def _api_ingest(spark, sf_dir):
    return ingest_api_batch(_raw_api(spark, sf_dir), tables_a(spark, sf_dir), SECRETS)


def _ingest_api_rejections(spark, sf_dir):
    out = _api_ingest(spark, sf_dir)
    return out.rejected.groupBy("error_code", "error_field").agg(F.count(F.lit(1)).alias("events"))


def _ingest_api_activity(spark, sf_dir):
    return _iso(_api_ingest(spark, sf_dir).facts["activity_logs"], "created_at")


def _ingest_platform_messages(spark, sf_dir):
    out = ingest_platform_batch(RAW.platform_updates(spark, sf_dir), tables_a(spark, sf_dir))
    return _iso(out.facts["messages"], "created_at")


def _no_usage(tables):
    return lambda _clock: tables.accounts.select(F.col("id").alias("account_id"), F.lit(0).cast("long").alias("monthly_events"))


def _bad_inputs(spark, sf_dir):
    """Outputs of the three sources over malformed inputs: (input rows, accepted rows, rejected rows) each."""
    t = tables_a(spark, sf_dir)
    api, platform = (_landed(f(spark, sf_dir), "raw-bad") for f in (RAW.bad_api_events, RAW.bad_platform_updates))
    out = ingest_api_batch(api, t, SECRETS, usage_at=_no_usage(t))
    moved = ingest_platform_batch(platform, t)
    billing = _landed(RAW.bad_billing_webhooks(spark, sf_dir), "raw-bad")
    ok, refused = BL.accept_billing_events(billing, t.accounts)
    written = moved.facts["activity_logs"]
    return {"api": (api, out.facts["activity_logs"], out.rejected), "platform": (platform, written, moved.rejected),
            "billing": (billing, ok, refused)}


def _bad_bodies(spark, sf_dir):
    parts = [rej.groupBy("error_code", "error_field").agg(F.count(F.lit(1)).alias("events"))
             .select(F.lit(source).alias("source"), "error_code", "error_field", "events")
             for source, (_, _, rej) in _bad_inputs(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ingest_balance(spark, sf_dir):
    """Rows that came in, were accepted and rejected; what is left wrote nothing (platform updates only)."""
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = []
    for source, (raw, ok, rej) in _bad_inputs(spark, sf_dir).items():
        parts.append(counted(raw, "input_rows").crossJoin(counted(ok, "accepted_rows"))      # one row each
                     .crossJoin(counted(rej, "rejected_rows")).select(
            F.lit(source).alias("source"), "*",
            (F.col("input_rows") - F.col("accepted_rows") - F.col("rejected_rows")).alias("other_rows")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUOTA_LEFT = {"2024-01-01": 700, "2024-02-01": 60}       # events an owner may still send in each month


def _two_months(raw, later):
    """API events of which those ``later`` arrive a month later."""
    return raw.withColumn("received_at", F.when(
        later, F.timestamp_add("SECOND", F.col("ingest_seq") % 86400,
                                                      F.lit("2024-02-01").cast("timestamp"))).otherwise(F.col("received_at")))


def _ingest_api_quota(spark, sf_dir):
    """A batch of two months in which the quota rejects: every third event arrives a month later."""
    t = tables_a(spark, sf_dir)
    raw = _two_months(RAW.api_events(spark, sf_dir), F.col("ingest_seq") % 3 == 0)
    limits = plan_catalogue(spark).select("plan", "monthly_events")

    def usage(clock):
        left = QUOTA_LEFT[clock.month_start.isoformat()]
        return t.accounts.join(F.broadcast(limits), "plan").select(
            F.col("id").alias("account_id"), (F.col("monthly_events") - left).cast("long").alias("monthly_events"))

    out = ingest_api_batch(_landed(raw, "raw-quota"), t, SECRETS, usage_at=usage)
    return out.rejected.filter("error_code = 'PLAN_LIMIT_REACHED'").select("ingest_seq", "error_field", "error_detail")


def _ingest_api_payments(spark, sf_dir):
    return _iso(_api_ingest(spark, sf_dir).facts["payments"], "created_at")


def _ingest_api_health(spark, sf_dir):
    return _iso(_api_ingest(spark, sf_dir).facts["bot_health_logs"], "created_at")


def _ingest_api_users(spark, sf_dir):
    return _iso(_api_ingest(spark, sf_dir).users_delta, "created_at", "last_active_at")


def _ingest_api_bots(spark, sf_dir):
    return _iso(_api_ingest(spark, sf_dir).bots, "connected_at", "verified_at", "tracking_enabled_at", "created_at",
                "updated_at")


def _accounts_after_billing(spark, sf_dir):
    t, acc, _ = _accepted_billing(spark, sf_dir)
    from botlens.session import stage
    return _iso(BL.project_account_plan(t.accounts, stage(acc, "billing-accepted")), "created_at", "updated_at")


def _connects(spark, sf_dir):
    """Bot "connect" requests: one per events row, identity of its bot."""
    n = F.broadcast(FX.read(spark, sf_dir, "nation"))
    ev = FX.events_a(spark, sf_dir)
    x = ev.join(n, ev.bot_id == n.n_nationkey.cast("string"))
    is_user = F.col("n_nationkey") % 2 == 0
    value = F.when(is_user, F.concat(F.lit("@"), F.col("n_name"))).otherwise(F.concat(
        (F.lit(7000000) + F.col("n_nationkey")).cast("string"), F.lit(":AAH_token-"),
        F.lower("n_name"), F.lit("_xxxxxxxxxxxx")))
    return x.select(F.col("n_regionkey").cast("string").alias("owner_account_id"),
                    F.when(is_user, "username").otherwise("token").alias("bot_type"),
                    value.alias("bot_value"), F.col("event_id").alias("ingest_seq"),
                    F.col("ts").alias("received_at"))


def _bot_cap_connects(spark, sf_dir):
    t = tables_a(spark, sf_dir)
    ok, rej = BO.enforce_bot_cap(_connects(spark, sf_dir), t.bots, t.accounts, RAW.TOKEN_SECRET)
    cols = ["owner_account_id", "bot_type", "bot_value"]
    return ok.select(*cols, F.lit(True).alias("allowed")).unionByName(
        rej.select(*cols, F.lit(False).alias("allowed"))).distinct()


def _account_change_log(spark, sf_dir):
    c = FX.read(spark, sf_dir, "customer")
    o = FX.read(spark, sf_dir, "orders")
    cust = c.join(F.broadcast(FX.read(spark, sf_dir, "nation")), c.c_nationkey == F.col("n_nationkey"))
    email = F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("@Example.com"))
    creates = c.select(F.lit("create").alias("change"), email.alias("email"),
                       F.col("c_name").alias("name"), F.sha2(email, 256).alias("api_key_hash"),
                       F.lit(None).cast("string").alias("account_id"), F.lit(None).cast("string").alias("plan"),
                       F.col("c_custkey").alias("ingest_seq"))
    again = c.filter(F.col("c_custkey") % 10 == 0).select(
        F.lit("create").alias("change"), F.upper(email).alias("email"), F.col("c_name").alias("name"),
        F.sha2(F.upper(email), 256).alias("api_key_hash"), F.lit(None).cast("string").alias("account_id"),
        F.lit(None).cast("string").alias("plan"), (F.col("c_custkey") + 1000000).alias("ingest_seq"))
    oc = o.join(cust, o.o_custkey == cust.c_custkey)
    plans = oc.select(
        F.lit("plan").alias("change"), F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("api_key_hash"),
        F.when(F.col("o_orderkey") % 350 == 0, F.lit("missing"))
         .otherwise(F.col("n_regionkey").cast("string")).alias("account_id"),
        F.when(F.substring("o_orderpriority", 1, 1) == "1", " GROWTH ").when(
            F.substring("o_orderpriority", 1, 1) == "5", "gold").otherwise("starter").alias("plan"),
        (F.col("o_orderkey") + 2000000).alias("ingest_seq"))
    return (creates.unionByName(again).unionByName(plans)
            .withColumn("received_at", F.timestamp_add("SECOND", F.col("ingest_seq") % 86400,
                                                       F.lit("2024-02-01").cast("timestamp"))))


def _account_changes_state(spark, sf_dir):
    t = tables_a(spark, sf_dir)
    acc, _ = BL.apply_account_changes(t.accounts, _account_change_log(spark, sf_dir))
    return _iso(acc, "created_at", "updated_at")


def _account_changes_rejections(spark, sf_dir):
    t = tables_a(spark, sf_dir)
    _, rej = BL.apply_account_changes(t.accounts, _account_change_log(spark, sf_dir))
    return rej.groupBy("error_code").agg(F.count(F.lit(1)).alias("events"))


def _bot_change_log(spark, sf_dir):
    """Track, verify or send credentials, and track again: each order on some bots."""
    t = tables_a(spark, sf_dir)
    b = t.bots.select("id", "bot_type", "bot_identifier", F.col("id").cast("int").alias("k"))
    token = F.concat((F.lit(7000000) + F.col("k")).cast("string"), F.lit(":AAH_token-"),
                     F.col("bot_identifier"), F.lit("_xxxxxxxxxxxx"))
    base = dict(display_name=F.lit(None).cast("string"), telegram_bot_id=F.lit(None).cast("string"),
                encrypted_token=F.lit(None).cast("string"))

    def rows(change, seq, **over):
        cols = {**base, **over}
        return b.select(F.col("id").alias("bot_id"), F.lit(change).alias("change"),
                        X.is_token_shaped(token).alias("token_ok"),
                        *[v.alias(k) for k, v in cols.items()],
                        F.lit("2024-02-01").cast("timestamp").alias("received_at"),
                        (F.col("k") * 10 + seq).cast("long").alias("ingest_seq"))
    creds = rows("credentials", 2, display_name=F.concat(F.lit("@"), F.col("bot_identifier")),
                 telegram_bot_id=F.col("k").cast("string"),
                 encrypted_token=F.concat(F.lit("enc:"), token)).filter(F.col("bot_type") == "token")
    verify = rows("verify", 2).filter(F.col("bot_type") == "username")
    early = rows("track", 1).filter(F.col("k") % 2 == 1)         # before the token is known
    track = rows("track", 3).filter(F.col("k") % 4 != 3)
    ghost = rows("track", 4).filter(F.col("k") == 0).withColumn("bot_id", F.lit("no-such-bot"))
    odd = rows("rename", 5).filter(F.col("k") == 1)
    return t, creds.unionByName(verify).unionByName(early).unionByName(track).unionByName(ghost).unionByName(odd)


def _bot_changes(spark, sf_dir):
    t, changes = _bot_change_log(spark, sf_dir)
    new_bots, _ = BO.apply_bot_changes(t.bots, changes)
    return _iso(new_bots, "connected_at", "verified_at", "tracking_enabled_at", "created_at", "updated_at")


def _bot_changes_rejections(spark, sf_dir):
    t, changes = _bot_change_log(spark, sf_dir)
    _, rej = BO.apply_bot_changes(t.bots, changes)
    return rej.select("bot_id", "change", "ingest_seq", "error_code")


def _stored_rollup(t) -> DataFrame:
    """The rollup as a deployment has it: a table that ingest maintains, read back."""
    from botlens.session import stage
    return stage(RU.full_rollup(t), "daily-rollup")


def _overview_rollup(mapping, as_of) -> Query:
    def run(spark, sf_dir):
        t = mapping(spark, sf_dir)
        return RU.overview_from_rollup(t, _stored_rollup(t), as_of)
    return run


def _account_usage_rollup(spark, sf_dir):
    t = tables_a(spark, sf_dir)
    return RU.account_usage_from_rollup(t, _stored_rollup(t), A)


def _stored_newest(t, batches: int = 4) -> DataFrame:
    """The newest-activity state as ingest leaves it: the rows of several batches, not merged yet."""
    from botlens.session import stage
    batch = F.pmod(F.xxhash64("id"), F.lit(batches))
    parts = [RE.newest_daily(t.activity_logs.filter(batch == b)) for b in range(batches)]
    return stage(reduce(DataFrame.unionByName, parts), "newest-activity")


def _recent_newest(mapping, limit=10) -> Query:
    """Q17 from the state: merged over the batches."""
    def run(spark, sf_dir):
        return RE.recent_from_newest(RE.merge_newest(_stored_newest(mapping(spark, sf_dir))), limit)
    return run


def _dashboard_rollup(mapping, as_of) -> Query:
    """Q18 from the rollup and the newest-activity state: no fact table is read."""
    def run(spark, sf_dir):
        t = mapping(spark, sf_dir)
        return stats.to_document_json(RU.dashboard_from_rollup(t, _stored_rollup(t), as_of, newest=_stored_newest(t)))
    return run


USER_BATCHES = 3


def user_batches(t) -> list[DataFrame]:
    """The users as their arrivals of several batches: each first comes when it was created and again,
    one batch later, when it was last active."""
    turn = F.pmod(F.xxhash64("id"), F.lit(USER_BATCHES))
    first = t.users.select("*", turn.alias("_b"), F.lit(0).alias("_again")).withColumn("last_active_at", F.col("created_at"))
    again = t.users.select("*", (turn + 1).alias("_b"), F.lit(1).alias("_again")).withColumn("created_at", F.col("last_active_at"))
    both = first.unionByName(again)
    both = both.withColumns({n: F.col(n) * 2 + F.col("_again") for n in ("first_seq", "last_seq")})
    return [both.filter(F.col("_b") == b).drop("_b", "_again") for b in range(USER_BATCHES + 1)]


def _overview_maintained(spark, sf_dir):
    """Q7 when every batch of users wrote signed rollup rows: the users themselves are not read."""
    from botlens.schemas import empty
    from botlens.session import stage
    t = tables_a(spark, sf_dir)
    state, rollup = empty(spark, "users"), RU.daily_rollup(t)
    for batch in user_batches(t):
        new, signed = RU.user_step(state, IN.merge_users(batch))
        rollup = rollup.unionByName(stage(signed, "users-signed"))
        state = stage(state.join(new, ["bot_id", "telegram_id"], "left_anti").select(*new.columns).unionByName(new), "users-state")
    facts = type(t)({"bots": t.bots})
    return RU.overview_from_rollup(facts, RU.merge_rollups(rollup), A)


def _event_date_texts(spark, sf_dir):
    """order dates written in the styles that a JavaScript date accepts (and one that it does not), read back."""
    o = FX.read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    at = F.timestamp_add("SECOND", key % 86400, F.col("o_orderdate").cast("timestamp"))
    styles = ["MMMM d, yyyy HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "d MMMM yyyy", "yyyy/MM/dd HH:mm", "M/d/yyyy h:mm:ss a",
              "EEE MMM dd yyyy HH:mm:ss 'GMT+0200 (Eastern European Standard Time)'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
              "dd-MMM-yyyy HH:mm:ss 'EST'", "'week 'D' of 'yyyy"]
    text = F.coalesce(*[F.when(key % len(styles) == n, F.date_format(at, s)) for n, s in enumerate(styles)])
    return _iso(o.select("o_orderkey", parse_js_date(text).alias("created_at")), "created_at")


def _keyed(df, name: str, keys: list[str]) -> str:
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    KE.write_keyed(df, path, keys)
    return path


def _lookup_users_keyed(spark, sf_dir):
    """Users asked for by id, from a table dealt by id: only the folders of the asked ids are read."""
    t = tables_a(spark, sf_dir)
    path = _keyed(t.users, "users-by-id", ["id"])
    asked = FX.events_a(spark, sf_dir).filter(F.col("user_id") % 50 == 0).select(F.col("event_id").cast("string").alias("id"))
    found = KE.lookup(KE.read_keyed(spark, path, t.users.schema), asked, ["id"])
    return _iso(found.select("id", "bot_id", "username", "last_active_at"), "last_active_at")


def _upsert_users_keyed(spark, sf_dir):
    """I9 over several batches on a table dealt by key: each batch rewrites only the folders that it touches."""
    t = tables_a(spark, sf_dir)
    keys = ["bot_id", "telegram_id"]
    path = _keyed(t.users, "users-by-key", keys)
    arrivals = FX.user_arrivals_a(spark, sf_dir).withColumn("seq", F.col("seq") + F.lit(O.ARRIVAL_SEQ_BASE))
    rows = _landed(IN.arrivals_to_users(arrivals), "user-arrivals")
    for n in range(USER_BATCHES):
        batch = IN.merge_users(rows.filter(F.col("first_seq") % USER_BATCHES == n))
        KE.upsert(spark, path, t.users.schema, batch, keys, IN.merge_users)
    return _iso(KE.read_keyed(spark, path, t.users.schema).drop("part"), "created_at", "last_active_at")


def _erase_by_file(spark, sf_dir):
    """I24 on stored messages: only files that hold a row of an erased user are written anew; what is left by bot."""
    t = tables_a(spark, sf_dir)
    path = _keyed(t.messages, "messages-by-user", ["user_id"])
    table = KE.read_keyed(spark, path, t.messages.schema)
    gone = t.messages.select("user_id").filter(F.col("user_id").cast("long") % 40 == 0)
    KE.erase(table, path, gone, ["user_id"])
    return KE.read_keyed(spark, path, t.messages.schema).groupBy("bot_id").agg(F.count(F.lit(1)).alias("messages"))


STREAM_FILES = 3


def _arrive(df: DataFrame, name: str) -> str:
    """Land rows as one file a ``_part``, part 0 first: the micro-batches of a replay.  The folder."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df = _landed(df, name)
    for n in range(STREAM_FILES):
        df.filter(F.col("_part") == n).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return path


def _stream_series(facts: str, value: str, typ: str) -> Query:
    """Q11, Q13, Q15 from day buckets in the state store; the facts come in any order, days late."""
    def run(spark, sf_dir):
        t = tables_a(spark, sf_dir)
        path = _arrive(t[facts].select("bot_id", F.to_date("created_at").alias("bucket_date"), F.expr(value).alias("value"),
                                       F.pmod(F.xxhash64("id"), F.lit(STREAM_FILES)).alias("_part")), "late")
        stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
        keys = {n: F.col(n) for n in ("bot_id", "bucket_date")}
        add_up(stream, keys, {"value": F.col("value")}, f"{path}-checkpoint")
        c = Clock.at(A)
        totals = read_totals(spark, f"{path}-checkpoint", ["value"]).withColumn("value", F.col("value").cast(typ))
        inside = F.col("bucket_date").between(date_lit(c.days_ago(29)), date_lit(c.today))
        return stats.fill_series(t, totals.filter(inside), None, c.days_ago(29), c.today)
    return run


LATER_HALF = "2 * event_id >= (SELECT max(event_id) FROM events)"


def _owner_bots_ordered(spark, sf_dir):
    """Q21 with L3: the bots of an owner, newest connection first; the place tells the order."""
    rows = AC.owner_bots(tables_a(spark, sf_dir), A, ordered=True)
    place = F.row_number().over(Window.partitionBy("owner_account_id").orderBy(F.desc("connected_at"), "bot_id"))
    return rows.select("owner_account_id", "bot_id", "connected_at", "total_messages", place.alias("place"))


def _telegram_dedupe(spark, sf_dir):
    """T4: a stream in which every third update comes twice, de-duplicated by update_id within a watermark."""
    updates = RAW.platform_updates(spark, sf_dir)
    again = updates.filter(F.col("ingest_seq") % 3 == 0).withColumn("ingest_seq", F.col("ingest_seq") + 100_000_000)
    path = scratch_path(spark, f"updates-{uuid.uuid4().hex}")
    updates.unionByName(again).withColumn("received_at", F.lit("2024-02-01 00:00:00").cast("timestamp")).write.parquet(path)
    stream = drop_redelivered(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), "1 hour")
    out = f"{path}-kept"
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}-checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    events, _ = IN.flatten_telegram_updates(spark.read.schema(updates.schema).parquet(out))
    return events.groupBy("bot_id", "kind").agg(F.count(F.lit(1)).alias("events"))


def _quota_as_of(spark, sf_dir):
    """Quota while plans change: every order sets its customer's plan (growth if dear), every event is its user's;
    both arrive in the order of their ids, the order first."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    owner = F.col("c_custkey").cast("string")
    usage = read("customer").select(owner.alias("account_id"), (4970 + F.col("c_nationkey")).cast("long").alias("monthly_events"))
    changes = read("orders").select(F.col("o_custkey").cast("string").alias("owner_account_id"),
                                    (2 * F.col("o_orderkey")).alias("ingest_seq"),
                                    F.when(F.col("o_totalprice") > 250000, "growth").otherwise("starter").alias("plan"))
    events = read("events").select((2 * F.col("event_id") + 1).alias("ingest_seq"), "event_id",
                                   F.col("user_id").cast("string").alias("owner_account_id"), "event_type",
                                   F.lit("starter").alias("plan"))
    return IN.decide_event_quota_as_of(events, usage, changes, F.col("event_type") != "error").select(
        "event_id", "plan", F.col("_used").alias("used"), F.col("_ok").alias("accepted"))


def _quota_stream(spark, sf_dir):
    """Two months of events as a stream of several micro-batches: each takes its quota base from the
    counters in the state store, which the batches before it have raised."""
    t = tables_a(spark, sf_dir)
    raw = RAW.api_events(spark, sf_dir)
    last = raw.agg(F.max("ingest_seq")).first()[0]
    raw = _two_months(raw, 2 * F.col("ingest_seq") >= last)
    size = last // STREAM_FILES + 1
    path = _arrive(raw.withColumn("_part", F.floor(F.col("ingest_seq") / size)), "raw-quota")
    # counted from the month's first day, so a later month's events count for an earlier one too
    left = list(QUOTA_LEFT.items())
    limits = plan_catalogue(spark).select("plan", "monthly_events")
    accounts = t.accounts.join(F.broadcast(limits), "plan").select(F.col("id").alias("account_id"), "monthly_events")
    usage = accounts.select("account_id", date_lit(Clock.at(left[1][0]).today).alias("month"),
                            (F.col("monthly_events") - left[1][1]).alias("events")).unionByName(
        accounts.select("account_id", date_lit(Clock.at(left[0][0]).today).alias("month"),
                        F.lit(left[1][1] - left[0][1]).alias("events"))).withColumn("events", F.col("events").cast("long"))
    sink = Sink(spark, f"{path}-sink")
    none = type(t)({"bots": t.bots, "accounts": t.accounts})
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (stream.writeStream.foreachBatch(api_batch_writer(sink, none, SECRETS, usage=usage))
             .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return sink.rejected().filter("error_code = 'PLAN_LIMIT_REACHED'").select("ingest_seq", "error_field", "error_detail")


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "user_window": _stat(stats.user_window, tables_a, A),
        "message_window": _stat(stats.message_window, tables_a, A),
        "revenue_window": _stat(stats.revenue_window, tables_a, A),
        "weekly_growth": _stat(stats.weekly_growth, tables_a, A),
        "monthly_growth": _stat(stats.monthly_growth, tables_a, A),
        "health_summary": _stat(stats.health_summary, tables_a, A),
        "overview": _stat(stats.overview, tables_a, A),
        "overview_star": _stat(stats.overview, tables_b, B),
        "weekly_user_series": _stat(stats.weekly_user_series, tables_a, A),
        "monthly_user_series": _stat(stats.monthly_user_series, tables_a, A),
        "daily_user_series": _stat(stats.daily_user_series, tables_a, A),
        "daily_revenue_series": _stat(stats.daily_revenue_series, tables_a, A),
        "daily_message_series": _stat(stats.daily_message_series, tables_a, A),
        "daily_message_series_star": _stat(stats.daily_message_series, tables_b, B),
        "growth": _composite(stats.growth, tables_a, A, ["weekly_series", "monthly_series"]),
        "user_stats": _composite(stats.user_stats, tables_a, A, ["growth_series"]),
        "revenue_stats": _composite(stats.revenue_stats, tables_a, A, ["revenue_series"]),
        "message_stats": _composite(stats.message_stats, tables_a, A, ["daily_messages_series"]),
        "recent_activity": _recent(tables_a),
        "recent_activity_star": _recent(tables_b),
        "dashboard": _dashboard(tables_a, A),
        "dashboard_star": _dashboard(tables_b, B),
        "account_usage": _stat(AC.account_usage, tables_a, A),
        "account_summary": _stat(AC.account_summary, tables_a, A),
        "owner_bots": _stat(AC.owner_bots, tables_a, A),
        "owner_bots_star": _stat(AC.owner_bots, tables_b, B),
        "upsert_users": _upsert_users,
        "telegram_events": _telegram_events,
        "api_validation_errors": _api_validation_errors,
        "billing_events_state": _billing_events_state,
        "current_subscription": _current_subscription,
        "billing_rejections": _billing_rejections,
        "contracts_report": _contracts_report,
        "erase_starter_accounts": _erase_starter_accounts,
        "lookup_accounts_by_key": _lookup_accounts_by_key,
        "lookup_bots_by_identity": _lookup_bots_by_identity,
        "lookup_bots_by_id": _lookup_bots_by_id,
        "lookup_bots_by_owner": _lookup_bots_by_owner,
        "lookup_accounts_by_id": _lookup_accounts_by_id,
        "current_subscription_of_many": _current_subscription_of_many,
        "token_round_trip": _token_round_trip,
        "ingest_api_rejections": _ingest_api_rejections,
        "ingest_api_activity": _ingest_api_activity,
        "ingest_platform_messages": _ingest_platform_messages,
        "bot_cap_connects": _bot_cap_connects,
        "account_changes_state": _account_changes_state,
        "account_changes_rejections": _account_changes_rejections,
        "bot_changes": _bot_changes,
        "bot_changes_rejections": _bot_changes_rejections,
        "bad_bodies": _bad_bodies,
        "ingest_balance": _ingest_balance,
        "ingest_api_quota": _ingest_api_quota,
        "ingest_api_payments": _ingest_api_payments,
        "ingest_api_health": _ingest_api_health,
        "ingest_api_users": _ingest_api_users,
        "ingest_api_bots": _ingest_api_bots,
        "accounts_after_billing": _accounts_after_billing,
        "overview_rollup": _overview_rollup(tables_a, A),
        "overview_rollup_star": _overview_rollup(tables_b, B),
        "recent_activity_newest": _recent_newest(tables_a),
        "recent_activity_newest_star": _recent_newest(tables_b),
        "overview_maintained": _overview_maintained,
        "stream_user_series": _stream_series("users", "CAST(1 AS BIGINT)", "long"),
        "stream_message_series": _stream_series("messages", "CAST(1 AS BIGINT)", "long"),
        "stream_revenue_series": _stream_series("payments", "amount", "decimal(22,2)"),
        "quota_stream": _quota_stream,
        "quota_as_of": _quota_as_of,
        "event_date_texts": _event_date_texts,
        "lookup_users_keyed": _lookup_users_keyed,
        "upsert_users_keyed": _upsert_users_keyed,
        "erase_by_file": _erase_by_file,
        "owner_bots_ordered": _owner_bots_ordered,
        "telegram_dedupe": _telegram_dedupe,
        "dashboard_rollup": _dashboard_rollup(tables_a, A),
        "dashboard_rollup_star": _dashboard_rollup(tables_b, B),
        "account_usage_rollup": _account_usage_rollup,
    }
    return q


def oracle_sql() -> dict[str, str]:
    return {
        "user_window": O.user_window("a"),
        "message_window": O.message_window("a"),
        "revenue_window": O.revenue_window("a"),
        "weekly_growth": O.weekly_growth("a"),
        "monthly_growth": O.monthly_growth("a"),
        "health_summary": O.health_summary("a"),
        "overview": O.overview("a"),
        "overview_star": O.overview("b"),
        "weekly_user_series": O.series("weekly_user_series", "a"),
        "monthly_user_series": O.series("monthly_user_series", "a"),
        "daily_user_series": O.series("daily_user_series", "a"),
        "daily_revenue_series": O.series("daily_revenue_series", "a"),
        "daily_message_series": O.series("daily_message_series", "a"),
        "daily_message_series_star": O.series("daily_message_series", "b"),
        "growth": O.growth("a"),
        "user_stats": O.user_stats("a"),
        "revenue_stats": O.revenue_stats("a"),
        "message_stats": O.message_stats("a"),
        "recent_activity": O.recent_activity("a"),
        "recent_activity_star": O.recent_activity("b"),
        "recent_activity_newest": O.recent_activity("a"),
        "recent_activity_newest_star": O.recent_activity("b"),
        "overview_maintained": O.overview("a"),
        "stream_user_series": O.series("daily_user_series", "a"),
        "stream_message_series": O.series("daily_message_series", "a"),
        "stream_revenue_series": O.series("daily_revenue_series", "a"),
        "quota_as_of": O.quota_as_of(),
        "quota_stream": O.ingest_api_quota(QUOTA_LEFT, LATER_HALF),
        "event_date_texts": O.event_date_texts(),
        "lookup_users_keyed": O.lookup_users_keyed(),
        "upsert_users_keyed": O.upsert_users(),
        "erase_by_file": O.erase_by_file(),
        "owner_bots_ordered": O.owner_bots_ordered(),
        "telegram_dedupe": O.telegram_dedupe(),
        "dashboard": O.dashboard("a"),
        "dashboard_star": O.dashboard("b"),
        "dashboard_rollup": O.dashboard("a"),
        "dashboard_rollup_star": O.dashboard("b"),
        "account_usage": O.account_usage("a"),
        "account_summary": O.account_summary("a"),
        "owner_bots": O.owner_bots("a"),
        "owner_bots_star": O.owner_bots("b"),
        "upsert_users": O.upsert_users(),
        "telegram_events": O.telegram_events(),
        "api_validation_errors": O.api_validation_errors(),
        "billing_events_state": O.billing_events_state(),
        "current_subscription": O.current_subscription(),
        "billing_rejections": O.billing_rejections(),
        "contracts_report": O.contracts_report(),
        "erase_starter_accounts": O.erase_starter_accounts(),
        "lookup_accounts_by_key": O.lookup_accounts_by_key(),
        "lookup_bots_by_identity": O.lookup_bots_by_identity(),
        "lookup_bots_by_id": O.lookup_bots_by_id(),
        "lookup_bots_by_owner": O.lookup_bots_by_owner(),
        "lookup_accounts_by_id": O.lookup_accounts_by_id(),
        "current_subscription_of_many": O.current_subscription_of_many(),
        "token_round_trip": O.token_round_trip(),
        "bot_cap_connects": O.bot_cap_connects(),
        "account_changes_state": O.account_changes_state(),
        "account_changes_rejections": O.account_changes_rejections(),
        # the rollup must give exactly the overview's answers
        "overview_rollup": O.overview("a"),
        "overview_rollup_star": O.overview("b"),
        "ingest_api_rejections": O.ingest_api_rejections(),
        "ingest_api_activity": O.ingest_api_activity(),
        "ingest_platform_messages": O.ingest_platform_messages(),
        "bot_changes": O.bot_changes(),
        "bot_changes_rejections": O.bot_changes_rejections(),
        "bad_bodies": O.bad_bodies(),
        "ingest_balance": O.ingest_balance(),
        "ingest_api_quota": O.ingest_api_quota(QUOTA_LEFT),
        "ingest_api_payments": O.ingest_api_payments(),
        "ingest_api_health": O.ingest_api_health(),
        "ingest_api_users": O.ingest_api_users(),
        "ingest_api_bots": O.ingest_api_bots(),
        "accounts_after_billing": O.accounts_after_billing(),
        "account_usage_rollup": O.account_usage("a"),
    }
