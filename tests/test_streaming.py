"""A stream of micro-batches gives the state of one big batch."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from botlens.operators import recent, rollup, stats
from botlens.plans import catalog
from botlens.plans.ingest_batch import ingest_api_batch, ingest_platform_batch
from botlens.session import scratch_path
from botlens.sources import fixtures as FX
from botlens.sources import raw as R
from botlens.sources.sink import FACTS, Sink
from botlens.sources.tables import Tables
from botlens.streaming.stream import (account_change_writer, api_batch_writer, bot_change_writer, bot_connect_writer,
                                      platform_batch_writer, start_api_ingest, start_platform_ingest)
from botlens.streaming.totals import QuotaCounters, add_up, read_totals, usage_by_month

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def staged(spark):
    folder = scratch_path(spark, "").removeprefix("file:")
    return set(os.listdir(folder)) if os.path.exists(folder) else set()


def test_stream_equals_batch(spark):
    work = tempfile.mkdtemp(prefix="botlens-stream-")
    src = os.path.join(work, "in")
    raw = R.api_events(spark, SF).filter(F.col("kind") != "payment")
    # three arrival files, in ingest order
    (raw.withColumn("part", (F.col("ingest_seq") % 3)).repartition(1)
        .write.partitionBy("part").json(os.path.join(work, "parts")))
    os.makedirs(src)
    for p in range(3):
        d = os.path.join(work, "parts", f"part={p}")
        for f in os.listdir(d):
            if f.endswith(".json"):
                os.rename(os.path.join(d, f), os.path.join(src, f"{p}-{f}"))
    base = FX.mapping_a(spark, SF)
    sink = Sink(spark, os.path.join(work, "sink"))
    before_run = staged(spark)
    q = start_api_ingest(spark, src, sink, base, catalog.SECRETS, os.path.join(work, "ckpt"),
                         available_now=True, max_files_per_trigger=1)
    q.awaitTermination(600)
    state = sink.read_state(base)
    assert sink.batches().select("batch_id").distinct().count() > 1      # more than one micro-batch ran
    assert not [f for f in staged(spark) - before_run if f.startswith("api-")]   # no staged folder is left
    added = state.activity_logs.count() - base.activity_logs.count()
    assert added > 0
    # the rollup and the newest activity that the batches wrote answer without users or facts
    rolled = sink.read_rollup(rollup.full_rollup(base))
    assert rows(rollup.overview_from_rollup(Tables(bots=state.bots), rolled, FX.AS_OF_A)) == rows(
        stats.overview(state, FX.AS_OF_A))
    newest = sink.read_newest(recent.newest_daily(base.activity_logs))
    assert rows(recent.recent_from_newest(newest)) == rows(stats.recent_activity(state))
    # the quota counters have every batch once
    quota = QuotaCounters(sink, usage_by_month(base))
    quota.refresh()
    got = quota.totals().groupBy("account_id", "month").agg(F.sum("events").alias("events"))
    assert rows(got) == rows(usage_by_month(state))
    plan = state.messages.filter(F.col("event_date") >= F.lit("2024-01-20").cast("date"))
    assert "PartitionFilters: [isnotnull(event_date" in plan._jdf.queryExecution().toString()


def test_rollup_matches_overview(spark):
    from botlens.operators import rollup, stats
    t = FX.mapping_a(spark, SF)
    a = {tuple(r) for r in stats.overview(t, FX.AS_OF_A).collect()}
    b = {tuple(r) for r in rollup.overview_from_rollup(t, rollup.full_rollup(t), FX.AS_OF_A).collect()}
    assert a == b


def test_billing_stream(spark):
    from botlens.operators import accounts as A
    from botlens.streaming.stream import start_billing_ingest
    work = tempfile.mkdtemp(prefix="botlens-billing-")
    src = os.path.join(work, "in")
    R.billing_webhooks(spark, SF).repartition(2).write.json(src)
    base = FX.mapping_a(spark, SF)
    sink = Sink(spark, os.path.join(work, "sink"))
    q = start_billing_ingest(spark, src, sink, base, os.path.join(work, "ckpt"), available_now=True)
    q.awaitTermination(600)
    state = sink.read_state(base)
    subs = A.current_subscription(state.subscriptions).collect()
    assert len(subs) == base.accounts.count()
    assert {r.provider for r in subs} == {"stripe"}


def api_rows(spark):
    return R.api_events(spark, SF)


def test_two_streams_share_one_sink_and_retries_change_nothing(spark):
    """API and platform batches have the same number 0; each runs twice; a failed attempt comes before."""
    work = tempfile.mkdtemp(prefix="botlens-shared-")
    base = FX.mapping_a(spark, SF)
    sink = Sink(spark, os.path.join(work, "sink"))
    api = api_batch_writer(sink, base, catalog.SECRETS)
    platform = platform_batch_writer(sink, base)
    raw, updates = api_rows(spark), R.platform_updates(spark, SF)

    # an attempt that wrote everything and died before its commit
    lost = ingest_api_batch(raw, base, catalog.SECRETS)
    for table, df in lost.facts.items():
        sink.write(table, df, "api", 0)
    assert rows(sink.read_state(base).payments) == rows(base.payments.withColumn("event_date", F.to_date("created_at")))

    api(raw, 0)
    alone = {t: rows(sink.read_state(base)[t]) for t in FACTS}
    platform(updates, 0)
    api(raw, 0)                        # a crash after the commit, before the stream's own checkpoint
    platform(updates, 0)
    state = sink.read_state(base)
    out = ingest_platform_batch(updates, base)
    for t in FACTS:
        assert rows(state[t].select(*out.facts[t].columns)) == sorted(
            [r[:-1] for r in alone[t]] + rows(out.facts[t]), key=repr)
        ids = state[t].select("id").collect()
        assert len({r.id for r in ids}) == len(ids)          # ids of the two streams are apart
    assert state.bots.count() > base.bots.count()            # the API stream's new bots are still there
    rolled = rollup.overview_from_rollup(state, sink.read_rollup(rollup.full_rollup(base)), FX.AS_OF_A)
    assert rows(rolled) == rows(stats.overview(state, FX.AS_OF_A))


def test_a_retry_with_fewer_rows_leaves_none_behind(spark):
    work = tempfile.mkdtemp(prefix="botlens-fewer-")
    base = FX.mapping_a(spark, SF)
    sink = Sink(spark, os.path.join(work, "sink"))
    out = ingest_platform_batch(R.platform_updates(spark, SF), base)
    for table, df in out.facts.items():
        sink.write(table, df, "platform", 0)
    none = ingest_platform_batch(R.platform_updates(spark, SF).limit(0), base)
    none.bots = None
    sink.write_ingest("platform", 0, none, base)
    assert sink.read_state(base).messages.count() == base.messages.count()


def test_the_batch_committed_last_has_the_whole_table(spark):
    """Batch ids of two streams say nothing about their order; an uncommitted batch is not seen."""
    work = tempfile.mkdtemp(prefix="botlens-whole-")
    base = FX.mapping_a(spark, SF)
    sink = Sink(spark, os.path.join(work, "sink"))
    named = lambda name: base.accounts.withColumn("name", F.lit(name))
    names = lambda: {r.name for r in sink.read_state(base).accounts.select("name").collect()}
    sink.write_tables("one", 7, {"accounts": named("first")})
    sink.write_tables("two", 0, {"accounts": named("second")})
    sink.write("accounts", named("lost"), "one", 8)
    assert names() == {"second"}
    sink.write_tables("one", 8, {"accounts": named("third")})
    sink.write_tables("two", 0, {"accounts": named("again")})          # it is committed: nothing happens
    assert names() == {"third"}


def test_a_damaged_file_is_an_error(spark):
    work = tempfile.mkdtemp(prefix="botlens-broken-")
    base = FX.mapping_a(spark, SF)
    sink = Sink(spark, os.path.join(work, "sink"))
    sink.write_tables("one", 0, {"accounts": base.accounts})
    folder = sink.folder("accounts", "one", 0)
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            with open(os.path.join(folder, name), "wb") as f:
                f.write(b"damaged")
    with pytest.raises(Exception, match="damaged|Parquet|parquet|CANNOT_READ"):
        sink.read_state(base).accounts.collect()


def test_readers_prune_the_folders_of_other_batches(spark):
    work = tempfile.mkdtemp(prefix="botlens-prune-")
    base = FX.mapping_a(spark, SF)
    sink = Sink(spark, os.path.join(work, "sink"))
    for n in range(3):
        sink.write_ingest("platform", n, ingest_platform_batch(R.platform_updates(spark, SF).filter(
            F.col("ingest_seq") % 3 == n), base), base)
    plan = sink.rows("messages", "id string, bot_id string")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    assert sink.rows("messages", "id string").count() == ingest_platform_batch(
        R.platform_updates(spark, SF), base).facts["messages"].count()


def test_totals_take_late_rows_and_survive_a_restart(spark):
    """Without a watermark a bucket of any age still counts; a second run goes on from the state."""
    work = tempfile.mkdtemp(prefix="botlens-totals-")
    src, check = os.path.join(work, "in"), os.path.join(work, "ckpt")
    schema = "k string, day date, n long, amount decimal(12,2)"
    days = ["2024-01-03", "2001-05-05", "2024-01-01", "2030-01-01", "2001-05-05"]
    for turn, day in enumerate(days):
        spark.createDataFrame([("a", turn), (None, turn)], "k string, n long").selectExpr(
            "k", f"date'{day}' day", "n", "cast(n + 0.5 as decimal(12,2)) amount").coalesce(1).write.mode("append").parquet(src)
        if turn in (2, 4):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            add_up(stream, {"k": F.col("k"), "day": F.col("day")}, {"n": F.col("n"), "amount": F.col("amount")}, check)
    got = read_totals(spark, check, ["n", "amount"])
    want = spark.read.parquet(src).groupBy("k", "day").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    assert rows(got) == rows(want) and got.columns == want.columns


def test_account_and_bot_changes_reach_the_quota(spark):
    """A plan change and a new account through the sink decide about the next API batch."""
    work = tempfile.mkdtemp(prefix="botlens-changes-")
    base = FX.mapping_a(spark, SF)
    sink = Sink(spark, os.path.join(work, "sink"))
    at = "2024-01-31 00:00:00"
    change = lambda *r: spark.createDataFrame([r], "change string, email string, name string, api_key_hash string, "  # noqa: E731
                                              "account_id string, plan string, ingest_seq long").withColumn(
        "received_at", F.lit(at).cast("timestamp"))
    from botlens.functions import exprs as X
    key = spark.range(1).select(X.hmac_sha256_hex(F.lit("key-new"), catalog.SECRETS.api_key).alias("h")).first().h
    account_change_writer(sink, base)(change("create", " New@Example.com ", None, key, None, None, 1), 0)
    new = sink.read_state(base).accounts.filter("email = 'new@example.com'").first()
    account_change_writer(sink, base)(change("plan", None, None, None, new.id, "Growth", 2), 1)
    assert sink.read_state(base).accounts.filter(F.col("id") == new.id).first().plan == "growth"
    body = '{"botType":"username","botValue":"@fresh","user":{"telegramId":"7"},"text":"hi"}'
    raw = spark.createDataFrame([("message", "key-new", body, 1)], "kind string, api_key string, body string, ingest_seq long") \
        .withColumn("received_at", F.lit(at).cast("timestamp"))
    api_batch_writer(sink, base, catalog.SECRETS)(raw, 0)
    assert sink.read_state(base).bots.filter(F.col("owner_account_id") == new.id).count() == 1
    connects = spark.createDataFrame([(new.id, "username", "@second", 1), ("0", "username", "@third", 2)],
                                     "owner_account_id string, bot_type string, bot_value string, ingest_seq long") \
        .withColumn("received_at", F.lit(at).cast("timestamp"))
    bot_connect_writer(sink, base, catalog.SECRETS)(connects, 0)
    state = sink.read_state(base)
    assert state.bots.filter(F.col("owner_account_id") == new.id).count() == 2
    assert state.bots.filter("bot_identifier = 'third'").count() == 0      # owner 0 is over its cap
    bot = state.bots.filter("bot_identifier = 'second'").first()
    changes = spark.createDataFrame([(bot.id, "verify", 1), (bot.id, "track", 2), ("ghost", "track", 3)],
                                    "bot_id string, change string, ingest_seq long").selectExpr(
        "*", "cast(null as string) display_name", "cast(null as string) telegram_bot_id",
        "cast(null as string) encrypted_token", "true token_ok", f"timestamp'{at}' received_at")
    bot_change_writer(sink, base)(changes, 0)
    after = sink.read_state(base).bots.filter(F.col("id") == bot.id).first()
    assert (after.verification_status, after.tracking_status, after.webhook_status) == ("verified", "enabled", "pending")


def test_read_raw_batch(spark):
    from botlens.streaming.stream import read_raw
    work = tempfile.mkdtemp(prefix="botlens-raw-")
    R.platform_updates(spark, SF).write.json(os.path.join(work, "p"))
    df = read_raw(spark, os.path.join(work, "p"), "platform")
    assert df.columns == ["bot_id", "body", "ingest_seq", "received_at"]
    assert df.count() == R.platform_updates(spark, SF).count()


def test_redelivered_updates_are_dropped_on_request_and_late_events_stay(spark):
    """T4: the same update twice within the watermark counts once, only if asked for; T2: an
    event backdated by years is written and does not move last_active_at back (T3)."""
    work = tempfile.mkdtemp(prefix="botlens-dedupe-")
    src = os.path.join(work, "in")
    base = FX.mapping_a(spark, SF)
    body = '{"update_id":%d,"message":{"from":{"id":7},"date":%d,"text":"x"}}'
    rows_in = [("1", body % (n % 3, 1706000000 + n), n) for n in range(6)] + [("2", body % (0, 1000000000), 6)] \
        + [("2", body % (1, 1706000000), 7), ("2", body % (2, 1000000000), 8)]
    spark.createDataFrame(rows_in, "bot_id string, body string, ingest_seq long").withColumn(
        "received_at", F.lit("2024-01-29 10:00:00").cast("timestamp")).coalesce(1).write.json(src)
    for dedupe, want in (("1 hour", 6), (None, 9)):
        sink = Sink(spark, os.path.join(work, f"sink-{dedupe}"))
        q = start_platform_ingest(spark, src, sink, base, os.path.join(work, f"ckpt-{dedupe}"), available_now=True,
                                  dedupe_within=dedupe)
        q.awaitTermination(600)
        state = sink.read_state(base)
        assert state.messages.count() - base.messages.count() == want
    late = state.users.filter("bot_id = '2' and telegram_id = '7'").first()
    assert late.last_active_at.year == 2024 and late.created_at.year == 2001
