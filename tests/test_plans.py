"""Physical-plan properties the scale design relies on."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark):
    plan = _plan(E.queries()["overview_star"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in plan


def test_dashboard_reads_each_table_once(spark):
    """Stored tables: users, messages, payments and health logs have one scan each."""
    import os
    import tempfile

    from botlens.operators import stats
    from botlens.sources import fixtures as FX
    from botlens.sources.tables import read_tables

    root = tempfile.mkdtemp(prefix="botlens-scans-")
    t = FX.mapping_a(spark, SF)
    for name, df in t.items():
        df.write.parquet(os.path.join(root, name))
    plan = _plan(stats.dashboard(read_tables(spark, root, list(t)), FX.AS_OF_A))
    for name in ("users", "messages", "payments", "bot_health_logs", "activity_logs"):
        assert plan.count(f"Location: InMemoryFileIndex(1 paths)[file:{root}/{name}]") == 1, name


def test_top_n_is_limited_before_the_shuffle(spark):
    plan = _plan(E.queries()["recent_activity_star"](spark, SF))
    assert plan.count("WindowGroupLimit") >= 2        # partial (map side) and final


def test_per_bot_aggregates_are_partial(spark):
    plan = _plan(E.queries()["overview"](spark, SF))
    assert "partial_count" in plan and "partial_max_by" in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_stored_domain_tables_round_trip(spark):
    """Domain tables stored as Parquet and read back with their declared
    schemas give the same overview; time filters push down to the scan."""
    import os
    import tempfile

    from botlens.operators import stats
    from botlens.sources import fixtures as FX
    from botlens.sources.tables import read_tables

    root = tempfile.mkdtemp(prefix="botlens-tables-")
    t = FX.mapping_a(spark, SF)
    for name, df in t.items():
        df.write.parquet(os.path.join(root, name))
    stored = read_tables(spark, root, list(t))
    a = {tuple(r) for r in stats.overview(t, FX.AS_OF_A).collect()}
    b = {tuple(r) for r in stats.overview(stored, FX.AS_OF_A).collect()}
    assert a == b
    plan = _plan(stats.daily_message_series(stored, FX.AS_OF_A))
    assert "GreaterThanOrEqual(created_at" in plan


def test_registration_needs_no_session():
    """The queries are listed before any session exists."""
    import subprocess
    import sys
    code = "import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); assert q and not set(o) - set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=E.__file__.rsplit("/", 1)[0], timeout=120)


def _event_shuffles(df) -> list[str]:
    """The keys by which rows that carry the column ``payload`` are dealt."""
    def walk(node):
        yield node
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))
    return [n.outputPartitioning().toString() for n in walk(df._jdf.queryExecution().executedPlan())
            if n.nodeName() == "Exchange" and "payload" in n.output().mkString(",")]


def test_events_of_one_owner_or_bot_are_not_gathered_in_a_task(spark):
    """Quota base and bots meet chunks of the arrival order, not all rows of an owner or bot."""
    from pyspark.sql import functions as F

    from botlens.operators.bots import resolve_bots
    from botlens.operators.ingest import decide_event_quota
    from botlens.schemas import empty

    events = spark.range(500).select(
        F.col("id").alias("ingest_seq"), F.concat(F.lit("owner"), F.col("id") % 1).alias("owner_account_id"), F.lit("growth").alias("plan"),
        F.lit("username").alias("bot_type"), F.concat(F.lit("b"), F.col("id") % 1).alias("bot_value"), F.col("id").cast("string").alias("payload"),
        F.lit("2024-01-05").cast("timestamp").alias("received_at"))
    usage = spark.createDataFrame([("owner0", 3)], "account_id string, monthly_events long")
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        decided = decide_event_quota(events, usage, F.lit(True), chunk=50)
        resolved, _, _ = resolve_bots(events, empty(spark, "bots"), "secret")
        by_quota, by_bot = _event_shuffles(decided), _event_shuffles(resolved)
        counted = decided.agg(F.count("*"), F.min("_used"), F.max("_used")).first()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert by_quota and all("_chunk" in k for k in by_quota), by_quota
    assert by_bot and all("_part" in k for k in by_bot), by_bot
    assert tuple(counted) == (500, 3, 502)


def test_a_hot_bot_spans_stretches(spark, monkeypatch):
    """One row a bot in the state, and every event its bot, however many stretches its events lie in."""
    from pyspark.sql import functions as F

    from botlens.operators import bots as BO
    from botlens.schemas import empty

    monkeypatch.setattr(BO, "STRETCH", 7)
    events = spark.range(100).select(
        (F.col("id") + 5).alias("ingest_seq"), F.when(F.col("id") % 3 == 1, "2").otherwise("1").alias("owner_account_id"),
        F.lit("username").alias("bot_type"), F.lit("@Hot ").alias("bot_value"),
        F.timestamp_seconds(F.col("id") * 60).alias("received_at"))
    ok, state, rejected = BO.resolve_bots(events, empty(spark, "bots"), "secret")
    bot, = state.collect()
    assert (bot.owner_account_id, bot.display_name) == ("1", "@hot")
    assert (bot.connected_at - bot.created_at).total_seconds() == 99 * 60
    assert ok.count() == 67 and ok.filter(F.col("bot_id") == bot.id).count() == 67 and rejected.count() == 33
