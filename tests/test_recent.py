"""The newest-activity state: any split into batches and any order of merging gives the log's answer."""

import random

from pyspark.sql import functions as F

from botlens.operators import recent, rollup, stats
from botlens.operators.ingest import merge_users
from botlens.plans import catalog
from botlens.session import stage
from botlens.sources import fixtures as FX
from botlens.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merged_in_any_grouping(spark):
    rng = random.Random(5)
    log = []
    for i in range(900):
        bot = rng.choice("aaaab") if i % 50 else "rare"
        log.append((f"{i:04d}", bot, rng.choice(["message", "payment", "x"]), rng.choice(["Message received from 7", "odd"]),
                    rng.choice([None, "", "message.received"]), rng.choice(["{}", None]), f"2024-01-{rng.choice([1, 2, 2, 2, 29]):02d} "
                    f"00:00:{rng.randrange(3):02d}"))
    activity = stage(spark.createDataFrame(log, "id string, bot_id string, event_type string, description string, event_code string, "
                                                "params string, at string").withColumn("created_at", F.col("at").cast("timestamp")))
    want = rows(stats.recent_activity(Tables(activity_logs=activity)))
    assert len(want) == 30
    batch = F.pmod(F.xxhash64("id"), F.lit(3))
    a, b, c = (recent.newest_daily(activity.filter(batch == n)) for n in range(3))
    assert rows(recent.recent_from_newest(a.unionByName(b).unionByName(c))) == want
    left = recent.merge_newest(recent.merge_newest(a.unionByName(b)).unionByName(c))
    right = recent.merge_newest(a.unionByName(recent.merge_newest(c.unionByName(b))))
    assert rows(left) == rows(right) == rows(recent.newest_daily(activity))
    assert rows(recent.recent_from_newest(left)) == want
    assert rows(recent.recent_from_newest(left, 3, ["a"])) == [r for r in want if r[0] == "a" and r[1] <= 3]
    assert left.filter(F.size("newest") > recent.NEWEST).count() == 0


def test_dashboard_plan_reads_no_facts(spark):
    t = FX.mapping_a(spark, SF)
    r, n = stage(rollup.full_rollup(t), "plan-rollup"), stage(recent.newest_daily(t.activity_logs), "plan-newest")
    only = Tables(bots=t.bots)                        # neither users nor facts are at hand
    got = stats.to_document_json(rollup.dashboard_from_rollup(only, r, FX.AS_OF_A, newest=n))
    assert "events.parquet" not in got._jdf.queryExecution().toString()
    assert rows(got) == rows(stats.to_document_json(stats.dashboard(t, FX.AS_OF_A)))


def test_signed_user_rows(spark):
    """Each step's rows take back the touched users' old days; untouched users are not in them."""
    t = FX.mapping_a(spark, SF)
    state, parts = None, []
    from botlens.schemas import empty
    state = empty(spark, "users")
    for batch in catalog.user_batches(t):
        delta = merge_users(batch)
        new, signed = rollup.user_step(state, delta)
        assert new.count() == delta.count()
        assert signed.agg(F.sum("users")).first()[0] == new.count() - state.join(delta, ["bot_id", "telegram_id"], "left_semi").count()
        parts.append(stage(signed))
        state = stage(state.join(new, ["bot_id", "telegram_id"], "left_anti").select(*new.columns).unionByName(new))
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    got = rollup.merge_rollups(got).filter("users <> 0 or active_users <> 0").selectExpr(
        "bot_id", "day", "coalesce(users, 0)", "coalesce(active_users, 0)")
    want = rollup.user_rollup(t.users).selectExpr("bot_id", "day", "coalesce(users, 0)", "coalesce(active_users, 0)")
    assert rows(got) == rows(want)
