"""Sequential rules computed in one batch equal a one-at-a-time Python fold."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from botlens.operators import ingest as I


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quota_matches_fold(spark, seed):
    """The operator itself against one request at a time: owners near their limits, two
    months in one batch, an owner whose plan the catalogue does not know."""
    rnd = random.Random(seed)
    plans = {"a": "starter", "b": "growth", "c": "starter", "d": "gold"}
    limits = {"starter": 5000, "growth": 250000}
    left = {("a", 1): 40, ("a", 2): 5, ("b", 1): 90, ("b", 2): 0, ("c", 1): -3, ("c", 2): 500, ("d", 1): 9, ("d", 2): 9}
    used = {(o, m): limits.get(plans[o], 5000) - n for (o, m), n in left.items()}
    usage = spark.createDataFrame([(o, date(2024, m, 1), n) for (o, m), n in used.items()],
                                  "account_id string, month date, monthly_events long")
    rows, expect = [], {}
    for seq in range(800):
        owner, month, counts = rnd.choice("abcd"), rnd.choice([1, 1, 2]), rnd.random() < 0.7
        rows.append((seq, owner, plans[owner], datetime(2024, month, rnd.randint(1, 28)), counts))
        ok = owner != "d" and used[owner, month] < limits[plans[owner]]
        expect[seq] = None if ok else used[owner, month]
        if ok and counts:
            used[owner, month] += 1
    events = spark.createDataFrame(rows, "ingest_seq long, owner_account_id string, plan string, received_at timestamp, c boolean")
    acc, rej = I.enforce_event_quota(events, usage, F.col("c"), chunk=64)
    got = {r.ingest_seq: None for r in acc.collect()}
    for r in rej.collect():
        assert r.ingest_seq not in got and r.error_code == "PLAN_LIMIT_REACHED"
        got[r.ingest_seq] = int(r.error_detail.split(" ")[1].rstrip(","))
    known = {s: v for s, v in expect.items() if rows[s][1] != "d"}
    assert {s: got[s] for s in known} == known
    assert all(got[s] is not None for s in expect if rows[s][1] == "d") and len(got) == len(rows)
    assert sum(v is not None for v in known.values()) > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_quota_by_the_plan_in_force_matches_fold(spark, seed):
    """Plans that rise, fall and become unknown between events, one request at a time."""
    rnd = random.Random(seed)
    limits = {"starter": 5000, "growth": 250000}
    plan = {"a": "starter", "b": "growth", "c": "starter", "d": "gold"}
    used = {(o, m): 4990 - 7 * m for o in plan for m in (1, 2)} | {("b", 1): 249_999}
    usage = spark.createDataFrame([(o, date(2024, m, 1), n) for (o, m), n in used.items()],
                                  "account_id string, month date, monthly_events long")
    rows, changes, expect = [], [], {}
    start = dict(plan)
    for seq in range(900):
        owner, month, counts = rnd.choice("aaabcd"), rnd.choice([1, 1, 2]), rnd.random() < 0.7
        if owner != "b" and rnd.random() < 0.08:       # b stays where it is refused on growth
            plan[owner] = rnd.choice(["starter", "starter", "growth", "gold"])
            changes.append((owner, seq, plan[owner]))
            continue
        rows.append((seq, owner, start[owner], datetime(2024, month, rnd.randint(1, 28)), counts))
        ok = used[owner, month] < limits.get(plan[owner], 0)
        expect[seq] = (plan[owner], used[owner, month], ok)
        used[owner, month] += ok and counts
    rows.append((900, None, "starter", datetime(2024, 1, 1), True))
    events = spark.createDataFrame(rows, "ingest_seq long, owner_account_id string, plan string, received_at timestamp, c boolean")
    moved = spark.createDataFrame(changes, "owner_account_id string, ingest_seq long, plan string")
    got = {r.ingest_seq: r for r in I.decide_event_quota_as_of(events, usage, moved, F.col("c"), chunk=64).collect()}
    assert got.pop(900)._ok is False and len(got) == len(expect)
    assert {s: (r.plan, r._used, r._ok) for s, r in got.items()} == expect
    assert len({s[::2] for s in expect.values()}) == 5
    none = I.decide_event_quota_as_of(events, usage, moved.limit(0), F.col("c"), chunk=64)
    plain = I.decide_event_quota(events.filter("owner_account_id is not null"), usage, F.col("c"), chunk=64)
    same = lambda df: sorted((r.ingest_seq, r._used, r._ok) for r in df.collect() if r.ingest_seq < 900)
    assert same(none) == same(plain)


def test_batch_takes_a_plan_change_at_once(spark):
    """Owners of the batch that are refused on starter are upgraded in its middle: from there on none is refused."""
    from botlens.plans import catalog as C
    from botlens.plans.ingest_batch import ingest_api_batch
    from botlens.sources import raw as RAW
    sf_dir, middle = "/root/testdata/sf0.001", 500
    t = C.tables_a(spark, sf_dir)
    usage = t.accounts.select(F.col("id").alias("account_id"),
                              F.when(F.col("plan") == "starter", 4990).otherwise(0).cast("long").alias("monthly_events"))
    moved = t.accounts.filter("plan = 'starter'").select(F.col("id").alias("owner_account_id"),
                                                         F.lit(middle).cast("long").alias("ingest_seq"), F.lit("growth").alias("plan"))
    raw = C._landed(RAW.api_events(spark, sf_dir), "raw-as-of")

    def refused(changes):
        out = ingest_api_batch(raw, t, C.SECRETS, usage_at=lambda clock: usage, plan_changes=changes)
        return {r.ingest_seq for r in out.rejected.filter("error_code = 'PLAN_LIMIT_REACHED'").collect()}

    plain, changed = refused(None), refused(moved)
    assert changed == {s for s in plain if s < middle} and 0 < len(changed) < len(plain)
    assert refused(moved.limit(0)) == plain


def test_upsert_users_split_batches(spark):
    rnd = random.Random(3)
    rows = [("b1", str(rnd.randint(1, 20)), rnd.choice(["x", None, "y"]), None, None,
             f"2024-01-{rnd.randint(1, 28):02d} 10:00:00", s) for s in range(300)]
    schema = ("bot_id string, telegram_id string, username string, first_name string, "
              "last_name string, event_time string, seq long")
    arr = spark.createDataFrame(rows, schema).withColumn("event_time", F.col("event_time").cast("timestamp"))
    empty = I.arrivals_to_users(arr.limit(0))
    whole = I.upsert_users(empty, arr)
    part1 = I.upsert_users(empty, arr.filter("seq < 150"))
    split = I.upsert_users(part1, arr.filter("seq >= 150"))
    key = lambda r: (r.bot_id, r.telegram_id)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)
    # fold check: created_at is the first arrival's time, username the last arrival's (nulls too)
    first, last = {}, {}
    for r in rows:
        first.setdefault(r[1], r)
        last[r[1]] = r
    for r in whole.collect():
        assert r.username == last[r.telegram_id][2]
        assert r.created_at.strftime("%Y-%m-%d %H:%M:%S") == first[r.telegram_id][5]


def test_last_non_null_matches_fold(spark):
    from botlens.functions.sequential import last_non_null
    rnd = random.Random(11)
    rows = [(s, rnd.choice(["a", "b"]), rnd.choice([None, None, None, f"c{s}"])) for s in range(400)]
    df = spark.createDataFrame(rows, "seq long, k string, v string")
    got = {r.seq: r.out for r in last_non_null(df, ["k"], "seq", "v", "out", chunk=16).collect()}
    cur, expect = {}, {}
    for seq, k, v in rows:
        if v is not None:
            cur[k] = v
        expect[seq] = cur.get(k)
    assert got == expect
