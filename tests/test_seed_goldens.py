"""Goldens from the reference's demo seed at 2026-03-18 12:00:00Z (Wednesday)."""

from decimal import Decimal

import pytest

from botlens.operators import accounts as A
from botlens.operators import stats as S
from botlens.operators.seed import BOT1, BOT2, generate_seed

AS_OF = "2026-03-18 12:00:00"


@pytest.fixture(scope="module")
def seed(spark):
    return generate_seed(spark, AS_OF)


def one(df, bot=BOT1):
    return [r for r in df.collect() if r["bot_id"] == bot][0]


def test_row_counts(seed):
    assert seed.users.count() == 120
    assert seed.messages.count() == 360
    assert seed.payments.count() == 60
    assert seed.bot_health_logs.count() == 30
    assert seed.activity_logs.count() == 5


def test_overview(seed):
    r = one(S.overview(seed, AS_OF))
    assert (r.total_users, r.active_users_today, r.new_users_today) == (120, 120, 0)
    assert (r.total_messages, r.messages_today) == (360, 12)
    assert r.weekly_growth_pct == Decimal("0.00")
    assert (r.revenue_today, r.revenue_this_week, r.revenue_this_month) == (
        Decimal("74.85"), Decimal("209.58"), Decimal("1377.24"))
    assert (r.bot_status, r.uptime_pct, r.requests_today, r.api_health) == (
        "online", Decimal("99.70"), 10, "healthy")
    z = one(S.overview(seed, AS_OF), BOT2)
    assert (z.total_users, z.bot_status, z.uptime_pct, z.api_health) == (0, "offline", Decimal("0.00"), "degraded")


def test_growth(seed):
    w = one(S.weekly_growth(seed, AS_OF))
    assert (w.current_period, w.previous_period, w.growth_pct) == (28, 28, Decimal("0.00"))
    m = one(S.monthly_growth(seed, AS_OF))
    assert (m.current_period, m.previous_period, m.growth_pct) == (68, 52, Decimal("30.77"))
    ws = sorted((r.bucket_date.isoformat(), r.value) for r in S.weekly_user_series(seed, AS_OF).collect()
                if r.bot_id == BOT1)
    assert [v for _, v in ws] == [4, 4, 4, 4, 4, 4, 0] and ws[0][0] == "2026-03-12"
    ms = sorted((r.bucket_date, r.value) for r in S.monthly_user_series(seed, AS_OF).collect() if r.bot_id == BOT1)
    assert [v for _, v in ms] == [0, 0, 0, 0, 52, 68]


def test_daily_series(seed):
    us = sorted((r.bucket_date, r.value) for r in S.daily_user_series(seed, AS_OF).collect() if r.bot_id == BOT1)
    assert [v for _, v in us] == [4] * 29 + [0]
    ms = [r.value for r in S.daily_message_series(seed, AS_OF).collect() if r.bot_id == BOT1]
    assert ms == [12] * 30
    rs = sorted(((r.bucket_date, r.value) for r in S.daily_revenue_series(seed, AS_OF).collect()
                 if r.bot_id == BOT1), reverse=True)
    expect = ["74.85", "59.88", "74.85", "89.82", "104.79", "74.85", "89.82", "59.88", "74.85", "44.91",
              "59.88", "74.85", "89.82", "104.79", "74.85", "89.82", "59.88", "74.85", "44.91", "59.88"]
    assert [str(v) for _, v in rs[:20]] == expect
    assert all(v == 0 for _, v in rs[20:])


def test_recent_activity(seed):
    rows = sorted((r for r in S.recent_activity(seed).collect() if r.bot_id == BOT1), key=lambda r: r["rank"])
    assert [r.description for r in rows] == [
        "Message received from tg-user-101", "Message received from tg-user-110",
        "Payment of 19.96 USD", "Message received from tg-user-118", "User tg-user-119 joined"]


def test_account_side(seed):
    u = A.account_usage(seed, AS_OF).collect()[0]
    assert (u.total_bots, u.monthly_events) == (2, 5)
    bots = A.owner_bots(seed, AS_OF, ordered=True).collect()
    assert [(b.bot_id, b.total_users, b.total_messages, str(b.revenue_this_month)) for b in bots] == [
        (BOT2, 0, 0, "0.00"), (BOT1, 120, 360, "1377.24")]
    s = A.current_subscription(seed.subscriptions).collect()[0]
    assert (s.provider, s.plan, s.status, str(s.amount_monthly), s.currency) == (
        "manual", "starter", "active", "29.00", "USD")


def test_dashboard_shape(seed):
    d = one(S.dashboard(seed, AS_OF))
    assert d.overview.total_users == 120
    assert len(d.growth.weekly_series) == 7 and len(d.users.growth_series) == 30
    assert len(d.recent_activity) == 5
