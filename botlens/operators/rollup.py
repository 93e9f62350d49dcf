"""Mergeable daily rollup of the fact tables, and the overview read from it.

The overview needs totals over all history (message count, mean uptime)
plus windows that all start at a day boundary (today, Monday, the 1st).
A rollup keyed by (bot_id, day) answers all of them exactly: counts and
sums add up, and the latest health status is the maximum of
struct(created_at, id, status).  Every micro-batch can append the rollup of
its own facts (late events simply land on their own day); readers merge the
parts with one small aggregate.  At 100 TB a dashboard then reads bots x days
rows instead of every fact row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botlens.functions import exprs as X
from botlens.functions.clock import Clock, date_lit
from botlens.operators import stats as S
from botlens.operators.ingest import merge_users
from botlens.operators.recent import recent_from_newest
from botlens.schemas import DEFAULT_UPTIME_THRESHOLD
from botlens.sources.tables import Tables

MEASURES = {
    "users": "long", "active_users": "long", "messages": "long", "revenue": "decimal(32,2)", "health_rows": "long",
    "uptime_cents": "long", "requests": "long", "activity": "long",
}

ROLLUP_SCHEMA = ("bot_id string, day date, " + ", ".join(f"{n} {t}" for n, t in MEASURES.items())
                 + ", latest struct<created_at:timestamp,id:string,status:string>")


def _part(df: DataFrame, at: str = "created_at", **measures: Column) -> DataFrame:
    cols = {name: F.lit(None).cast(t) for name, t in MEASURES.items()}
    cols["latest"] = F.lit(None).cast("struct<created_at:timestamp,id:string,status:string>")
    cols.update(measures)
    return df.select("bot_id", F.to_date(at).alias("day"), *[c.alias(n) for n, c in cols.items()])


def daily_rollup(t: Tables) -> DataFrame:
    """(bot_id, day) -> messages, revenue, health rows, uptime cents,
    requests, activity rows, latest health struct of the fact tables that ``t``
    has.  Partial aggregation per part."""
    one = F.lit(1).cast("long")
    parts = []
    if "messages" in t:
        parts.append(_part(t.messages, messages=one))
    if "payments" in t:
        parts.append(_part(t.payments, revenue=F.col("amount").cast("decimal(32,2)")))
    if "bot_health_logs" in t:
        parts.append(_part(t.bot_health_logs, health_rows=one, uptime_cents=(F.col("uptime") * 100).cast("long"),
                           requests=F.col("request_count").cast("long"),
                           latest=F.struct(F.col("created_at"), F.col("id"), F.col("status"))))
    if "activity_logs" in t:
        parts.append(_part(t.activity_logs, activity=one))
    return merge_rollups(reduce(DataFrame.unionByName, parts))


def user_rollup(users: DataFrame) -> DataFrame:
    """The users' part: how many were created, and were last active, on each day.

    It is made from the users state (a later event moves a user's last day), in
    one pass: each user gives a row for both days."""
    one = F.lit(1).cast("long")
    none = F.lit(None).cast("long")
    days = F.array(F.struct(F.to_date("created_at").alias("day"), one.alias("users"), none.alias("active_users")),
                   F.struct(F.to_date("last_active_at").alias("day"), none.alias("users"), one.alias("active_users")))
    rows = users.select("bot_id", F.explode(days).alias("d")).select("bot_id", F.col("d.day").alias("created_at"),
                                                                      "d.users", "d.active_users")
    return merge_rollups(_part(rows, users=F.col("users"), active_users=F.col("active_users")))


def user_step(state: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What one batch does to the users and to their rollup: (new rows of the touched users, signed rollup rows).

    ``delta`` holds the batch's users rows (``merge_users`` form).  The days of a touched user's old row
    are taken back and those of the new row are added, so the sum of all batches' rows is the rollup of
    the present users, and no reader needs the users any more.  Only touched users leave the join.
    """
    keys = ["bot_id", "telegram_id"]
    old = state.join(delta.select(*keys).distinct(), keys, "left_semi")
    new = merge_users(old.unionByName(delta))
    minus = user_rollup(old)
    minus = minus.withColumns({n: -F.col(n) for n in ("users", "active_users")})
    return new, merge_rollups(minus.unionByName(user_rollup(new)))


def full_rollup(t: Tables, activity: bool = True) -> DataFrame:
    """Facts' and users' rollup; each table is read once."""
    facts = Tables({n: df for n, df in t.items() if activity or n != "activity_logs"})
    return merge_rollups(daily_rollup(facts).unionByName(user_rollup(t.users)))


def merge_rollups(rows: DataFrame) -> DataFrame:
    """Combine rollup rows (any number of parts or batches) per (bot, day)."""
    aggs = [F.sum(n).cast(t).alias(n) for n, t in MEASURES.items()]
    return rows.groupBy("bot_id", "day").agg(*aggs, F.max("latest").alias("latest"))


def _half_up_div(num: Column, den: Column) -> Column:
    """round(num / den) half-up for non-negative longs, exactly."""
    n2 = num * 2 + den
    d2 = den * 2
    return ((n2 - F.pmod(n2, d2)).cast("decimal(38,0)") / d2.cast("decimal(38,0)")).cast("long")


def _rollup_measures(rollup: DataFrame, c: Clock, bots, series: bool) -> tuple[DataFrame, dict]:
    """Per-bot measures of the overview, and with ``series`` the maps day -> value
    behind the dashboard's series, in one aggregation of the rollup."""
    day = F.col("day")

    def since(d, col, until=None):
        inside = day >= date_lit(d)
        return F.sum(F.when(inside if until is None else inside & (day < date_lit(until)), F.col(col)))

    def by_day(start, col, typ):
        inside = (day >= date_lit(start)) & (day <= date_lit(c.today)) & F.col(col).isNotNull()
        return F.map_from_entries(F.collect_list(F.when(inside, F.struct(day, F.col(col).cast(typ)))))   # at most 30 days

    d7, d14, m0, m1 = c.days_ago(7), c.days_ago(14), c.month_start, c.prev_month_start
    maps = [by_day(c.days_ago(29), "users", "long").alias("_users"),
            by_day(c.days_ago(29), "revenue", "decimal(22,2)").alias("_revenue"),
            by_day(c.days_ago(29), "messages", "long").alias("_messages"),
            *[since(c.months_ago(n), "users", c.months_ago(n - 1)).cast("long").alias(f"_month{n}") for n in range(6)],
            ] if series else []
    r = S._restrict(rollup, bots).groupBy("bot_id").agg(
        F.sum("users").cast("long").alias("total_users"),
        since(c.today, "active_users").cast("long").alias("active_users_today"),
        since(c.today, "users").cast("long").alias("new_users_today"),
        since(d7, "users").cast("long").alias("weekly_current"),
        since(d14, "users", d7).cast("long").alias("weekly_previous"),
        since(m0, "users").cast("long").alias("monthly_current"),
        since(m1, "users", m0).cast("long").alias("monthly_previous"),
        F.sum("messages").cast("long").alias("total_messages"),
        since(c.today, "messages").cast("long").alias("messages_today"),
        since(c.today, "revenue").cast("decimal(22,2)").alias("revenue_today"),
        since(c.week_start, "revenue").cast("decimal(22,2)").alias("revenue_this_week"),
        since(m0, "revenue").cast("decimal(22,2)").alias("revenue_this_month"),
        F.sum("health_rows").alias("_hn"), F.sum("uptime_cents").alias("_uc"),
        since(c.today, "requests").cast("long").alias("requests_today"),
        F.max("latest").alias("_latest"), *maps)
    cents = F.when(F.col("_hn") > 0, _half_up_div(F.col("_uc"), F.col("_hn")))
    counts = ["total_users", "active_users_today", "new_users_today", "weekly_current", "weekly_previous",
              "monthly_current", "monthly_previous", "total_messages", "messages_today", "revenue_today",
              "revenue_this_week", "revenue_this_month", "requests_today"]
    r = r.select(
        "bot_id", *counts, F.col("_latest.status").alias("bot_status"),
        (cents.cast("decimal(20,0)") / F.lit(100)).cast("decimal(5,2)").alias("uptime_pct"),
        *[x for x in r.columns if x.startswith("_") and x not in ("_hn", "_uc", "_latest")])
    return r, {**dict.fromkeys(counts, 0), "bot_status": "offline", "uptime_pct": 0}


def overview_from_rollup(t: Tables, rollup: DataFrame, as_of, bots=None,
                         uptime_threshold: float = DEFAULT_UPTIME_THRESHOLD) -> DataFrame:
    """Q7 read from a rollup that holds the users' part too."""
    c = as_of if isinstance(as_of, Clock) else Clock.at(as_of)
    out = S.join_measures(S.bot_keys(t, bots), [_rollup_measures(rollup, c, bots, series=False)])
    return out.select(
        "bot_id", "total_users", "active_users_today", "new_users_today",
        "messages_today", "total_messages",
        X.pct_change("weekly_current", "weekly_previous").alias("weekly_growth_pct"),
        "revenue_today", "revenue_this_week", "revenue_this_month",
        "bot_status", S._api_health(uptime_threshold), "uptime_pct", "requests_today")


def _day_series(days: str, start, end, typ: str, name: str) -> Column:
    """Zero-filled array<struct<date, value>> from a map day -> value (null: no rows)."""
    dates = F.sequence(date_lit(start), date_lit(end), F.expr("INTERVAL 1 DAY"))
    return F.transform(dates, lambda d: F.struct(
        X.date_text(d).alias("date"),
        F.coalesce(F.try_element_at(F.col(days), d), F.lit(0).cast(typ)).alias("value"))).alias(name)


def dashboard_from_rollup(t: Tables, rollup: DataFrame, as_of, bots=None, limit: int = 10,
                          uptime_threshold: float = DEFAULT_UPTIME_THRESHOLD, newest: DataFrame | None = None) -> DataFrame:
    """Q18: all six documents from one aggregation of the rollup, and the recent activity: from
    the ``newest`` state (``operators.recent``) if given, else from the activity log."""
    c = as_of if isinstance(as_of, Clock) else Clock.at(as_of)
    m = S.join_measures(S.bot_keys(t, bots), [_rollup_measures(rollup, c, bots, series=True)])
    months = F.array(*[F.struct(F.lit(c.months_ago(n).isoformat()).alias("date"),
                                F.coalesce(f"_month{n}", F.lit(0).cast("long")).alias("value")) for n in range(5, -1, -1)])
    m = m.select(
        "*", _day_series("_users", c.days_ago(6), c.today, "long", "weekly_series"), months.alias("monthly_series"),
        _day_series("_users", c.days_ago(29), c.today, "long", "growth_series"),
        _day_series("_revenue", c.days_ago(29), c.today, "decimal(22,2)", "revenue_series"),
        _day_series("_messages", c.days_ago(29), c.today, "long", "daily_messages_series"))
    recent = S.recent_activity(t, limit, bots) if newest is None else recent_from_newest(newest, limit, bots)
    return S.assemble_dashboard(bots, m, recent, uptime_threshold)


def account_usage_from_rollup(t: Tables, rollup: DataFrame, as_of, owners=None) -> DataFrame:
    """Q19 (bots per owner, activity rows since the 1st) from the rollup, so
    the per-batch quota base costs bots x days rows, not a month of facts."""
    from botlens.operators.accounts import _restrict_owner
    c = as_of if isinstance(as_of, Clock) else Clock.at(as_of)
    accounts = _restrict_owner(t.accounts.select(F.col("id").alias("account_id")), owners, "account_id")
    bots = t.bots.select(F.col("id").alias("bot_id"), F.col("owner_account_id").alias("account_id"))
    bot_count = bots.groupBy("account_id").agg(F.count(F.lit(1)).alias("total_bots"))
    per_bot = (rollup.filter(F.col("day") >= date_lit(c.month_start))
               .groupBy("bot_id").agg(F.sum("activity").alias("n")))
    events = per_bot.join(bots, "bot_id").groupBy("account_id").agg(
        F.sum("n").cast("long").alias("monthly_events"))
    return (accounts.join(bot_count, "account_id", "left").join(events, "account_id", "left")
            .select("account_id",
                    F.coalesce("total_bots", F.lit(0).cast("long")).alias("total_bots"),
                    F.coalesce("monthly_events", F.lit(0).cast("long")).alias("monthly_events")))
