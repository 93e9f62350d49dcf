"""Per-bot analytics for ALL bots in one pass.

The reference runs each statement for one bot (``WHERE bot_id = $1``).
Here every measure is a conditional aggregate grouped by ``bot_id``:
Spark aggregates partially on the map side, so the shuffle carries at most
one row per bot per input partition and a hot bot is harmless.  Results
are left-joined from ``bots`` so bots without facts get the zero answer.
Passing ``bots`` (ids or a DataFrame with ``bot_id``) restricts the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from botlens.functions import exprs as X
from botlens.functions.clock import Clock, date_lit, ts_lit
from botlens.schemas import DEFAULT_UPTIME_THRESHOLD
from botlens.sources.tables import Tables


def _clock(as_of) -> Clock:
    return as_of if isinstance(as_of, Clock) else Clock.at(as_of)


def bot_keys(t: Tables, bots=None) -> DataFrame:
    keys = t.bots.select(F.col("id").alias("bot_id"))
    return _restrict(keys, bots)


def _restrict(df: DataFrame, bots) -> DataFrame:
    if bots is None:
        return df
    if isinstance(bots, DataFrame):
        return df.join(bots.select("bot_id").distinct(), "bot_id", "left_semi")
    return df.filter(F.col("bot_id").isin([str(b) for b in bots]))


def _zero_fill(keys: DataFrame, agg: DataFrame, defaults: dict) -> DataFrame:
    """Left join per-bot aggregates to the bot list and fill defaults."""
    joined = keys.join(agg, "bot_id", "left")
    cols = [F.col("bot_id")]
    for name in agg.columns:
        if name == "bot_id":
            continue
        c = F.col(name)
        cols.append(F.coalesce(c, F.lit(defaults[name]).cast(agg.schema[name].dataType))
                    .alias(name) if name in defaults else c)
    return joined.select(cols)


def _count_if(cond: Column) -> Column:
    return F.count_if(cond)


# --- Q1 / Q4 / Q5: one pass over users --------------------------------------

def _user_agg(t: Tables, as_of, bots=None):
    """All user counters of Q1, Q4 and Q5 from a single scan of ``users``."""
    c = _clock(as_of)
    created, active = F.col("created_at"), F.col("last_active_at")
    today = ts_lit(c.today)
    d7, d14 = ts_lit(c.days_ago(7)), ts_lit(c.days_ago(14))
    m0, m1 = ts_lit(c.month_start), ts_lit(c.prev_month_start)
    agg = _restrict(t.users, bots).groupBy("bot_id").agg(
        F.count(F.lit(1)).alias("total_users"),
        _count_if(active >= today).alias("active_users_today"),
        _count_if(created >= today).alias("new_users_today"),
        _count_if(created >= d7).alias("weekly_current"),
        _count_if((created >= d14) & (created < d7)).alias("weekly_previous"),
        _count_if(created >= m0).alias("monthly_current"),
        _count_if((created >= m1) & (created < m0)).alias("monthly_previous"))
    return agg, {n: 0 for n in agg.columns if n != "bot_id"}


def user_measures(t: Tables, as_of, bots=None) -> DataFrame:
    return _zero_fill(bot_keys(t, bots), *_user_agg(t, as_of, bots))


def user_window(t: Tables, as_of, bots=None) -> DataFrame:
    """Q1: total users, active today, new today."""
    return user_measures(t, as_of, bots).select(
        "bot_id", "total_users", "active_users_today", "new_users_today")


def weekly_growth(t: Tables, as_of, bots=None) -> DataFrame:
    """Q4: users created since today-7d vs the 7 days before, with percent."""
    m = user_measures(t, as_of, bots)
    return m.select("bot_id", F.col("weekly_current").alias("current_period"),
                    F.col("weekly_previous").alias("previous_period"),
                    X.pct_change("weekly_current", "weekly_previous").alias("growth_pct"))


def monthly_growth(t: Tables, as_of, bots=None) -> DataFrame:
    """Q5: users created this calendar month vs the previous month."""
    m = user_measures(t, as_of, bots)
    return m.select("bot_id", F.col("monthly_current").alias("current_period"),
                    F.col("monthly_previous").alias("previous_period"),
                    X.pct_change("monthly_current", "monthly_previous").alias("growth_pct"))


# --- Q2 / Q3 / Q6 ---------------------------------------------------------------

def _message_agg(t: Tables, as_of, bots=None):
    c = _clock(as_of)
    agg = _restrict(t.messages, bots).groupBy("bot_id").agg(
        F.count(F.lit(1)).alias("total_messages"),
        _count_if(F.col("created_at") >= ts_lit(c.today)).alias("messages_today"))
    return agg, {"total_messages": 0, "messages_today": 0}


def message_window(t: Tables, as_of, bots=None) -> DataFrame:
    """Q2: total messages and messages since midnight."""
    return _zero_fill(bot_keys(t, bots), *_message_agg(t, as_of, bots))


def _revenue_agg(t: Tables, as_of, bots=None):
    c = _clock(as_of)
    amount, created = F.col("amount"), F.col("created_at")

    def since(bound):
        return F.sum(F.when(created >= ts_lit(bound), amount))

    agg = _restrict(t.payments, bots).groupBy("bot_id").agg(
        since(c.today).alias("revenue_today"),
        since(c.week_start).alias("revenue_this_week"),
        since(c.month_start).alias("revenue_this_month"))
    return agg, {"revenue_today": 0, "revenue_this_week": 0, "revenue_this_month": 0}


def revenue_window(t: Tables, as_of, bots=None) -> DataFrame:
    """Q3: revenue since today / Monday / the 1st; currencies are not split."""
    return _zero_fill(bot_keys(t, bots), *_revenue_agg(t, as_of, bots))


def _health_agg(t: Tables, as_of, bots=None):
    c = _clock(as_of)
    created = F.col("created_at")
    agg = _restrict(t.bot_health_logs, bots).groupBy("bot_id").agg(
        F.max_by("status", F.struct(created, F.col("id"))).alias("bot_status"),
        F.round(F.avg(F.col("uptime").cast("decimal(22,14)")), 2)
         .cast("decimal(5,2)").alias("uptime_pct"),
        F.sum(F.when(created >= ts_lit(c.today), F.col("request_count")))
         .cast("long").alias("requests_today"))
    return agg, {"bot_status": "offline", "uptime_pct": 0, "requests_today": 0}


def _api_health(threshold) -> Column:
    healthy = F.col("uptime_pct") >= F.lit(threshold)
    return F.when(healthy, "healthy").otherwise("degraded").alias("api_health")


def health_summary(t: Tables, as_of, bots=None,
                   uptime_threshold: float = DEFAULT_UPTIME_THRESHOLD) -> DataFrame:
    """Q6: latest status, mean uptime over all history, requests today."""
    filled = _zero_fill(bot_keys(t, bots), *_health_agg(t, as_of, bots))
    return filled.select("bot_id", "bot_status", "uptime_pct", "requests_today",
                         _api_health(uptime_threshold))


def join_measures(keys: DataFrame, parts) -> DataFrame:
    """Left join several per-bot aggregates onto one bot list, then fill.

    Every aggregate is already hash partitioned by bot_id, so the joins
    line up without re-shuffling the aggregated sides.
    """
    out, defaults, types = keys, {}, {}
    for agg, dflt in parts:
        out = out.join(agg, "bot_id", "left")
        defaults.update(dflt)
        types.update({f.name: f.dataType for f in agg.schema.fields})
    return out.select([F.coalesce(F.col(n), F.lit(defaults[n]).cast(types[n])).alias(n)
                       if n in defaults else F.col(n) for n in out.columns])


def overview(t: Tables, as_of, bots=None,
             uptime_threshold: float = DEFAULT_UPTIME_THRESHOLD) -> DataFrame:
    """Q7: the 13-measure overview row per bot."""
    out = join_measures(bot_keys(t, bots), [
        _user_agg(t, as_of, bots), _message_agg(t, as_of, bots),
        _revenue_agg(t, as_of, bots), _health_agg(t, as_of, bots)])
    return out.select(
        "bot_id", "total_users", "active_users_today", "new_users_today",
        "messages_today", "total_messages",
        X.pct_change("weekly_current", "weekly_previous").alias("weekly_growth_pct"),
        "revenue_today", "revenue_this_week", "revenue_this_month",
        "bot_status", _api_health(uptime_threshold), "uptime_pct", "requests_today")


# --- J2: zero-filled series --------------------------------------------------------

def _series(t: Tables, facts: DataFrame, bots, start, end, value: Column,
            monthly: bool = False, zero=0) -> DataFrame:
    """Buckets [start..end] per bot; facts aggregated by (bot, bucket) first.

    The spine is generated from the bot list with ``explode(sequence)``
    (no join input grows with the facts), then joined by equality on
    (bot_id, bucket_date); the reference's LATERAL range join is avoided.
    """
    created = F.col("created_at")
    if monthly:
        bucket = F.trunc(created, "MM")
        hi = ts_lit(_next_month(end))
        step = F.expr("INTERVAL 1 MONTH")
    else:
        bucket = F.to_date(created)
        hi = ts_lit(end) + F.expr("INTERVAL 1 DAY")
        step = F.expr("INTERVAL 1 DAY")
    agg = (_restrict(facts, bots)
           .filter((created >= ts_lit(start)) & (created < hi))
           .groupBy("bot_id", bucket.alias("bucket_date"))
           .agg(value.alias("value")))
    return fill_series(t, agg, bots, start, end, step, zero)


def fill_series(t: Tables, agg: DataFrame, bots, start, end, step: Column | None = None, zero=0) -> DataFrame:
    """(bot_id, bucket_date, value) rows as a series without gaps for every bot."""
    step = F.expr("INTERVAL 1 DAY") if step is None else step
    spine = bot_keys(t, bots).select(
        "bot_id", F.explode(F.sequence(date_lit(start), date_lit(end), step)).alias("bucket_date"))
    return (spine.join(agg, ["bot_id", "bucket_date"], "left")
            .select("bot_id", "bucket_date",
                    F.coalesce("value", F.lit(zero).cast(agg.schema["value"].dataType))
                     .alias("value")))


def _next_month(d):
    from botlens.functions.clock import _add_months
    return _add_months(d, 1)


def weekly_user_series(t: Tables, as_of, bots=None) -> DataFrame:
    """Q8: new users per day, today-6 .. today."""
    c = _clock(as_of)
    return _series(t, t.users, bots, c.days_ago(6), c.today, F.count(F.lit(1)))


def monthly_user_series(t: Tables, as_of, bots=None) -> DataFrame:
    """Q9: new users per calendar month, six months up to the current one."""
    c = _clock(as_of)
    return _series(t, t.users, bots, c.months_ago(5), c.month_start, F.count(F.lit(1)),
                   monthly=True)


def daily_user_series(t: Tables, as_of, bots=None) -> DataFrame:
    """Q11: new users per day over 30 days."""
    c = _clock(as_of)
    return _series(t, t.users, bots, c.days_ago(29), c.today, F.count(F.lit(1)))


def daily_revenue_series(t: Tables, as_of, bots=None) -> DataFrame:
    """Q13: revenue per day over 30 days (2 decimals)."""
    c = _clock(as_of)
    return _series(t, t.payments, bots, c.days_ago(29), c.today, F.sum("amount"))


def daily_message_series(t: Tables, as_of, bots=None) -> DataFrame:
    """Q15: messages per day over 30 days."""
    c = _clock(as_of)
    return _series(t, t.messages, bots, c.days_ago(29), c.today, F.count(F.lit(1)))


def nest_series(series: DataFrame, name: str) -> DataFrame:
    """Long series -> one row per bot with array<struct<date, value>>.

    Each bot has a fixed number of buckets (7, 6 or 30), so the collected
    array is bounded regardless of data size.
    """
    return series.groupBy("bot_id").agg(
        F.array_sort(F.collect_list(F.struct(X.date_text("bucket_date").alias("date"),
                                             F.col("value")))).alias(name))


# --- composites --------------------------------------------------------------------

def growth(t: Tables, as_of, bots=None) -> DataFrame:
    """Q10: weekly and monthly growth percent plus both series."""
    m = user_measures(t, as_of, bots)
    return (m.select("bot_id",
                     X.pct_change("weekly_current", "weekly_previous").alias("weekly_growth_pct"),
                     X.pct_change("monthly_current", "monthly_previous").alias("monthly_growth_pct"))
            .join(nest_series(weekly_user_series(t, as_of, bots), "weekly_series"), "bot_id")
            .join(nest_series(monthly_user_series(t, as_of, bots), "monthly_series"), "bot_id"))


def user_stats(t: Tables, as_of, bots=None) -> DataFrame:
    """Q12: Q1 plus the 30-day growth series."""
    return user_window(t, as_of, bots).join(
        nest_series(daily_user_series(t, as_of, bots), "growth_series"), "bot_id")


def revenue_stats(t: Tables, as_of, bots=None) -> DataFrame:
    """Q14: Q3 plus the 30-day revenue series."""
    return revenue_window(t, as_of, bots).join(
        nest_series(daily_revenue_series(t, as_of, bots), "revenue_series"), "bot_id")


def message_stats(t: Tables, as_of, bots=None) -> DataFrame:
    """Q16: Q2 plus the 30-day message series."""
    return message_window(t, as_of, bots).join(
        nest_series(daily_message_series(t, as_of, bots), "daily_messages_series"), "bot_id")


# --- Q17 -----------------------------------------------------------------------------

def recent_activity(t: Tables, limit: int = 10, bots=None) -> DataFrame:
    """Q17: newest ``limit`` activity rows per bot with resolved code/params.

    ``row_number`` over (bot_id) filtered by rank lets Spark plan a
    WindowGroupLimit: every map task keeps only its top ``limit`` rows per
    bot before the shuffle, so one very active bot moves ``limit`` rows
    per task, not all of its history.  Ties on created_at break by id.
    """
    w = Window.partitionBy("bot_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    ranked = (_restrict(t.activity_logs, bots)
              .withColumn("rank", F.row_number().over(w))
              .filter(F.col("rank") <= limit))
    return resolved_activity(ranked)


def resolved_activity(ranked: DataFrame) -> DataFrame:
    """Ranked activity rows with their stored code and params, or those read from the description."""
    code, params = X.activity_fallback("event_type", "description")
    stored = F.col("event_code").isNotNull() & (F.col("event_code") != "")
    return ranked.select(
        "bot_id", "rank", "id", "event_type", "description",
        F.when(stored, F.col("event_code")).otherwise(code).alias("event_code"),
        F.when(stored, F.coalesce(F.col("params"), F.lit("{}"))).otherwise(params).alias("params"),
        X.iso_text("created_at").alias("created_at"))


# --- Q18 -----------------------------------------------------------------------------

def dashboard(t: Tables, as_of, bots=None, limit: int = 10,
              uptime_threshold: float = DEFAULT_UPTIME_THRESHOLD) -> DataFrame:
    """Q18: one row per bot with the six dashboard documents as structs.

    The reference issues 16 statements per bot; here users, messages, payments
    and health logs are each read once, into one (bot, day) aggregate from
    which all windows and series follow (they start at day boundaries), and
    the activity log once, for the newest rows.
    """
    from botlens.operators.rollup import dashboard_from_rollup, full_rollup
    return dashboard_from_rollup(t, full_rollup(t, activity=False), as_of, bots, limit, uptime_threshold)


def assemble_dashboard(bots, m: DataFrame, ra: DataFrame, uptime_threshold) -> DataFrame:
    """The dashboard structs from per-bot measures and series, with the recent activity ``ra``."""
    ra_nested = ra.groupBy("bot_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "id", "event_type", "description", "event_code", "params", "created_at")))
        .alias("recent_activity"))
    m = m.join(ra_nested, "bot_id", "left")
    weekly_pct = X.pct_change("weekly_current", "weekly_previous")
    return m.select(
        "bot_id",
        F.struct("total_users", "active_users_today", "new_users_today", "messages_today",
                 "total_messages", weekly_pct.alias("weekly_growth_pct"), "revenue_today",
                 "revenue_this_week", "revenue_this_month", "bot_status",
                 _api_health(uptime_threshold), "uptime_pct", "requests_today").alias("overview"),
        F.struct(weekly_pct.alias("weekly_growth_pct"),
                 X.pct_change("monthly_current", "monthly_previous").alias("monthly_growth_pct"),
                 "weekly_series", "monthly_series").alias("growth"),
        F.struct("total_users", "active_users_today", "new_users_today",
                 "growth_series").alias("users"),
        F.struct("revenue_today", "revenue_this_week", "revenue_this_month",
                 "revenue_series").alias("revenue"),
        F.struct("total_messages", "messages_today", "daily_messages_series").alias("messages"),
        F.coalesce("recent_activity", F.array().cast(ra_nested.schema["recent_activity"].dataType))
         .alias("recent_activity"))


def to_document_json(df: DataFrame, key: str = "bot_id") -> DataFrame:
    """Render each row as one JSON document (``to_json(struct(*))``)."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("document"))
