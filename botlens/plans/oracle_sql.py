"""ANSI SQL (DuckDB) oracles for the registered queries.

Each string starts from the driver's raw views, rebuilds the domain tables
with the fixture CTEs, and answers the query the way the reference's SQL
does for one bot, generalised to all bots with GROUP BY.
"""

from __future__ import annotations

from botlens.functions.clock import Clock, sql_date, sql_ts
from botlens.sources.fixtures import AS_OF_A, AS_OF_B, contract_tables_sql, mapping_a_sql, mapping_b_sql

ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def iso(c: str) -> str:
    return ISO.format(c=c)


def pct(cur: str, prev: str) -> str:
    cents = (f"CASE WHEN {prev} = 0 THEN CASE WHEN {cur} = 0 THEN 0 ELSE 10000 END "
             f"ELSE sign({cur} - {prev}) * ((abs({cur} - {prev}) * 20000 + {prev}) // (2 * {prev})) END")
    return f"CAST(CAST({cents} AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2))"


def js_num(c: str) -> str:
    return f"regexp_replace(CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', '')"


def _bounds(c: Clock) -> dict:
    return dict(
        today=sql_ts(c.today), d7=sql_ts(c.days_ago(7)), d14=sql_ts(c.days_ago(14)),
        m0=sql_ts(c.month_start), m1=sql_ts(c.prev_month_start), wk=sql_ts(c.week_start))


def user_agg(c: Clock) -> str:
    b = _bounds(c)
    return f"""u_agg AS (
  SELECT bot_id, count(*) AS total_users,
         count(*) FILTER (WHERE last_active_at >= {b['today']}) AS active_users_today,
         count(*) FILTER (WHERE created_at >= {b['today']}) AS new_users_today,
         count(*) FILTER (WHERE created_at >= {b['d7']}) AS weekly_current,
         count(*) FILTER (WHERE created_at >= {b['d14']} AND created_at < {b['d7']}) AS weekly_previous,
         count(*) FILTER (WHERE created_at >= {b['m0']}) AS monthly_current,
         count(*) FILTER (WHERE created_at >= {b['m1']} AND created_at < {b['m0']}) AS monthly_previous
  FROM d_users GROUP BY bot_id)"""


def message_agg(c: Clock) -> str:
    b = _bounds(c)
    return f"""m_agg AS (
  SELECT bot_id, count(*) AS total_messages,
         count(*) FILTER (WHERE created_at >= {b['today']}) AS messages_today
  FROM d_messages GROUP BY bot_id)"""


def revenue_agg(c: Clock) -> str:
    b = _bounds(c)
    return f"""r_agg AS (
  SELECT bot_id,
         sum(amount) FILTER (WHERE created_at >= {b['today']}) AS revenue_today,
         sum(amount) FILTER (WHERE created_at >= {b['wk']}) AS revenue_this_week,
         sum(amount) FILTER (WHERE created_at >= {b['m0']}) AS revenue_this_month
  FROM d_payments GROUP BY bot_id)"""


def health_agg(c: Clock) -> str:
    b = _bounds(c)
    return f"""h_agg AS (
  SELECT bot_id, arg_max(status, (created_at, id)) AS bot_status,
         CAST(CAST((2 * sum(CAST(uptime * 100 AS BIGINT)) + count(*)) // (2 * count(*)) AS DECIMAL(20,0))
              * 0.01 AS DECIMAL(5,2)) AS uptime_pct,
         sum(request_count) FILTER (WHERE created_at >= {b['today']}) AS requests_today
  FROM d_bot_health_logs GROUP BY bot_id)"""


def z(col: str, typ: str = "BIGINT", dflt: str = "0") -> str:
    return f"CAST(coalesce({col}, {dflt}) AS {typ})"


MONEY = "DECIMAL(22,2)"


def _mapping(which: str) -> tuple[str, Clock]:
    if which == "a":
        return mapping_a_sql(), Clock.at(AS_OF_A)
    return mapping_b_sql(), Clock.at(AS_OF_B)


def overview(which: str = "a", threshold: int = 99) -> str:
    base, c = _mapping(which)
    return f"""{base},
{user_agg(c)}, {message_agg(c)}, {revenue_agg(c)}, {health_agg(c)}
SELECT b.id AS bot_id, {z('u.total_users')} AS total_users,
       {z('u.active_users_today')} AS active_users_today, {z('u.new_users_today')} AS new_users_today,
       {z('m.messages_today')} AS messages_today, {z('m.total_messages')} AS total_messages,
       {pct(z('u.weekly_current'), z('u.weekly_previous'))} AS weekly_growth_pct,
       {z('r.revenue_today', MONEY)} AS revenue_today,
       {z('r.revenue_this_week', MONEY)} AS revenue_this_week,
       {z('r.revenue_this_month', MONEY)} AS revenue_this_month,
       coalesce(h.bot_status, 'offline') AS bot_status,
       CASE WHEN coalesce(h.uptime_pct, 0) >= {threshold} THEN 'healthy' ELSE 'degraded' END AS api_health,
       {z('h.uptime_pct', 'DECIMAL(5,2)')} AS uptime_pct,
       {z('h.requests_today')} AS requests_today
FROM d_bots b
LEFT JOIN u_agg u ON u.bot_id = b.id
LEFT JOIN m_agg m ON m.bot_id = b.id
LEFT JOIN r_agg r ON r.bot_id = b.id
LEFT JOIN h_agg h ON h.bot_id = b.id"""


def user_window(which: str = "a") -> str:
    base, c = _mapping(which)
    return f"""{base}, {user_agg(c)}
SELECT b.id AS bot_id, {z('u.total_users')} AS total_users,
       {z('u.active_users_today')} AS active_users_today, {z('u.new_users_today')} AS new_users_today
FROM d_bots b LEFT JOIN u_agg u ON u.bot_id = b.id"""


def _growth(which: str, kind: str) -> str:
    base, c = _mapping(which)
    cur, prev = f"{z(f'u.{kind}_current')}", f"{z(f'u.{kind}_previous')}"
    return f"""{base}, {user_agg(c)}
SELECT b.id AS bot_id, {cur} AS current_period, {prev} AS previous_period,
       {pct(cur, prev)} AS growth_pct
FROM d_bots b LEFT JOIN u_agg u ON u.bot_id = b.id"""


def weekly_growth(which: str = "a") -> str:
    return _growth(which, "weekly")


def monthly_growth(which: str = "a") -> str:
    return _growth(which, "monthly")


def message_window(which: str = "a") -> str:
    base, c = _mapping(which)
    return f"""{base}, {message_agg(c)}
SELECT b.id AS bot_id, {z('m.total_messages')} AS total_messages, {z('m.messages_today')} AS messages_today
FROM d_bots b LEFT JOIN m_agg m ON m.bot_id = b.id"""


def revenue_window(which: str = "a") -> str:
    base, c = _mapping(which)
    return f"""{base}, {revenue_agg(c)}
SELECT b.id AS bot_id, {z('r.revenue_today', MONEY)} AS revenue_today,
       {z('r.revenue_this_week', MONEY)} AS revenue_this_week,
       {z('r.revenue_this_month', MONEY)} AS revenue_this_month
FROM d_bots b LEFT JOIN r_agg r ON r.bot_id = b.id"""


def health_summary(which: str = "a", threshold: int = 99) -> str:
    base, c = _mapping(which)
    return f"""{base}, {health_agg(c)}
SELECT b.id AS bot_id, coalesce(h.bot_status, 'offline') AS bot_status,
       {z('h.uptime_pct', 'DECIMAL(5,2)')} AS uptime_pct, {z('h.requests_today')} AS requests_today,
       CASE WHEN coalesce(h.uptime_pct, 0) >= {threshold} THEN 'healthy' ELSE 'degraded' END AS api_health
FROM d_bots b LEFT JOIN h_agg h ON h.bot_id = b.id"""


# --- series (J2) ----------------------------------------------------------------

def _series_sql(table: str, start, end, value: str, monthly: bool, vtype: str) -> str:
    if monthly:
        bucket = "CAST(date_trunc('month', created_at) AS DATE)"
        step, hi = "INTERVAL 1 MONTH", f"{sql_date(end)} + INTERVAL 1 MONTH"
    else:
        bucket = "CAST(created_at AS DATE)"
        step, hi = "INTERVAL 1 DAY", f"{sql_date(end)} + INTERVAL 1 DAY"
    return f"""s_agg AS (
  SELECT bot_id, {bucket} AS bucket_date, {value} AS value FROM {table}
  WHERE created_at >= {sql_ts(start)} AND created_at < CAST({hi} AS TIMESTAMP)
  GROUP BY ALL),
spine AS (
  SELECT b.id AS bot_id, CAST(g.d AS DATE) AS bucket_date
  FROM d_bots b CROSS JOIN generate_series(CAST({sql_date(start)} AS TIMESTAMP),
                                           CAST({sql_date(end)} AS TIMESTAMP), {step}) AS g(d)),
series AS (
  SELECT s.bot_id, s.bucket_date, CAST(coalesce(a.value, 0) AS {vtype}) AS value
  FROM spine s LEFT JOIN s_agg a ON a.bot_id = s.bot_id AND a.bucket_date = s.bucket_date)"""


def _series_spec(name: str, c: Clock):
    return {
        "weekly_user_series": ("d_users", c.days_ago(6), c.today, "count(*)", False, "BIGINT"),
        "monthly_user_series": ("d_users", c.months_ago(5), c.month_start, "count(*)", True, "BIGINT"),
        "daily_user_series": ("d_users", c.days_ago(29), c.today, "count(*)", False, "BIGINT"),
        "daily_revenue_series": ("d_payments", c.days_ago(29), c.today, "sum(amount)", False, MONEY),
        "daily_message_series": ("d_messages", c.days_ago(29), c.today, "count(*)", False, "BIGINT"),
    }[name]


def series(name: str, which: str = "a") -> str:
    base, c = _mapping(which)
    return f"""{base}, {_series_sql(*_series_spec(name, c))}
SELECT bot_id, bucket_date, value FROM series"""


def _series_cte(name: str, c: Clock, alias: str) -> str:
    """A named CTE with the series rendered as JSON text per bot."""
    body = _series_sql(*_series_spec(name, c)).replace("s_agg", f"{alias}_agg") \
        .replace("spine", f"{alias}_spine").replace("series AS", f"{alias}_long AS")
    return f"""{body},
{alias} AS (
  SELECT bot_id, '[' || string_agg('{{"date":"' || strftime(bucket_date, '%Y-%m-%d') || '","value":'
         || {js_num('value')} || '}}', ',' ORDER BY bucket_date) || ']' AS txt
  FROM {alias}_long GROUP BY bot_id)"""


def growth(which: str = "a") -> str:
    base, c = _mapping(which)
    return f"""{base}, {user_agg(c)}, {_series_cte('weekly_user_series', c, 'ws')},
{_series_cte('monthly_user_series', c, 'ms')}
SELECT b.id AS bot_id,
       {pct(z('u.weekly_current'), z('u.weekly_previous'))} AS weekly_growth_pct,
       {pct(z('u.monthly_current'), z('u.monthly_previous'))} AS monthly_growth_pct,
       ws.txt AS weekly_series, ms.txt AS monthly_series
FROM d_bots b LEFT JOIN u_agg u ON u.bot_id = b.id
JOIN ws ON ws.bot_id = b.id JOIN ms ON ms.bot_id = b.id"""


def user_stats(which: str = "a") -> str:
    base, c = _mapping(which)
    return f"""{base}, {user_agg(c)}, {_series_cte('daily_user_series', c, 'gs')}
SELECT b.id AS bot_id, {z('u.total_users')} AS total_users,
       {z('u.active_users_today')} AS active_users_today, {z('u.new_users_today')} AS new_users_today,
       gs.txt AS growth_series
FROM d_bots b LEFT JOIN u_agg u ON u.bot_id = b.id JOIN gs ON gs.bot_id = b.id"""


def revenue_stats(which: str = "a") -> str:
    base, c = _mapping(which)
    return f"""{base}, {revenue_agg(c)}, {_series_cte('daily_revenue_series', c, 'rs')}
SELECT b.id AS bot_id, {z('r.revenue_today', MONEY)} AS revenue_today,
       {z('r.revenue_this_week', MONEY)} AS revenue_this_week,
       {z('r.revenue_this_month', MONEY)} AS revenue_this_month,
       rs.txt AS revenue_series
FROM d_bots b LEFT JOIN r_agg r ON r.bot_id = b.id JOIN rs ON rs.bot_id = b.id"""


def message_stats(which: str = "a") -> str:
    base, c = _mapping(which)
    return f"""{base}, {message_agg(c)}, {_series_cte('daily_message_series', c, 'dm')}
SELECT b.id AS bot_id, {z('m.total_messages')} AS total_messages, {z('m.messages_today')} AS messages_today,
       dm.txt AS daily_messages_series
FROM d_bots b LEFT JOIN m_agg m ON m.bot_id = b.id JOIN dm ON dm.bot_id = b.id"""


def _fallback_sql() -> str:
    msg = r"'^Message received from (.+)\z'"
    pay = r"'^Payment of ([\d.]+) ([A-Z]+)\z'"
    joined = r"'^User (.+) joined\z'"
    amount = f"regexp_extract(description, {pay}, 1)"
    amount_json = (f"CASE WHEN regexp_matches({amount}, '^(\\d+\\.?\\d*|\\.\\d+)$') "
                   f"THEN {js_num(amount)} ELSE 'null' END")
    code = ("CASE event_type WHEN 'message' THEN 'message.received' WHEN 'payment' THEN 'payment.received' "
            "WHEN 'user_joined' THEN 'user.joined' ELSE event_type END")
    params = f"""CASE
      WHEN event_type = 'message' AND regexp_matches(description, {msg})
        THEN '{{"user":' || to_json(regexp_extract(description, {msg}, 1)) || '}}'
      WHEN event_type = 'payment' AND regexp_matches(description, {pay})
        THEN '{{"amount":' || {amount_json} || ',"currency":' || to_json(regexp_extract(description, {pay}, 2)) || '}}'
      WHEN event_type = 'user_joined' AND regexp_matches(description, {joined})
        THEN '{{"user":' || to_json(regexp_extract(description, {joined}, 1)) || '}}'
      ELSE '{{}}' END"""
    return code, params


def recent_activity(which: str = "a", limit: int = 10) -> str:
    base, _ = _mapping(which)
    code, params = _fallback_sql()
    stored = "(event_code IS NOT NULL AND event_code <> '')"
    return f"""{base},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bot_id ORDER BY created_at DESC, id DESC) AS rnk
  FROM d_activity_logs)
SELECT bot_id, CAST(rnk AS INTEGER) AS rank, id, event_type, description,
       CASE WHEN {stored} THEN event_code ELSE {code} END AS event_code,
       CASE WHEN {stored} THEN coalesce(params, '{{}}') ELSE {params} END AS params,
       {iso('created_at')} AS created_at
FROM ranked WHERE rnk <= {limit}"""


# --- dashboard (Q18): the six documents as one JSON text --------------------------------

def _json_series(name: str, c: Clock, alias: str) -> str:
    """Series as JSON text with the values' own decimals."""
    return _series_cte(name, c, alias).replace(js_num("value"), "CAST(value AS VARCHAR)")


def dashboard(which: str = "a", limit: int = 10, threshold: int = 99) -> str:
    base, c = _mapping(which)
    activity = recent_activity(which, limit)[len(base) + 1:]
    ctes, _, select = activity.partition("SELECT bot_id, CAST(rnk")
    num = lambda col, typ="BIGINT": f"CAST({z(col, typ)} AS VARCHAR)"
    pcts = {k: f"CAST({pct(z(f'u.{k}_current'), z(f'u.{k}_previous'))} AS VARCHAR)" for k in ("weekly", "monthly")}
    users = f"""'"total_users":' || {num('u.total_users')} || ',"active_users_today":' || {num('u.active_users_today')}
      || ',"new_users_today":' || {num('u.new_users_today')}"""
    money = f"""'"revenue_today":' || {num('r.revenue_today', MONEY)} || ',"revenue_this_week":'
      || {num('r.revenue_this_week', MONEY)} || ',"revenue_this_month":' || {num('r.revenue_this_month', MONEY)}"""
    return f"""{base}, {user_agg(c)}, {message_agg(c)}, {revenue_agg(c)}, {health_agg(c)},
{_json_series('weekly_user_series', c, 'ws')}, {_json_series('monthly_user_series', c, 'ms')},
{_json_series('daily_user_series', c, 'us')}, {_json_series('daily_revenue_series', c, 'rs')},
{_json_series('daily_message_series', c, 'dm')},
{ctes.strip().rstrip(',')},
recent AS (SELECT bot_id, CAST(rnk{select}),
ra AS (SELECT bot_id, string_agg('{{"rank":' || CAST(rank AS VARCHAR) || ',"id":' || to_json(id) || ',"event_type":'
    || to_json(event_type) || ',"description":' || to_json(description) || ',"event_code":' || to_json(event_code)
    || ',"params":' || to_json(params) || ',"created_at":"' || created_at || '"}}', ',' ORDER BY rank) AS txt
  FROM recent GROUP BY bot_id)
SELECT b.id AS bot_id,
  '{{"overview":{{' || {users} || ',"messages_today":' || {num('m.messages_today')} || ',"total_messages":'
  || {num('m.total_messages')} || ',"weekly_growth_pct":' || {pcts['weekly']} || ',' || {money}
  || ',"bot_status":"' || coalesce(h.bot_status, 'offline') || '","api_health":"'
  || CASE WHEN coalesce(h.uptime_pct, 0) >= {threshold} THEN 'healthy' ELSE 'degraded' END || '","uptime_pct":'
  || {num('h.uptime_pct', 'DECIMAL(5,2)')} || ',"requests_today":' || {num('h.requests_today')} || '}}'
  || ',"growth":{{"weekly_growth_pct":' || {pcts['weekly']} || ',"monthly_growth_pct":' || {pcts['monthly']}
  || ',"weekly_series":' || ws.txt || ',"monthly_series":' || ms.txt || '}}'
  || ',"users":{{' || {users} || ',"growth_series":' || us.txt || '}}'
  || ',"revenue":{{' || {money} || ',"revenue_series":' || rs.txt || '}}'
  || ',"messages":{{"total_messages":' || {num('m.total_messages')} || ',"messages_today":' || {num('m.messages_today')}
  || ',"daily_messages_series":' || dm.txt || '}}'
  || ',"recent_activity":[' || coalesce(ra.txt, '') || ']}}' AS document
FROM d_bots b LEFT JOIN u_agg u ON u.bot_id = b.id LEFT JOIN m_agg m ON m.bot_id = b.id
LEFT JOIN r_agg r ON r.bot_id = b.id LEFT JOIN h_agg h ON h.bot_id = b.id
JOIN ws ON ws.bot_id = b.id JOIN ms ON ms.bot_id = b.id JOIN us ON us.bot_id = b.id
JOIN rs ON rs.bot_id = b.id JOIN dm ON dm.bot_id = b.id LEFT JOIN ra ON ra.bot_id = b.id"""


# --- accounts (Q19-Q21) -------------------------------------------------------------

def _usage_ctes(c: Clock) -> str:
    return f"""bot_count AS (SELECT owner_account_id AS account_id, count(*) AS total_bots
                  FROM d_bots GROUP BY 1),
ev_count AS (SELECT b.owner_account_id AS account_id, count(*) AS monthly_events
             FROM d_activity_logs a JOIN d_bots b ON b.id = a.bot_id
             WHERE a.created_at >= {sql_ts(c.month_start)} GROUP BY 1)"""


def account_usage(which: str = "a") -> str:
    base, c = _mapping(which)
    return f"""{base}, {_usage_ctes(c)}
SELECT a.id AS account_id, {z('bc.total_bots')} AS total_bots, {z('ec.monthly_events')} AS monthly_events
FROM d_accounts a LEFT JOIN bot_count bc ON bc.account_id = a.id LEFT JOIN ev_count ec ON ec.account_id = a.id"""


PLANS_SQL = ("(VALUES ('starter', 2, 5000), ('growth', 25, 250000)) "
             "AS p(plan, max_bots, monthly_event_limit)")


def account_summary(which: str = "a") -> str:
    base, c = _mapping(which)
    return f"""{base}, {_usage_ctes(c)}
SELECT a.id AS account_id, a.email, a.name, a.plan, CAST(p.max_bots AS INTEGER) AS max_bots,
       CAST(p.monthly_event_limit AS INTEGER) AS monthly_event_limit,
       {z('bc.total_bots')} AS total_bots, {z('ec.monthly_events')} AS monthly_events
FROM d_accounts a LEFT JOIN {PLANS_SQL} ON p.plan = a.plan
LEFT JOIN bot_count bc ON bc.account_id = a.id LEFT JOIN ev_count ec ON ec.account_id = a.id"""


def owner_bots(which: str = "a") -> str:
    base, c = _mapping(which)
    return f"""{base},
uc AS (SELECT bot_id, count(*) AS n FROM d_users GROUP BY 1),
mc AS (SELECT bot_id, count(*) AS n FROM d_messages GROUP BY 1),
rc AS (SELECT bot_id, sum(amount) FILTER (WHERE created_at >= {sql_ts(c.month_start)}) AS r
       FROM d_payments GROUP BY 1)
SELECT b.owner_account_id, b.id AS bot_id,
       coalesce(b.display_name, CASE WHEN b.bot_type = 'username' THEN '@' || b.bot_identifier
                                     ELSE 'Telegram Bot' END) AS display_name,
       b.bot_type, b.verification_status, b.tracking_status, {iso('b.connected_at')} AS connected_at,
       {z('uc.n')} AS total_users, {z('mc.n')} AS total_messages, {z('rc.r', MONEY)} AS revenue_this_month
FROM d_bots b LEFT JOIN uc ON uc.bot_id = b.id LEFT JOIN mc ON mc.bot_id = b.id
LEFT JOIN rc ON rc.bot_id = b.id"""


# --- users upsert (I9) ------------------------------------------------------------------

ARRIVAL_SEQ_BASE = 1_000_000_000


def stable_id_sql(*parts: str) -> str:
    h = f"md5(concat_ws(chr(31), {', '.join(parts)}))"
    return (f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' "
            f"|| substr({h}, 17, 4) || '-' || substr({h}, 21, 12))")


def upsert_users() -> str:
    base, _ = _mapping("a")
    uid = stable_id_sql("'user'", "bot_id", "telegram_id")
    return f"""{base},
arrivals AS (
  SELECT bot_id, uid AS telegram_id,
         CASE WHEN k % 7 = 0 THEN NULL ELSE event_type END AS username,
         CAST(NULL AS VARCHAR) AS first_name, CAST(NULL AS VARCHAR) AS last_name,
         ts - k * INTERVAL 1 HOUR AS event_time, event_id + {ARRIVAL_SEQ_BASE} AS seq
  FROM ev),
rows AS (
  SELECT id, bot_id, telegram_id, username, first_name, last_name, created_at, last_active_at,
         first_seq, last_seq FROM d_users
  UNION ALL
  SELECT {uid}, bot_id, telegram_id, username, first_name, last_name, event_time, event_time, seq, seq
  FROM arrivals),
m AS (
  SELECT bot_id, telegram_id, arg_min(id, first_seq) AS id, arg_min(created_at, first_seq) AS created_at,
         arg_max({{'u': username, 'f': first_name, 'l': last_name}}, last_seq) AS p,
         max(last_active_at) AS last_active_at, min(first_seq) AS first_seq, max(last_seq) AS last_seq
  FROM rows GROUP BY bot_id, telegram_id)
SELECT id, bot_id, telegram_id, p.u AS username, p.f AS first_name, p.l AS last_name,
       {iso('created_at')} AS created_at, {iso('last_active_at')} AS last_active_at, first_seq, last_seq
FROM m"""


# --- platform updates (I4) --------------------------------------------------------------

def telegram_events() -> str:
    base, _ = _mapping("a")
    return f"""{base}
SELECT bot_id, event_id AS ingest_seq, 'user_joined' AS kind, 0 AS sub_seq,
       CAST(user_id * 10 + 1 AS VARCHAR) AS telegram_id, CAST(NULL AS VARCHAR) AS username,
       'Joe' AS first_name, CAST(NULL AS VARCHAR) AS last_name, CAST(NULL AS VARCHAR) AS text, {iso("date_trunc('second', ts)")} AS created_at
FROM ev WHERE event_type = 'signup'
UNION ALL
SELECT bot_id, event_id, 'user_joined', 1, CAST(user_id * 10 + 2 AS VARCHAR), 'bo', 'Bo', NULL, NULL,
       {iso("date_trunc('second', ts)")}
FROM ev WHERE event_type = 'signup' AND k % 2 = 1
UNION ALL
SELECT bot_id, event_id, 'message', 1048575, uid, 'u' || uid, 'Ann', NULL, props,
       {iso("date_trunc('second', ts)")}
FROM ev WHERE event_type IN ('click', 'view')"""


# --- API validation (I1-I3) -------------------------------------------------------------

def api_validation_errors() -> str:
    base, _ = _mapping("a")
    return f"""{base},
bad AS (
  SELECT k % 10 AS c FROM ev WHERE event_type = 'error'),
labelled AS (
  SELECT CASE WHEN c IN (0, 5) THEN 'INVALID_JSON' ELSE 'VALIDATION_ERROR' END AS error_code,
         CASE c WHEN 0 THEN 'body' WHEN 5 THEN 'body' WHEN 1 THEN 'botType' WHEN 2 THEN 'user.telegramId'
                WHEN 3 THEN 'createdAt' WHEN 4 THEN 'text' WHEN 6 THEN 'user.username'
                WHEN 7 THEN 'botType' ELSE 'user.telegramId' END AS error_field,
         CASE c WHEN 0 THEN 'Invalid JSON body' WHEN 5 THEN 'Invalid JSON body'
                WHEN 1 THEN 'must be a string' WHEN 2 THEN 'must be a string'
                WHEN 3 THEN 'must be a string' WHEN 4 THEN 'must be a string'
                WHEN 6 THEN 'must be at most 255 characters'
                WHEN 7 THEN 'must be "token" or "username"' ELSE 'must be a string' END AS error_detail
  FROM bad WHERE c <> 8)
SELECT error_code, error_field, error_detail, count(*) AS events
FROM labelled GROUP BY ALL"""


# --- billing (I15, I16 -> Q22) ----------------------------------------------------------

def _webhooks_sql() -> str:
    base, _ = _mapping("a")
    return f"""{base},
wh AS (
  SELECT o_orderkey AS seq, o_custkey,
         CASE WHEN o_orderkey % 97 = 0 THEN 'missing' ELSE CAST(n_regionkey AS VARCHAR) END AS account_id,
         CAST(o_orderkey % 5000 AS VARCHAR) AS provider_event_id,
         CASE WHEN o_orderstatus = 'P' THEN 'subscription.canceled' ELSE 'subscription.updated' END AS event_type,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'growth' ELSE 'starter' END AS plan,
         CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'past_due' ELSE 'canceled' END AS status,
         CASE WHEN o_orderkey % 4 = 0 THEN 'cus_' || CAST(o_custkey AS VARCHAR) END AS customer_id,
         'sub_' || CAST(o_custkey AS VARCHAR) AS subscription_id,
         CASE WHEN o_orderkey % 83 = 0 THEN -1.0
              WHEN o_orderkey % 3 = 0 THEN round(o_totalprice / 1000, 2) END AS amount,
         CASE WHEN o_orderkey % 7 = 0 THEN 'EUR' END AS currency,
         o_orderkey % 89 = 0 AS bad_date,
         CAST(o_orderdate AS TIMESTAMP) AS period_start,
         CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY AS period_end,
         CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 86400) * INTERVAL 1 SECOND AS received_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ok AS (
  SELECT * FROM wh
  WHERE account_id IN (SELECT id FROM d_accounts) AND NOT bad_date
    AND (amount IS NULL OR amount >= 0))"""


def billing_events_state() -> str:
    """The payload is the validated input: keys by length, then by bytes."""
    q = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
    payload = f"""'{{{{"plan":"' || plan || '","type":"' || event_type || '"'
      || CASE WHEN amount IS NULL THEN '' ELSE ',"amount":' || {js_num('amount')} END
      || ',"status":"' || status || '","currency":' || {q('currency')} || ',"provider":"stripe","accountId":"' || account_id
      || '","providerEventId":"' || provider_event_id || '","currentPeriodEnd":"' || {iso('period_end')}
      || '","currentPeriodStart":"' || {iso('period_start')} || '","providerCustomerId":' || {q('customer_id')}
      || ',"providerSubscriptionId":"' || subscription_id || '"}}}}'""".replace("{{", "{").replace("}}", "}")
    return f"""{_webhooks_sql()},
g AS (
  SELECT provider_event_id, arg_min(account_id, seq) AS account_id, arg_min(received_at, seq) AS created_at,
         arg_max(event_type, seq) AS event_type, arg_max(received_at, seq) AS processed_at,
         arg_max({payload}, seq) AS payload
  FROM ok GROUP BY provider_event_id)
SELECT {stable_id_sql("'billing'", "'stripe'", "provider_event_id")} AS id, account_id, 'stripe' AS provider,
       provider_event_id, event_type, payload, {iso('processed_at')} AS processed_at, {iso('created_at')} AS created_at
FROM g"""


def accounts_after_billing() -> str:
    """The last accepted event of an account sets plan, customer id and time."""
    return f"""{_webhooks_sql()},
cust AS (SELECT account_id, arg_max(customer_id, seq) FILTER (customer_id IS NOT NULL) AS given,
           min(seq) AS first_seq FROM ok GROUP BY account_id),
lasts AS (SELECT account_id, max(seq) AS seq FROM ok GROUP BY account_id)
SELECT a.id, a.email, a.name, a.api_key_hash,
       CASE WHEN o.seq IS NOT NULL THEN coalesce(c.given, 'cust_' || {stable_id_sql("'cust'", "a.id", "CAST(c.first_seq AS VARCHAR)")})
         END AS billing_provider_customer_id,
       CASE WHEN o.seq IS NULL THEN a.plan WHEN o.status IN ('active', 'trialing') THEN o.plan ELSE 'starter' END AS plan,
       {iso('a.created_at')} AS created_at, {iso('coalesce(o.received_at, a.updated_at)')} AS updated_at
FROM d_accounts a LEFT JOIN lasts l ON l.account_id = a.id LEFT JOIN ok o ON o.seq = l.seq
LEFT JOIN cust c ON c.account_id = a.id"""


def current_subscription() -> str:
    return f"""{_webhooks_sql()},
cust AS (
  SELECT account_id, arg_max(customer_id, seq) AS customer_id FROM ok
  WHERE customer_id IS NOT NULL GROUP BY account_id),
firsts AS (SELECT account_id, arg_min(received_at, seq) AS created_at FROM ok GROUP BY account_id),
lasts AS (SELECT account_id, arg_max(seq, seq) AS seq FROM ok GROUP BY account_id)
SELECT {stable_id_sql("'sub'", "o.account_id")} AS id, o.account_id, 'stripe' AS provider,
       c.customer_id AS provider_customer_id, o.subscription_id AS provider_subscription_id,
       o.plan, o.status,
       CAST(coalesce(CAST(o.amount AS DECIMAL(12,2)),
                     CASE WHEN o.plan = 'growth' THEN 99.00 ELSE 29.00 END) AS DECIMAL(12,2)) AS amount_monthly,
       coalesce(o.currency, 'USD') AS currency,
       {iso('o.period_start')} AS current_period_start, {iso('o.period_end')} AS current_period_end,
       o.event_type = 'subscription.canceled' AS cancel_at_period_end,
       {iso('f.created_at')} AS created_at, {iso('o.received_at')} AS updated_at
FROM lasts l JOIN ok o ON o.seq = l.seq JOIN firsts f ON f.account_id = o.account_id
JOIN cust c ON c.account_id = o.account_id"""


def billing_rejections() -> str:
    return f"""{_webhooks_sql()}
SELECT CASE WHEN account_id NOT IN (SELECT id FROM d_accounts) THEN 'ACCOUNT_NOT_FOUND'
            WHEN bad_date THEN 'VALIDATION_ERROR' ELSE 'INTERNAL_ERROR' END AS error_code,
       CASE WHEN account_id NOT IN (SELECT id FROM d_accounts) THEN 'accountId'
            WHEN bad_date THEN 'currentPeriod' ELSE 'amount' END AS error_field,
       count(*) AS events
FROM wh WHERE account_id NOT IN (SELECT id FROM d_accounts) OR bad_date OR amount < 0
GROUP BY 1, 2"""


# --- quality (I23, I24) -----------------------------------------------------------------

def erase_starter_accounts() -> str:
    base = contract_tables_sql()
    gone = "(SELECT id FROM d_accounts WHERE plan = 'starter')"
    gone_b = f"(SELECT id FROM d_bots WHERE owner_account_id IN {gone})"
    tables = ["users", "messages", "payments", "bot_health_logs", "activity_logs"]
    parts = ["SELECT 'accounts' AS table_name, id AS owner, count(*) AS row_count FROM d_accounts WHERE plan <> 'starter' GROUP BY 2",
             f"SELECT 'bots', owner_account_id, count(*) FROM d_bots WHERE id NOT IN {gone_b} GROUP BY 2",
             f"SELECT 'subscriptions', account_id, count(*) FROM d_subscriptions WHERE account_id NOT IN {gone} GROUP BY 2",
             f"SELECT 'billing_events', CASE WHEN account_id NOT IN {gone} THEN account_id END, count(*) FROM d_billing_events GROUP BY 2"]
    parts += [f"SELECT '{t}', bot_id, count(*) FROM d_{t} WHERE bot_id NOT IN {gone_b} GROUP BY 2" for t in tables]
    return base + "\n" + "\nUNION ALL\n".join(parts)


# The rules of the schema, written down from its DDL and not from the operator's lists.
DDL_NOT_NULL = {
    "accounts": "id email api_key_hash plan created_at updated_at",
    "bots": "id bot_identifier bot_type verification_status tracking_status webhook_status connected_at created_at updated_at",
    "users": "id bot_id telegram_id created_at last_active_at first_seq last_seq",
    "messages": "id bot_id user_id created_at", "payments": "id bot_id user_id amount currency created_at",
    "bot_health_logs": "id bot_id status uptime request_count created_at",
    "subscriptions": "id account_id provider plan status amount_monthly currency cancel_at_period_end created_at updated_at",
    "billing_events": "id provider provider_event_id event_type payload processed_at created_at",
    "activity_logs": "id bot_id event_type description params created_at"}
DDL_CHECK = [
    ("accounts", "plan", "plan IN ('starter', 'growth')"), ("bots", "bot_type", "bot_type IN ('token', 'username')"),
    ("bots", "verification_status", "verification_status IN ('pending', 'verified', 'failed')"),
    ("bots", "tracking_status", "tracking_status IN ('disabled', 'enabled')"),
    ("bots", "webhook_status", "webhook_status IN ('pending', 'enabled', 'failed')"),
    ("bot_health_logs", "status", "status IN ('online', 'offline')"),
    ("bot_health_logs", "uptime_range", "uptime BETWEEN 0 AND 100"),
    ("bot_health_logs", "request_count_non_negative", "request_count >= 0"),
    ("payments", "amount_non_negative", "amount >= 0"),
    ("subscriptions", "provider", "provider IN ('manual', 'stripe', 'click')"),
    ("subscriptions", "plan", "plan IN ('starter', 'growth')"),
    ("subscriptions", "status", "status IN ('inactive', 'trialing', 'active', 'past_due', 'canceled', 'incomplete')"),
    ("subscriptions", "amount_non_negative", "amount_monthly >= 0"),
    ("billing_events", "provider", "provider IN ('manual', 'stripe', 'click')")]
DDL_UNIQUE = [
    ("accounts", "id"), ("accounts", "email"), ("accounts", "api_key_hash"), ("bots", "id"), ("bots", "bot_type,bot_identifier"),
    ("users", "id"), ("users", "bot_id,telegram_id"), ("messages", "id"), ("payments", "id"), ("bot_health_logs", "id"),
    ("subscriptions", "id"), ("subscriptions", "account_id"), ("billing_events", "id"),
    ("billing_events", "provider,provider_event_id"), ("activity_logs", "id")]
DDL_FOREIGN = [
    ("bots", "owner_account_id", "accounts"), ("users", "bot_id", "bots"), ("messages", "bot_id", "bots"),
    ("messages", "user_id", "users"), ("payments", "bot_id", "bots"), ("payments", "user_id", "users"),
    ("bot_health_logs", "bot_id", "bots"), ("subscriptions", "account_id", "accounts"),
    ("billing_events", "account_id", "accounts"), ("activity_logs", "bot_id", "bots")]


def contracts_report() -> str:
    parts = [f"SELECT '{n}', 'not_null:{c}', id FROM d_{n} WHERE {c} IS NULL"
             for n, cols in DDL_NOT_NULL.items() for c in cols.split()]
    parts += [f"SELECT '{n}', 'check:{rule}', id FROM d_{n} WHERE NOT ({cond})" for n, rule, cond in DDL_CHECK]
    for n, cols in DDL_UNIQUE:
        names = cols.split(",")
        key = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in names)
        filled = " AND ".join(f"{c} IS NOT NULL" for c in names)
        parts.append(f"SELECT '{n}', 'unique:{cols}', {key} FROM d_{n} WHERE {filled} GROUP BY {cols} HAVING count(*) > 1")
    parts += [f"SELECT '{child}', 'fk:{col}->{parent}', id FROM d_{child} c "
              f"WHERE {col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_{parent} p WHERE p.id = c.{col})"
              for child, col, parent in DDL_FOREIGN]
    body = "\nUNION ALL\n".join(parts)
    return f"{contract_tables_sql()},\nv(table_name, rule, key) AS (\n{body})\nSELECT table_name, rule, key FROM v"


# --- lookups (Q24, Q25) -----------------------------------------------------------------

def lookup_accounts_by_key() -> str:
    from botlens.sources.fixtures import FIXTURE_API_SECRET, sql_hmac
    base, _ = _mapping("a")
    keys = f"""SELECT DISTINCT CASE WHEN k = 99 THEN 'key-unknown'
                                 ELSE 'key-' || CAST(n_regionkey AS VARCHAR) END AS api_key
               FROM ev JOIN nation ON CAST(n_nationkey AS VARCHAR) = ev.bot_id"""
    return f"""{base}, keys AS ({keys}),
hashed AS (SELECT api_key, {sql_hmac('api_key', FIXTURE_API_SECRET)} AS api_key_hash FROM keys)
SELECT h.api_key, a.id AS account_id, a.email, a.plan
FROM hashed h JOIN d_accounts a ON a.api_key_hash = h.api_key_hash"""


def lookup_bots_by_identity() -> str:
    base, _ = _mapping("a")
    return f"""{base},
keys AS (
  SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS owner_account_id,
         CASE WHEN n_nationkey % 2 = 0 THEN 'username' ELSE 'token' END AS bot_type,
         lower(n_name) AS bot_identifier
  FROM ev JOIN nation ON CAST(n_nationkey AS VARCHAR) = ev.bot_id)
SELECT b.id AS bot_id, b.owner_account_id, b.bot_type, b.bot_identifier, b.display_name
FROM d_bots b JOIN keys k ON k.owner_account_id = b.owner_account_id AND k.bot_type = b.bot_type
  AND k.bot_identifier = b.bot_identifier"""


def lookup_bots_by_id() -> str:
    base, _ = _mapping("a")
    return f"""{base}
SELECT id, owner_account_id, bot_identifier FROM d_bots WHERE id IN (SELECT bot_id FROM ev)"""


def lookup_bots_by_owner() -> str:
    base, _ = _mapping("a")
    return f"""{base}
SELECT id, owner_account_id, bot_identifier FROM d_bots b
WHERE EXISTS (SELECT 1 FROM ev WHERE ev.bot_id = b.id AND CAST(ev.user_id % 5 AS VARCHAR) = b.owner_account_id)"""


def lookup_accounts_by_id() -> str:
    return f"""{_webhooks_sql()}
SELECT id, email, plan FROM d_accounts WHERE id IN (SELECT account_id FROM wh)"""


def current_subscription_of_many() -> str:
    return f"""{contract_tables_sql()}
SELECT account_id, id, provider, plan, status, CAST(amount_monthly AS DECIMAL(12,2)) AS amount_monthly
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY updated_at DESC, id DESC) AS r FROM d_subscriptions)
WHERE r = 1"""


def token_round_trip() -> str:
    return """SELECT event_id, CAST(7000000 + event_id AS VARCHAR) || ':AAH_token-' || event_type || '_xxxxxxxxxxxx' AS token,
       true AS round_trip_ok FROM events"""


# --- bot cap (I7), account changes (I18) ------------------------------------------------

def bot_cap_connects() -> str:
    base, _ = _mapping("a")
    return f"""{base},
c AS (
  SELECT CAST(n_regionkey AS VARCHAR) AS owner_account_id, n_nationkey,
         CASE WHEN n_nationkey % 2 = 0 THEN 'username' ELSE 'token' END AS bot_type,
         CASE WHEN n_nationkey % 2 = 0 THEN '@' || n_name
              ELSE CAST(7000000 + n_nationkey AS VARCHAR) || ':AAH_token-' || lower(n_name) || '_xxxxxxxxxxxx'
         END AS bot_value,
         min(event_id) AS first_seq
  FROM ev JOIN nation ON CAST(n_nationkey AS VARCHAR) = ev.bot_id GROUP BY ALL),
have AS (SELECT owner_account_id, count(*) AS n FROM d_bots GROUP BY 1),
ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY owner_account_id ORDER BY first_seq) AS k
  FROM c WHERE bot_type = 'token')
SELECT c.owner_account_id, c.bot_type, c.bot_value,
       CASE WHEN c.bot_type = 'username' THEN true
            ELSE coalesce(h.n, 0) + r.k <= CASE WHEN a.plan = 'growth' THEN 25 ELSE 2 END END AS allowed
FROM c LEFT JOIN ranked r ON r.n_nationkey = c.n_nationkey
LEFT JOIN have h ON h.owner_account_id = c.owner_account_id
LEFT JOIN d_accounts a ON a.id = c.owner_account_id"""


def _account_changes_ctes() -> str:
    base, _ = _mapping("a")
    return f"""{base},
creates AS (
  SELECT lower('C' || CAST(c_custkey AS VARCHAR) || '@Example.com') AS email, c_custkey AS seq, c_name AS name,
         sha256('C' || CAST(c_custkey AS VARCHAR) || '@Example.com') AS api_key_hash FROM customer
  UNION ALL
  SELECT lower(upper('C' || CAST(c_custkey AS VARCHAR) || '@Example.com')), c_custkey + 1000000, c_name, NULL
  FROM customer WHERE c_custkey % 10 = 0),
firsts AS (SELECT email, min(seq) AS seq FROM creates GROUP BY email),
new_acc AS (
  SELECT {stable_id_sql("'account'", "f.email")} AS id, f.email, c.name, c.api_key_hash, 'starter' AS plan,
         TIMESTAMP '2024-02-01' + (f.seq % 86400) * INTERVAL 1 SECOND AS tm
  FROM firsts f JOIN creates c ON c.email = f.email AND c.seq = f.seq
  WHERE f.email NOT IN (SELECT email FROM d_accounts)),
allacc AS (SELECT id, email, name, api_key_hash, plan, created_at, updated_at FROM d_accounts
           UNION ALL SELECT id, email, name, api_key_hash, plan, tm, tm FROM new_acc),
plans AS (
  SELECT CASE WHEN o_orderkey % 350 = 0 THEN 'missing' ELSE CAST(n_regionkey AS VARCHAR) END AS account_id,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'growth' WHEN '5' THEN 'gold' ELSE 'starter' END AS plan,
         o_orderkey + 2000000 AS seq
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def account_changes_state() -> str:
    return f"""{_account_changes_ctes()},
last_plan AS (SELECT account_id, arg_max(plan, seq) AS plan, max(seq) AS seq FROM plans
              WHERE account_id IN (SELECT id FROM allacc) AND plan IN ('starter', 'growth') GROUP BY 1)
SELECT a.id, a.email, a.name, a.api_key_hash, CAST(NULL AS VARCHAR) AS billing_provider_customer_id,
       coalesce(l.plan, a.plan) AS plan, {iso('a.created_at')} AS created_at,
       {iso("CASE WHEN l.seq IS NULL THEN a.updated_at ELSE TIMESTAMP '2024-02-01' + (l.seq % 86400) * INTERVAL 1 SECOND END")} AS updated_at
FROM allacc a LEFT JOIN last_plan l ON l.account_id = a.id"""


def account_changes_rejections() -> str:
    return f"""{_account_changes_ctes()},
r AS (
  SELECT 'EMAIL_TAKEN' AS error_code FROM creates c
  WHERE c.email IN (SELECT email FROM d_accounts)
     OR c.seq <> (SELECT f.seq FROM firsts f WHERE f.email = c.email)
  UNION ALL
  SELECT CASE WHEN account_id NOT IN (SELECT id FROM allacc) THEN 'ACCOUNT_NOT_FOUND' ELSE 'VALIDATION_ERROR' END
  FROM plans WHERE account_id NOT IN (SELECT id FROM allacc) OR plan NOT IN ('starter', 'growth'))
SELECT error_code, count(*) AS events FROM r GROUP BY 1"""


# --- I20 end to end: rejections of one API batch ------------------------------------------

def ingest_api_rejections() -> str:
    """Auth (k = 99), then the monthly quota in arrival order, then the body
    rules, then the date check after bot resolution (FIXTURES §2 cases)."""
    base, c = _mapping("a")
    return f"""{base}, {_usage_ctes(c)},
e AS (
  SELECT ev.event_id, ev.k, ev.event_type, CAST(n.n_regionkey AS VARCHAR) AS owner
  FROM ev JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = ev.bot_id),
owned AS (SELECT * FROM e WHERE k <> 99),
flagged AS (
  SELECT o.*, CASE WHEN o.event_type <> 'error' THEN 1 ELSE 0 END AS counts,
         coalesce(u.monthly_events, 0) AS base_n,
         CASE WHEN a.plan = 'growth' THEN 250000 ELSE 5000 END AS lim
  FROM owned o LEFT JOIN ev_count u ON u.account_id = o.owner JOIN d_accounts a ON a.id = o.owner),
ran AS (
  SELECT *, base_n + coalesce(sum(counts) OVER (PARTITION BY owner ORDER BY event_id
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM flagged),
labelled AS (
  SELECT 'INVALID_API_KEY' AS error_code, 'api_key' AS error_field FROM e WHERE k = 99
  UNION ALL
  SELECT 'PLAN_LIMIT_REACHED', 'monthlyEvents' FROM ran WHERE used >= lim
  UNION ALL
  SELECT CASE WHEN k % 10 IN (0, 5) THEN 'INVALID_JSON' ELSE 'VALIDATION_ERROR' END,
         CASE k % 10 WHEN 0 THEN 'body' WHEN 5 THEN 'body' WHEN 1 THEN 'botType' WHEN 2 THEN 'user.telegramId'
                     WHEN 3 THEN 'createdAt' WHEN 4 THEN 'text' WHEN 6 THEN 'user.username'
                     WHEN 7 THEN 'botType' WHEN 8 THEN 'createdAt' ELSE 'user.telegramId' END
  FROM ran WHERE used < lim AND event_type = 'error')
SELECT error_code, error_field, count(*) AS events FROM labelled GROUP BY ALL"""


def ingest_api_activity() -> str:
    """Activity rows written by one API batch (I6 + I13 after I5/I8/I1-I3)."""
    from botlens.sources.fixtures import sql_hmac
    from botlens.sources.raw import TOKEN_SECRET
    base, _ = _mapping("a")
    token = ("CAST(7000000 + n.n_nationkey AS VARCHAR) || ':AAH_token-' || lower(n.n_name) "
             "|| '_xxxxxxxxxxxx'")
    new_bot = stable_id_sql("'bot'", "'token'", sql_hmac(token, TOKEN_SECRET))
    prefix = ingest_api_rejections().rsplit("SELECT error_code", 1)[0].rstrip()
    return f"""{prefix},
ok AS (
  SELECT r.event_id, r.k, r.event_type, ev.uid, ev.ts, ev.amount,
         CASE WHEN n.n_nationkey % 2 = 0 THEN CAST(n.n_nationkey AS VARCHAR) ELSE {new_bot} END AS bot_id
  FROM ran r JOIN ev ON ev.event_id = r.event_id
  JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = ev.bot_id
  WHERE r.used < r.lim AND r.event_type <> 'error'),
facts AS (
  SELECT {stable_id_sql("'activity'", "'api'", "CAST(event_id AS VARCHAR)", "'0'")} AS id, bot_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'message'
              WHEN event_type = 'purchase' THEN 'payment' ELSE 'user_joined' END AS kind,
         uid, amount, CASE WHEN k % 10 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
         CASE WHEN k % 5 <> 0 THEN CAST(strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS TIMESTAMP)
              ELSE ts + INTERVAL 5 SECOND END AS created_at
  FROM ok)
SELECT id, bot_id, kind AS event_type,
       CASE kind WHEN 'message' THEN 'Message received from ' || uid
                 WHEN 'payment' THEN 'Payment of ' || CAST(amount AS VARCHAR) || ' ' || currency
                 ELSE 'User ' || uid || ' joined' END AS description,
       CASE kind WHEN 'message' THEN 'message.received' WHEN 'payment' THEN 'payment.received'
                 ELSE 'user.joined' END AS event_code,
       CASE WHEN kind = 'payment'
            THEN '{{"user":' || to_json(uid) || ',"amount":' || {js_num('amount')} || ',"currency":'
                 || to_json(currency) || '}}'
            ELSE '{{"user":' || to_json(uid) || '}}' END AS params,
       {iso('created_at')} AS created_at
FROM facts"""


def ingest_platform_messages() -> str:
    """Messages written from platform updates (I4 -> I10): click/view rows."""
    base, _ = _mapping("a")
    return f"""{base}
SELECT {stable_id_sql("'message'", "'platform'", "CAST(event_id AS VARCHAR)", "'1048575'")} AS id, bot_id,
       {stable_id_sql("'user'", "bot_id", "uid")} AS user_id, props AS text,
       {iso("date_trunc('second', ts)")} AS created_at
FROM ev WHERE event_type IN ('click', 'view')"""


def _bot_changes_ctes() -> str:
    """Token bots send credentials (2), username bots verify (2); odd bots track before (1), three of four after (3)."""
    base, _ = _mapping("a")
    return f"""{base},
b AS (SELECT *, CAST(id AS INTEGER) AS k, bot_type = 'token' OR display_name IS NOT NULL AS passes,
        verification_status = 'verified' AS was FROM d_bots),
s AS (SELECT *, k % 2 = 1 AND was AS early, k % 4 <> 3 AND (was OR passes) AS late FROM b)"""


def bot_changes() -> str:
    """The webhook is enabled if the bot has a token when tracking is (last) enabled."""
    at = "TIMESTAMP '2024-02-01 00:00:00'"
    token = "CAST(7000000 + k AS VARCHAR) || ':AAH_token-' || bot_identifier || '_xxxxxxxxxxxx'"
    return f"""{_bot_changes_ctes()}
SELECT id, owner_account_id, bot_identifier, bot_type,
       CASE WHEN bot_type = 'token' THEN '@' || bot_identifier ELSE display_name END AS display_name,
       CASE WHEN bot_type = 'token' THEN id END AS telegram_bot_id,
       CASE WHEN bot_type = 'token' THEN 'enc:' || {token} END AS encrypted_token,
       CASE WHEN passes THEN 'verified' ELSE verification_status END AS verification_status,
       CASE WHEN early OR late THEN 'enabled' ELSE tracking_status END AS tracking_status,
       CASE WHEN late AND bot_type = 'token' THEN 'enabled' WHEN early OR late THEN 'pending' ELSE webhook_status END AS webhook_status,
       {iso('connected_at')} AS connected_at, {iso(f"CASE WHEN passes THEN {at} ELSE verified_at END")} AS verified_at,
       {iso(f"CASE WHEN early OR late THEN {at} ELSE tracking_enabled_at END")} AS tracking_enabled_at,
       {iso('created_at')} AS created_at, {iso(f"CASE WHEN passes OR early OR late THEN {at} ELSE updated_at END")} AS updated_at
FROM s"""


def bot_changes_rejections() -> str:
    return f"""{_bot_changes_ctes()}
SELECT id AS bot_id, 'verify' AS change, CAST(k * 10 + 2 AS BIGINT) AS ingest_seq, 'VERIFICATION_FAILED' AS error_code
FROM s WHERE NOT passes
UNION ALL SELECT id, 'track', k * 10 + 1, 'VERIFICATION_FAILED' FROM s WHERE k % 2 = 1 AND NOT was
UNION ALL SELECT id, 'track', k * 10 + 3, 'VERIFICATION_FAILED' FROM s WHERE k % 4 <> 3 AND NOT (was OR passes)
UNION ALL SELECT 'no-such-bot', 'track', k * 10 + 4, 'BOT_NOT_FOUND' FROM s WHERE k = 0
UNION ALL SELECT id, 'rename', k * 10 + 5, 'VALIDATION_ERROR' FROM s WHERE k = 1"""


# --- malformed inputs (I1-I4, I14), quota, the other outputs of an API batch --------------------

def _bad_cases() -> str:
    """(source, n, i, error_code, error_field): the expected outcome of each case."""
    from botlens.sources import raw as R
    text = lambda v: "NULL" if v is None else f"'{v}'"
    rows = [f"('{source}', {len(cases)}, {i}, {text(c[-2])}, {text(c[-1])})" for source, cases in (
        ("api", R.BAD_API), ("platform", R.BAD_PLATFORM), ("billing", R.BAD_BILLING)) for i, c in enumerate(cases)]
    return f"""WITH cases(source, n, i, error_code, error_field) AS (VALUES {', '.join(rows)}),
numbers AS (SELECT 'api' AS source, event_id AS number FROM events UNION ALL SELECT 'platform', event_id FROM events
            UNION ALL SELECT 'billing', o_orderkey FROM orders),
found AS (
  SELECT s.source, CASE WHEN s.source = 'platform' AND number % 11 = 0 THEN 'BOT_NOT_FOUND' ELSE error_code END AS error_code,
         CASE WHEN s.source = 'platform' AND number % 11 = 0 THEN 'botId' ELSE error_field END AS error_field
  FROM numbers s JOIN cases c ON c.source = s.source AND s.number % c.n = c.i)"""


def bad_bodies() -> str:
    return f"""{_bad_cases()}
SELECT source, error_code, error_field, count(*) AS events FROM found
WHERE error_code IS NOT NULL AND error_code <> 'ignored' GROUP BY ALL"""


def ingest_balance() -> str:
    return f"""{_bad_cases()}
SELECT source, count(*) AS input_rows, count(*) FILTER (error_code IS NULL) AS accepted_rows,
       count(*) FILTER (error_code <> 'ignored') AS rejected_rows, count(*) FILTER (error_code = 'ignored') AS other_rows
FROM found GROUP BY source"""


def ingest_api_quota(left: dict, later: str = "event_id % 3 = 0") -> str:
    """Owner and month each have their own running count; an event counts if it is dated in its arrival month or later.
    ``later``: which events arrive in the second month."""
    base, _ = _mapping("a")
    jan, feb = left.values()
    return f"""{base},
e AS (
  SELECT ev.event_id, CAST(n.n_regionkey AS VARCHAR) AS owner, {later} AS later,
         CASE WHEN a.plan = 'growth' THEN 250000 ELSE 5000 END AS lim,
         CASE WHEN event_type <> 'error' AND (NOT ({later}) OR k % 5 = 0) THEN 1 ELSE 0 END AS counts
  FROM ev JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = ev.bot_id
  JOIN d_accounts a ON a.id = CAST(n.n_regionkey AS VARCHAR) WHERE k <> 99),
ran AS (
  SELECT *, lim - CASE WHEN later THEN {feb} ELSE {jan} END + coalesce(sum(counts) OVER (
      PARTITION BY owner, later ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM e)
SELECT event_id AS ingest_seq, 'monthlyEvents' AS error_field,
       'current ' || CAST(lim AS VARCHAR) || ', limit ' || CAST(lim AS VARCHAR) AS error_detail
FROM ran WHERE used >= lim"""


def quota_as_of() -> str:
    """The plan by an ASOF join; the counts of the stretches between two changes by recursion."""
    return """WITH RECURSIVE ch AS (
  SELECT o_custkey AS owner, 2 * o_orderkey AS seq, CASE WHEN o_totalprice > 250000 THEN 'growth' ELSE 'starter' END AS plan
  FROM orders),
e AS (
  SELECT ev.*, coalesce(ch.plan, 'starter') AS plan, coalesce(ch.seq, -1) AS since
  FROM (SELECT event_id, user_id AS owner, event_type, 2 * event_id + 1 AS seq FROM events) ev
  ASOF LEFT JOIN ch ON ev.owner = ch.owner AND ev.seq >= ch.seq),
r AS (
  SELECT *, CASE WHEN plan = 'growth' THEN 250000 ELSE 5000 END AS lim,
         count(*) FILTER (event_type <> 'error') OVER (PARTITION BY owner, since ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
st AS (
  SELECT owner, since, any_value(lim) AS lim, count(*) FILTER (event_type <> 'error') AS n,
         row_number() OVER (PARTITION BY owner ORDER BY since) AS i FROM r GROUP BY owner, since),
f AS (
  SELECT st.owner, i, since, lim, n, CAST(coalesce(4970 + c_nationkey, 0) AS BIGINT) AS u
  FROM st LEFT JOIN customer ON c_custkey = st.owner WHERE i = 1
  UNION ALL
  SELECT st.owner, st.i, st.since, st.lim, st.n, greatest(f.u, least(f.u + f.n, f.lim))
  FROM f JOIN st ON st.owner = f.owner AND st.i = f.i + 1)
SELECT event_id, plan, greatest(f.u, least(f.u + r.before, r.lim)) AS used, f.u + r.before < r.lim AS accepted
FROM r JOIN f ON r.owner = f.owner AND r.since = f.since"""


def _api_facts() -> str:
    return ingest_api_activity().rsplit("SELECT id, bot_id, kind AS event_type", 1)[0].rstrip()


def _api_fact_id(kind: str) -> str:
    return stable_id_sql(f"'{kind}'", "'api'", "CAST(ok.event_id AS VARCHAR)", "'0'")


def _created(alias: str = "ok") -> str:
    return (f"CASE WHEN {alias}.k % 5 <> 0 THEN CAST(strftime({alias}.ts, '%Y-%m-%d %H:%M:%S.%g') AS TIMESTAMP) "
            f"ELSE {alias}.ts + INTERVAL 5 SECOND END")


def ingest_api_payments() -> str:
    return f"""{_api_facts()}
SELECT {_api_fact_id('payment')} AS id, bot_id, {stable_id_sql("'user'", "bot_id", "uid")} AS user_id, amount,
       CASE WHEN k % 10 = 0 THEN 'EUR' ELSE 'USD' END AS currency, {iso(_created())} AS created_at
FROM ok WHERE event_type = 'purchase'"""


def ingest_api_health() -> str:
    return f"""{_api_facts()}
SELECT {_api_fact_id('health')} AS id, bot_id, 'online' AS status, CAST(100 AS DECIMAL(5,2)) AS uptime,
       CAST(1 AS INTEGER) AS request_count, {iso(_created())} AS created_at FROM ok"""


def ingest_api_users() -> str:
    return f"""{_api_facts()},
u AS (SELECT bot_id, uid, arg_min(tm, event_id) AS created_at, max(tm) AS last_active_at, min(event_id) AS first_seq,
        max(event_id) AS last_seq, max_by({{'u': CASE WHEN k % 7 <> 0 THEN 'u' || uid END,
                                            'f': CASE WHEN k % 3 = 0 THEN 'First' END}}, event_id) AS p
      FROM (SELECT *, {_created()} AS tm FROM ok) GROUP BY bot_id, uid)
SELECT {stable_id_sql("'user'", "bot_id", "uid")} AS id, bot_id, uid AS telegram_id, p.u AS username, p.f AS first_name,
       CAST(NULL AS VARCHAR) AS last_name, {iso('created_at')} AS created_at, {iso('last_active_at')} AS last_active_at,
       first_seq, last_seq FROM u"""


def ingest_api_bots() -> str:
    """Known bots are touched, unknown identities created; an event with a bad date does both."""
    from botlens.sources.fixtures import sql_hmac
    from botlens.sources.raw import TOKEN_SECRET
    token = "CAST(7000000 + n.n_nationkey AS VARCHAR) || ':AAH_token-' || lower(n.n_name) || '_xxxxxxxxxxxx'"
    prefix = ingest_api_rejections().rsplit("SELECT error_code", 1)[0].rstrip()
    return f"""{prefix},
res AS (
  SELECT r.owner, CASE WHEN n.n_nationkey % 2 = 0 OR r.event_type = 'error' THEN 'username' ELSE 'token' END AS bot_type,
         CASE WHEN n.n_nationkey % 2 = 0 THEN lower(n.n_name) WHEN r.event_type = 'error' THEN lower({token})
              ELSE {sql_hmac(token, TOKEN_SECRET)} END AS bot_identifier, ev.ts + INTERVAL 5 SECOND AS tm
  FROM ran r JOIN ev ON ev.event_id = r.event_id JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = ev.bot_id
  WHERE r.used < r.lim AND (r.event_type <> 'error' OR r.k % 10 = 8)),
g AS (SELECT owner, bot_type, bot_identifier, min(tm) AS first_at, max(tm) AS last_at FROM res GROUP BY ALL),
allb AS (
  SELECT b.id, b.owner_account_id, b.bot_identifier, b.bot_type, b.display_name, b.verification_status, b.tracking_status,
         greatest(b.connected_at, coalesce(g.last_at, b.connected_at)) AS connected_at, b.verified_at, b.tracking_enabled_at,
         b.created_at, greatest(b.updated_at, coalesce(g.last_at, b.updated_at)) AS updated_at
  FROM d_bots b LEFT JOIN g ON g.bot_type = b.bot_type AND g.bot_identifier = b.bot_identifier
  UNION ALL
  SELECT {stable_id_sql("'bot'", "g.bot_type", "g.bot_identifier")}, g.owner, g.bot_identifier, g.bot_type,
         CASE WHEN g.bot_type = 'username' THEN '@' || g.bot_identifier ELSE 'Telegram Bot' END, 'pending', 'disabled',
         last_at, NULL, NULL, first_at, last_at
  FROM g WHERE NOT EXISTS (SELECT 1 FROM d_bots b WHERE b.bot_type = g.bot_type AND b.bot_identifier = g.bot_identifier))
SELECT id, owner_account_id, bot_identifier, bot_type, display_name, CAST(NULL AS VARCHAR) AS telegram_bot_id,
       CAST(NULL AS VARCHAR) AS encrypted_token, verification_status, tracking_status, 'pending' AS webhook_status,
       {iso('connected_at')} AS connected_at, {iso('verified_at')} AS verified_at,
       {iso('tracking_enabled_at')} AS tracking_enabled_at, {iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at
FROM allb"""


# --- dates (F13), keyed tables (I9, I24, Q24), order (L3), redelivery (T4) ----------------

def event_date_texts() -> str:
    at = "CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 86400) * INTERVAL 1 SECOND"
    read = {2: "date_trunc('day', t0)", 3: "date_trunc('minute', t0)", 5: "t0 - INTERVAL 2 HOUR", 7: "t0 + INTERVAL 5 HOUR",
            8: "NULL"}
    cases = " ".join(f"WHEN {n} THEN {e}" for n, e in read.items())
    return f"""
WITH o AS (SELECT o_orderkey, date_trunc('second', {at}) AS t0 FROM orders),
r AS (SELECT o_orderkey, CASE o_orderkey % 9 {cases} ELSE t0 END AS ts FROM o)
SELECT o_orderkey, {iso('ts')} AS created_at FROM r"""


def lookup_users_keyed() -> str:
    base, _ = _mapping("a")
    return f"""{base}
SELECT id, bot_id, username, {iso('last_active_at')} AS last_active_at FROM d_users
WHERE id IN (SELECT CAST(event_id AS VARCHAR) FROM ev WHERE user_id % 50 = 0)"""


def erase_by_file() -> str:
    base, _ = _mapping("a")
    return f"""{base}
SELECT bot_id, count(*) AS messages FROM d_messages WHERE CAST(user_id AS BIGINT) % 40 <> 0 GROUP BY bot_id"""


def owner_bots_ordered() -> str:
    return f"""
WITH b AS ({owner_bots("a")})
SELECT owner_account_id, bot_id, connected_at, total_messages,
       CAST(row_number() OVER (PARTITION BY owner_account_id ORDER BY connected_at DESC, bot_id) AS INTEGER) AS place FROM b"""


def telegram_dedupe() -> str:
    return f"""
WITH t AS ({telegram_events()})
SELECT bot_id, kind, count(*) AS events FROM t GROUP BY bot_id, kind"""
