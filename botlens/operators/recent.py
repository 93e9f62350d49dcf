"""Mergeable newest-N activity (Q17, W2, L1): the recent activity without a scan of the log.

One row a (bot, day) holds the newest N activity rows of that day as an array of
structs, newest first.  Arrays of several batches are joined, sorted and cut to N
again, so batches can be merged in any order and grouping.  A day with rows has at
least one, so a bot's newest N rows lie in its newest N such days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from botlens.operators import stats as S

NEWEST = 10
# the order of the fields is the order of the rows: newest first, like times by id
ROW = ["created_at", "id", "event_type", "description", "event_code", "params"]
NEWEST_SCHEMA = ("bot_id string, day date, newest array<struct<created_at:timestamp,id:string,event_type:string,"
                 "description:string,event_code:string,params:string>>")


def newest_daily(activity: DataFrame, n: int = NEWEST) -> DataFrame:
    """(bot_id, day, newest) of activity rows; tasks send at most ``n`` rows a bot and day."""
    rows = activity.select("bot_id", F.to_date("created_at").alias("day"), *ROW)
    order = Window.partitionBy("bot_id", "day").orderBy(F.desc("created_at"), F.desc("id"))
    kept = rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n)
    return kept.groupBy("bot_id", "day").agg(
        F.sort_array(F.collect_list(F.struct(*ROW)), asc=False).alias("newest"))


def merge_newest(rows: DataFrame, n: int = NEWEST) -> DataFrame:
    """One row a (bot, day) from the rows of any number of batches."""
    return rows.groupBy("bot_id", "day").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("newest")), asc=False), 1, n).alias("newest"))


def recent_from_newest(rows: DataFrame, limit: int = NEWEST, bots=None) -> DataFrame:
    """Q17 from the state: each bot's newest days, then its newest rows (``limit`` at most the state's N)."""
    by_day = Window.partitionBy("bot_id").orderBy(F.desc("day"))
    # one batch's rows of a day may still lie beside another's: days count once
    days = S._restrict(rows, bots).withColumn("_day", F.dense_rank().over(by_day)).filter(F.col("_day") <= limit)
    each = days.select("bot_id", F.explode("newest").alias("r")).select("bot_id", "r.*")
    newest = Window.partitionBy("bot_id").orderBy(F.desc("created_at"), F.desc("id"))
    return S.resolved_activity(each.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit))
