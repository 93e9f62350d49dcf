"""Running totals by key in Spark's state store.

A native streaming aggregation in update mode, with the RocksDB provider: every
micro-batch adds its rows to the totals of the keys that it touches, nothing else
is read or written.  There is no watermark, so a row that is years late still counts
(T2).  The totals are read back from the store itself (``statestore`` source), as the
checkpoint has them after the last finished micro-batch; a failed one is not seen
and is run again by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from botlens.functions.clock import Clock, date_lit
from botlens.sources.sink import BATCHES, Sink
from botlens.sources.tables import Tables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_totals(rows: DataFrame, keys: dict[str, Column], sums: dict[str, Column], checkpoint: str,
                 available_now: bool = True):
    """Start adding up ``sums`` by ``keys`` over a stream (to its present end if ``available_now``)."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # keys and values are made before the grouping: the store then has the key columns by name
    rows = rows.select(*[c.alias(n) for n, c in keys.items()], *[c.alias(n) for n, c in sums.items()])
    totals = rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])
    writer = totals.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def add_up(rows: DataFrame, keys: dict[str, Column], sums: dict[str, Column], checkpoint: str) -> None:
    query = start_totals(rows, keys, sums, checkpoint)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def read_totals(spark: SparkSession, checkpoint: str, sums: list[str]) -> DataFrame:
    """The totals as the last finished micro-batch left them."""
    state = spark.read.format("statestore").load(checkpoint)
    buffers = state.schema["value"].dataType.fields           # a decimal sum has a flag beside it
    renamed = ", ".join(f"b{i}: {f.dataType.simpleString()}" for i, f in enumerate(buffers))
    places = [i for i, f in enumerate(buffers) if f.name == "sum"]
    return state.select("key.*", F.col("value").cast(f"struct<{renamed}>").alias("v")).select(
        *[c.name for c in state.schema["key"].dataType.fields],
        *[F.col(f"v.b{i}").alias(n) for i, n in zip(places, sums)])


class QuotaCounters:
    """How many events each owner has in each month (the quota's base, Q19), kept in the state store.

    The stream is the list of committed batches, which says what each has added.  ``base``:
    (account_id, month, events) before the first batch.
    """

    def __init__(self, sink: Sink, base: DataFrame):
        self.sink, self.base = sink, base
        self.checkpoint = f"{sink.root}/quota-counters"

    def refresh(self) -> None:
        """Take in the batches committed since the last refresh."""
        if not self.sink._exists(f"{self.sink.root}/batches"):
            return
        batches = self.sink.spark.readStream.schema(BATCHES).parquet(f"{self.sink.root}/batches")
        add_up(batches.filter("events is not null"), {"owner_account_id": F.col("owner_account_id"), "month": F.col("month")},
               {"events": F.col("events")}, self.checkpoint)

    def totals(self) -> DataFrame:
        """(account_id, month, events) of the base and all batches taken in."""
        if not self.sink._exists(f"{self.checkpoint}/state"):
            return self.base
        own = read_totals(self.sink.spark, self.checkpoint, ["events"])
        return self.base.unionByName(own.withColumnRenamed("owner_account_id", "account_id"))

    def usage_at(self, clock: Clock) -> DataFrame:
        """(account_id, monthly_events): events dated in or after the clock's month."""
        return self.totals().filter(F.col("month") >= date_lit(clock.month_start)).groupBy("account_id").agg(
            F.sum("events").cast("long").alias("monthly_events"))


def usage_by_month(t: Tables) -> DataFrame:
    """(account_id, month, events) of stored activity."""
    owner = t.bots.select(F.col("id").alias("bot_id"), F.col("owner_account_id").alias("account_id"))
    per_bot = t.activity_logs.groupBy("bot_id", F.to_date(F.trunc("created_at", "MM")).alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    return per_bot.join(owner, "bot_id").groupBy("account_id", "month").agg(F.sum("n").alias("events"))
