"""Where micro-batches are written (S5, S6, T6): partitioned Parquet, a folder a batch.

    <root>/<table>/stream=<name>/batch_id=<n>/[event_date=D/]part-...
    <root>/batches/stream=<name>/batch_id=<n>/part-...     written last

A batch overwrites its own folders and no others, so a batch that runs twice leaves
the same rows, and a retry with fewer rows leaves none of the dead attempt's behind.
Its row in ``batches`` makes it count: readers join every table with ``batches``
(a left semi join on the partition columns, so Spark prunes the folders), and a batch
that has its row is not run again.

Facts, users, billing events, the rollup and the newest activity are appended as
mergeable rows.  Bots, accounts and subscriptions are small and written whole; the
batch committed last holds the present ones.  All streams of one deployment run in one
driver and take ``Sink.lock`` for a batch, so none replaces what another has just read.

The row of a batch also says how many events it added for each owner and month; the
quota counters (``streaming.totals``) read them from there.
"""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botlens.operators.billing import BILLING_DELTA, merge_billing_events
from botlens.operators.ingest import merge_users
from botlens.operators.recent import NEWEST_SCHEMA, merge_newest, newest_daily
from botlens.operators.rollup import ROLLUP_SCHEMA, daily_rollup, merge_rollups, user_step
from botlens.schemas import TABLE_SCHEMAS, empty
from botlens.session import drop_path
from botlens.sources.tables import Tables

FACTS = ["messages", "payments", "bot_health_logs", "activity_logs"]
WHOLE = ["bots", "accounts", "subscriptions"]
APPENDED = {"users_delta": TABLE_SCHEMAS["users"], "billing_delta": BILLING_DELTA, "rollup_daily": ROLLUP_SCHEMA,
            "newest_daily": NEWEST_SCHEMA}
REJECTED = ("source string, ingest_seq long, received_at timestamp, kind string, body string, "
            "error_code string, error_field string, error_detail string")
# one row of a batch for each owner and month that it counts for, one with nulls if there is none
BATCHES = "n long, tables array<string>, owner_account_id string, month date, events long, stream string, batch_id long"

_locks: dict[str, threading.RLock] = defaultdict(threading.RLock)


def _with_batch(schema) -> T.StructType:
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return T.StructType([*schema.fields, T.StructField("stream", T.StringType()), T.StructField("batch_id", T.LongType())])


class Sink:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.lock = _locks[self.root]

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def folder(self, table: str, stream: str, batch_id: int) -> str:
        return f"{self.root}/{table}/stream={stream}/batch_id={batch_id}"

    # --- batches ---------------------------------------------------------------------

    def batches(self) -> DataFrame:
        """The rows of all committed batches."""
        path = f"{self.root}/batches"
        return self.spark.read.schema(BATCHES).parquet(path) if self._exists(path) \
            else self.spark.createDataFrame([], BATCHES)

    def is_committed(self, stream: str, batch_id: int) -> bool:
        """Whether readers see the batch's row (the same files that they and the counters read)."""
        return not self.batches().filter((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).isEmpty()

    def commit(self, stream: str, batch_id: int, tables: list[str], usage: DataFrame | None = None) -> None:
        """Make a batch count.  ``usage``: (owner_account_id, month, events); one file, so the commit is
        there whole or not at all (it has one row an owner and month of the batch)."""
        last = self.batches().agg(F.max("n")).first()[0]
        none = self.spark.createDataFrame([(None, None, None)], "owner_account_id string, month date, events long")
        rows = none if usage is None else none.unionByName(usage.select(*none.columns))
        rows = rows.select(F.lit((last or 0) + 1).cast("long").alias("n"),
                           F.array(*[F.lit(t) for t in tables]).cast("array<string>").alias("tables"), *none.columns)
        rows.coalesce(1).write.mode("overwrite").parquet(self.folder("batches", stream, batch_id))

    # --- writing ---------------------------------------------------------------------

    def write(self, table: str, df: DataFrame, stream: str, batch_id: int) -> None:
        """Write a batch's rows of one table over whatever an earlier attempt has left."""
        if table in FACTS:
            dated = df.drop("event_date").withColumn("event_date", F.to_date("created_at"))
            writer = dated.hint("rebalance", "event_date").sortWithinPartitions(
                "event_date", "bot_id", "created_at").write.partitionBy("event_date")
        else:
            writer = df.write
        writer.mode("overwrite").parquet(self.folder(table, stream, batch_id))

    def own(self, table: str, stream: str, batch_id: int) -> DataFrame:
        """What this batch has written of a table (for its own aggregates)."""
        schema = TABLE_SCHEMAS[table] if table in TABLE_SCHEMAS else APPENDED[table]
        return self.spark.read.schema(schema).parquet(self.folder(table, stream, batch_id))

    def write_ingest(self, stream: str, batch_id: int, out, state: Tables) -> None:
        """Write one ``IngestOutput`` with its rollup, newest activity and signed user rows; commit last."""
        if self.is_committed(stream, batch_id):
            return
        tables = {**out.facts, "users_delta": out.users_delta, "rejected": out.rejected, "bots": out.bots}
        tables = {t: df for t, df in tables.items() if df is not None}
        for table, df in tables.items():
            self.write(table, df, stream, batch_id)
        # the aggregates of what has just been written, so the facts are not computed twice
        facts = Tables({t: self.own(t, stream, batch_id) for t in FACTS if t in tables})
        rollup = daily_rollup(facts)
        if "users_delta" in tables:
            rollup = rollup.unionByName(user_step(state.users, self.own("users_delta", stream, batch_id))[1])
        self.write("rollup_daily", merge_rollups(rollup), stream, batch_id)
        self.write("newest_daily", newest_daily(facts.activity_logs), stream, batch_id)
        bots = tables.get("bots", state.bots)
        owner = bots.select(F.col("id").alias("bot_id"), "owner_account_id")
        usage = facts.activity_logs.groupBy("bot_id", F.to_date(F.trunc("created_at", "MM")).alias("month")).count() \
            .join(owner, "bot_id").groupBy("owner_account_id", "month").agg(F.sum("count").alias("events"))
        self.commit(stream, batch_id, [*tables, "rollup_daily", "newest_daily"], usage)
        for path in out.staged:
            drop_path(self.spark, path)

    def write_tables(self, stream: str, batch_id: int, tables: dict[str, DataFrame]) -> None:
        """Write whole tables and appended rows of a batch; commit last."""
        if self.is_committed(stream, batch_id):
            return
        for table, df in tables.items():
            self.write(table, df, stream, batch_id)
        self.commit(stream, batch_id, list(tables))

    # --- reading ---------------------------------------------------------------------

    def rows(self, table: str, schema) -> DataFrame | None:
        """The committed rows of a table, None if nobody has written one."""
        path = f"{self.root}/{table}"
        if not self._exists(path):
            return None
        # the comparison tells Spark that the batches are a selection, so it prunes the folders by them
        done = self.batches().filter((F.col("n") > 0) & F.array_contains("tables", table)).select("stream", "batch_id").distinct()
        return (self.spark.read.schema(_with_batch(schema)).parquet(path)
                .join(done, ["stream", "batch_id"], "left_semi").drop("stream", "batch_id"))

    def present(self, table: str) -> DataFrame | None:
        """The rows of a table that is written whole, as the batch committed last has left them."""
        last = self.batches().filter(F.array_contains("tables", table)).agg(
            F.max_by(F.struct("stream", "batch_id"), "n").alias("b")).first().b
        if last is None:
            return None
        return self.spark.read.schema(TABLE_SCHEMAS[table]).parquet(self.folder(table, last.stream, last.batch_id))

    def rejected(self) -> DataFrame | None:
        return self.rows("rejected", REJECTED)

    def read_state(self, base: Tables | None = None) -> Tables:
        """Base tables and all committed batches."""
        out = Tables(base or Tables())
        for table in FACTS:
            rows = out.get_or_empty(self.spark, table)
            if "event_date" not in rows.columns:
                rows = rows.withColumn("event_date", F.to_date("created_at"))
            dated = T.StructType([*TABLE_SCHEMAS[table].fields, T.StructField("event_date", T.DateType())])
            own = self.rows(table, dated)
            out[table] = rows if own is None else rows.unionByName(own)
        for table in WHOLE:
            now = self.present(table)
            if now is not None:
                out[table] = now
        users = self.rows("users_delta", APPENDED["users_delta"])
        if users is not None:
            out["users"] = merge_users(out.get_or_empty(self.spark, "users").unionByName(users))
        out.setdefault("users", empty(self.spark, "users"))
        billing = self.rows("billing_delta", APPENDED["billing_delta"])
        if billing is not None:
            out["billing_events"] = merge_billing_events(out.get_or_empty(self.spark, "billing_events"), billing)
        return out

    def read_rollup(self, base: DataFrame | None = None) -> DataFrame | None:
        """The daily rollup, facts and users, of all batches (and a base one): neither is read for it."""
        own = self.rows("rollup_daily", ROLLUP_SCHEMA)
        parts = [p for p in (base, own) if p is not None]
        return merge_rollups(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])) if parts else None

    def read_newest(self, base: DataFrame | None = None) -> DataFrame | None:
        """The newest activity of all batches (and a base one)."""
        own = self.rows("newest_daily", NEWEST_SCHEMA)
        parts = [p for p in (base, own) if p is not None]
        return merge_newest(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])) if parts else None
