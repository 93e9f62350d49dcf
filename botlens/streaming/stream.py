"""Structured Streaming ingest.

Raw JSON lines land in a folder (a Kafka source is a drop-in replacement);
each micro-batch runs the batch operator inside ``foreachBatch`` and is written to
the sink under its stream's name and batch id.  A committed batch is not run again,
and a failed attempt is never seen, so delivery into the sink is exactly-once (T6).
The streams of one deployment run in one driver; a batch holds the sink's lock while
it reads the state and writes.

No watermark is set on the event stream: the reference accepts backdated
events without limit (T2), so dropping late rows would change answers.
Platform updates may opt in to de-duplication by ``update_id`` (T4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botlens.operators.billing import apply_account_changes, apply_billing_batch
from botlens.operators.bots import apply_bot_changes, enforce_bot_cap, resolve_bots
from botlens.plans.ingest_batch import Secrets, ingest_api_batch, ingest_platform_batch
from botlens.session import drop_path, stage
from botlens.sources.sink import Sink
from botlens.sources.tables import Tables
from botlens.streaming.totals import QuotaCounters, usage_by_month

API_RAW = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("api_key", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("ingest_seq", T.LongType()),
    T.StructField("received_at", T.TimestampType())])

PLATFORM_RAW = T.StructType([
    T.StructField("bot_id", T.StringType()), T.StructField("body", T.StringType()),
    T.StructField("ingest_seq", T.LongType()), T.StructField("received_at", T.TimestampType())])


def _once(sink: Sink, stream: str, body):
    """foreachBatch function that runs ``body(batch, batch_id)`` for batches not committed yet, one at a time."""
    def run(batch: DataFrame, batch_id: int) -> None:
        with sink.lock:
            if not sink.is_committed(stream, batch_id) and not batch.isEmpty():
                body(batch, batch_id)
    return run


def api_batch_writer(sink: Sink, base: Tables, secrets: Secrets, stream: str = "api", usage: DataFrame | None = None):
    """foreachBatch function for API events.

    The quota base comes from the counters in the state store, which take in every
    committed batch; ``usage`` (account_id, month, events) is what was there before,
    by default the base facts, counted once."""
    counters = {}

    def body(batch: DataFrame, batch_id: int) -> None:
        if not counters:
            before = usage if usage is not None else (
                usage_by_month(base) if "activity_logs" in base
                else batch.sparkSession.createDataFrame([], "account_id string, month date, events long"))
            counters["quota"] = QuotaCounters(sink, stage(before, "base-usage"))
        counters["quota"].refresh()
        state = sink.read_state(base)
        sink.write_ingest(stream, batch_id, ingest_api_batch(batch, state, secrets, usage_at=counters["quota"].usage_at), state)
    return _once(sink, stream, body)


def platform_batch_writer(sink: Sink, base: Tables, stream: str = "platform"):
    def body(batch: DataFrame, batch_id: int) -> None:
        state = sink.read_state(base)
        out = ingest_platform_batch(batch, state)
        out.bots = None                      # platform updates never change bots
        sink.write_ingest(stream, batch_id, out, state)
    return _once(sink, stream, body)


def start_api_ingest(spark: SparkSession, source_dir: str, sink: Sink, base: Tables,
                     secrets: Secrets, checkpoint: str, available_now: bool = False,
                     max_files_per_trigger: int | None = None, usage: DataFrame | None = None):
    """Start the API event stream: JSON lines with ``API_RAW`` fields."""
    reader = spark.readStream.schema(API_RAW)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(source_dir)
    writer = (stream.writeStream.foreachBatch(api_batch_writer(sink, base, secrets, usage=usage))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def drop_redelivered(stream: DataFrame, within: str) -> DataFrame:
    """Platform updates of a stream without those whose update_id has come within the watermark (T4)."""
    return (stream.withColumn("update_id", F.get_json_object("body", "$.update_id").cast("long"))
            .withWatermark("received_at", within)
            .dropDuplicatesWithinWatermark(["bot_id", "update_id"])
            .drop("update_id"))


def start_platform_ingest(spark: SparkSession, source_dir: str, sink: Sink, base: Tables,
                          checkpoint: str, available_now: bool = False,
                          dedupe_within: str | None = None):
    """Start the platform update stream.  ``dedupe_within`` (e.g. "1 hour")
    drops redelivered updates with the same update_id inside that watermark."""
    stream = spark.readStream.schema(PLATFORM_RAW).json(source_dir)
    if dedupe_within:
        stream = drop_redelivered(stream, dedupe_within)
    writer = (stream.writeStream.foreachBatch(platform_batch_writer(sink, base))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


BILLING_RAW = T.StructType([
    T.StructField("body", T.StringType()), T.StructField("ingest_seq", T.LongType()),
    T.StructField("received_at", T.TimestampType())])


def billing_batch_writer(sink: Sink, base: Tables, stream: str = "billing"):
    """foreachBatch for billing notifications (E3: I14-I17).  Billing events are
    appended as mergeable rows; subscriptions and accounts are written whole."""
    def body(batch: DataFrame, batch_id: int) -> None:
        staged: list[str] = []
        events, subs, accounts, rejected = apply_billing_batch(batch, sink.read_state(base), staged)
        sink.write_tables(stream, batch_id, {"subscriptions": subs, "accounts": accounts, "billing_delta": events,
                                             "billing_rejected": rejected})
        for path in staged:
            drop_path(batch.sparkSession, path)
    return _once(sink, stream, body)


ACCOUNT_CHANGES = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("change", "email", "name", "api_key_hash", "account_id", "plan")],
    T.StructField("ingest_seq", T.LongType()), T.StructField("received_at", T.TimestampType())])

BOT_CONNECTS = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("owner_account_id", "bot_type", "bot_value")],
    T.StructField("ingest_seq", T.LongType()), T.StructField("received_at", T.TimestampType())])

BOT_CHANGES = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("bot_id", "change", "display_name", "telegram_bot_id",
                                                 "encrypted_token")],
    T.StructField("token_ok", T.BooleanType()),
    T.StructField("ingest_seq", T.LongType()), T.StructField("received_at", T.TimestampType())])


def account_change_writer(sink: Sink, base: Tables, stream: str = "account-changes"):
    """foreachBatch for registrations and plan changes."""
    def body(batch: DataFrame, batch_id: int) -> None:
        accounts, rejected = apply_account_changes(sink.read_state(base).accounts, batch)
        sink.write_tables(stream, batch_id, {"accounts": accounts, "account_rejected": rejected})
    return _once(sink, stream, body)


def bot_connect_writer(sink: Sink, base: Tables, secrets: Secrets, stream: str = "bot-connects"):
    """foreachBatch for connect requests."""
    def body(batch: DataFrame, batch_id: int) -> None:
        state = sink.read_state(base)
        allowed, over = enforce_bot_cap(batch, state.bots, state.accounts, secrets.token)
        _, bots, conflicts = resolve_bots(allowed.select(*batch.columns), state.bots, secrets.token)
        sink.write_tables(stream, batch_id, {"bots": bots, "connect_rejected": over.unionByName(conflicts)})
    return _once(sink, stream, body)


def bot_change_writer(sink: Sink, base: Tables, stream: str = "bot-changes"):
    """foreachBatch for verification, credentials and tracking."""
    def body(batch: DataFrame, batch_id: int) -> None:
        bots, rejected = apply_bot_changes(sink.read_state(base).bots, batch)
        sink.write_tables(stream, batch_id, {"bots": bots, "bot_rejected": rejected})
    return _once(sink, stream, body)


def start_changes(spark: SparkSession, source_dir: str, schema: T.StructType, writer, checkpoint: str,
                  available_now: bool = False):
    """Start a stream of JSON change rows into one of the change writers."""
    out = (spark.readStream.schema(schema).json(source_dir).writeStream.foreachBatch(writer)
           .option("checkpointLocation", checkpoint))
    return (out.trigger(availableNow=True) if available_now else out).start()


def start_billing_ingest(spark: SparkSession, source_dir: str, sink: Sink, base: Tables,
                         checkpoint: str, available_now: bool = False):
    stream = spark.readStream.schema(BILLING_RAW).json(source_dir)
    writer = (stream.writeStream.foreachBatch(billing_batch_writer(sink, base))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


RAW_SCHEMAS = {"api": API_RAW, "platform": PLATFORM_RAW, "billing": BILLING_RAW}


def read_raw(spark: SparkSession, path: str, source: str) -> DataFrame:
    """S2-S4 in batch: JSON lines with the declared raw schema (never
    inferred); the body stays a string until validation parses it."""
    return spark.read.schema(RAW_SCHEMAS[source]).json(path)
