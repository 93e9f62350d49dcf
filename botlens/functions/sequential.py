"""Skew-safe sequential state over an arrival order.

The reference applies events one at a time; a rule such as "reject when
this owner already has N events" becomes a running count over
``ingest_seq`` per key.  A plain ``Window.partitionBy(key)`` would send all
rows of a hot key (say a third of the batch) to one task, so the prefix sum
is computed in two levels: per (key, seq chunk) totals, a prefix over the
chunk totals, then a running sum inside each chunk.  No group holds more
than ``chunk`` rows of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 17           # arrivals of a chunk: so many rows of a key a task sorts at once, whatever the key's share


def exclusive_running_sum(df: DataFrame, keys: list[str], order: str, value: str,
                          out: str, chunk: int = CHUNK, of_keys: DataFrame | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows with the same ``keys`` and a
    smaller ``order`` (which must be unique per key).

    ``of_keys`` (``keys`` and other columns) is left-joined to the rows; the join
    meets the chunk totals, so the rows of a hot key do not gather in one task."""
    with_chunk = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    totals = with_chunk.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_ct"))
    if of_keys is not None:
        totals = totals.join(of_keys, keys, "left")
    # by value: a key that ``of_keys`` has twice counts its rows twice, as in a join with the rows
    prior = Window.partitionBy(*keys).orderBy("_chunk").rangeBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_ct").over(prior), F.lit(0))).drop("_ct")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return (with_chunk.join(offsets, [*keys, "_chunk"])
            .withColumn(out, (F.col("_off") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
                        .cast("long"))
            .drop("_chunk", "_off"))


def last_non_null(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                  chunk: int = CHUNK) -> DataFrame:
    """``out`` = latest non-null ``value`` up to and including each row.

    Used for "customer id so far" style state.  Two levels as above: one
    row per (key, chunk) holds the chunk's last non-null value, a window over
    that small table carries it forward, and a window inside each chunk does
    the rest, so a hot key is spread over chunks instead of one task.
    """
    with_chunk = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    per_chunk = with_chunk.groupBy(*keys, "_chunk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    prior = Window.partitionBy(*keys).orderBy("_chunk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(*keys, "_chunk",
                               F.last("_last", ignorenulls=True).over(prior).alias("_carry"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (with_chunk.join(carried, [*keys, "_chunk"])
            .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carry")))
            .drop("_chunk", "_carry"))
