"""The domain tables as DataFrames (read with declared schemas)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from botlens.schemas import TABLE_SCHEMAS, empty


class Tables(dict):
    """Named domain DataFrames; attribute access for convenience."""

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError as exc:
            raise AttributeError(name) from exc

    def with_(self, **changes) -> "Tables":
        out = Tables(self)
        out.update(changes)
        return out

    def get_or_empty(self, spark: SparkSession, name: str) -> DataFrame:
        return self[name] if name in self else empty(spark, name)


def read_tables(spark: SparkSession, root: str, names=None) -> Tables:
    """Read domain tables stored as parquet folders under ``root``.

    The schema is always given, never inferred; fact tables are expected to
    be partitioned by event date so time-window filters prune folders.
    """
    out = Tables()
    for name in names or TABLE_SCHEMAS:
        out[name] = spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{root}/{name}")
    return out
