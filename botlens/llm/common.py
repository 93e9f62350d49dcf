"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the white space of the word rule [^\x20\x09-\x0D]+
BLANKS = " \t\n\x0b\x0c\r"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")

# Arrow batches are bounded in rows and bytes, so a batch of very long texts
# does not outgrow a Python worker.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def bounded_batches(spark: SparkSession) -> None:
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(columns: list[str]) -> Column:
    """The named columns as one struct, whatever is in their names: others can then be put beside it."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in columns])


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array (null: none)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def total(array: Column) -> Column:
    """Sum of an array of longs."""
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + x)


def words_lower(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8 (null: none)."""
    return WORD_BYTES.findall(encode(text).lower())


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def bucket(value: Column) -> Column:
    """Lower bound of the sketch bucket of a non-negative long: five leading bits after the first."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def frequent(counts: DataFrame, limit: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words of (word, c), at most ``limit``, and their counts, most frequent first.

    The least count comes from a histogram, so no task sends more than it must.
    """
    groups = counts.groupBy(bucket(F.col("c")).alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect()
    held, least = 0, None                             # whole groups of like frequency are taken
    for row in groups:
        held += row.n
        if held > limit:
            break
        least = row.b
    if least is None:
        return [], np.empty(0, np.int64)
    rows = sorted(((-r.c, r.word.encode()) for r in counts.filter(F.col("c") >= least).collect()))
    return [w for _, w in rows], np.array([-n for n, _ in rows], np.int64)
