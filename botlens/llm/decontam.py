"""Benchmark decontamination by winnowing.

A window is ``size`` consecutive words of an item (or a whole shorter item).
Documents and items keep the least k-gram hash of every window, so each window
that both share has a common fingerprint.  Fingerprints are joined, and each
hit is extended to both sides along the words; a stretch as long as the item's
window marks its words.

A document's fingerprint travels with the few words around it that an extension
can need, so texts are read once and never shuffled.  Before the join a Bloom
filter of the items' fingerprints, of fixed size whatever the benchmark's,
drops those that cannot match; the join itself needs no size bound.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlens.session import stage

from .common import encode, packed
from .grams import Hashes, gram_hashes, least_in_windows

# fixed value: the words of the contract, in bytes (all delimiters are ASCII)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GRAM = 5                       # words in a k-gram, fewer for shorter windows
BLOOM_BITS = 1 << 22           # one bit an entry, collected as at most so many numbers


def words_in(text: str | None) -> list[bytes]:
    return WORD.findall(encode(text).lower())


def selected(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints of the k-grams kept for windows of ``size`` words."""
    k = min(GRAM, size)
    grams = gram_hashes(hashes, k, size)              # windows of another length are apart
    at = least_in_windows(grams, size - k + 1)
    return at, grams[at].view(np.int64)


def around(words: list[bytes], at: int, size: int) -> tuple[int, str]:
    """First index and text of the words that a window over the k-gram at ``at`` can hold."""
    k = min(GRAM, size)
    first = max(0, at + k - size)
    return first, b" ".join(words[first:at + size]).decode("utf-8", "surrogatepass")


def item_prints(items: DataFrame, item_id: str, size: int) -> DataFrame:
    """(item_id, size, fp, at, first, near) of every benchmark item with a word."""
    def run(batches):
        cache = Hashes()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                words = words_in(text)
                own = min(size, len(words))
                if own:
                    for at, fp in zip(*selected(cache.of(words), own)):
                        rows.append((item, own, int(fp), int(at), *around(words, int(at), own)))
            yield pd.DataFrame(rows, columns=["item_id", "size", "fp", "at", "first", "near"])

    return items.select(F.col(item_id).cast("string").alias("item_id"), "text").mapInPandas(
        run, "item_id string, size int, fp long, at int, first int, near string")


def bloom_bits(prints: DataFrame) -> bytes:
    """Bloom filter of the items' fingerprints, in BLOOM_BITS / 8 bytes."""
    at = prints.select(F.pmod("fp", F.lit(BLOOM_BITS)).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    held = np.zeros(BLOOM_BITS // 64, "<i8")
    for row in words.collect():                       # at most BLOOM_BITS / 64 rows
        held[row.word] = row.bits
    return held.tobytes()


def doc_prints(docs: DataFrame, sizes: list[int], bloom: bytes) -> DataFrame:
    """(row, doc_id, text_hash, n_words, prints) of every document; prints: those that may match."""
    def run(batches):
        cache = Hashes()
        held = np.unpackbits(np.frombuffer(bloom, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            counts, prints = [], []
            for text in batch["text"]:
                words = words_in(text)
                hashes, found = cache.of(words), []
                for size in sizes:
                    at, fps = selected(hashes, size)
                    may = np.flatnonzero(held[fps & (BLOOM_BITS - 1)])
                    for i in may.tolist():
                        first, near = around(words, int(at[i]), size)
                        found.append({"size": size, "fp": int(fps[i]), "at": int(at[i]), "first": first, "near": near})
                counts.append(len(words))
                prints.append(found)
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"].astype("Int64"),
                                "text_hash": batch["text_hash"], "n_words": counts, "prints": prints})

    kinds = "row long, doc_id long, text_hash long, n_words long, prints array<struct<size int, fp long, at int, first int, near string>>"
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, kinds)


def extended(pairs: DataFrame) -> DataFrame:
    """(row, item_id, start, stop): the words that a hit marks after its extension."""
    def run(batches):
        for batch in batches:
            out = []
            for row, item, size, at, first, near, t_at, t_first, t_near in batch.itertuples(index=False):
                mine, theirs = near.split(" "), t_near.split(" ")
                i, j = at - first, t_at - t_first
                left = 0
                while left < min(i, j) and mine[i - left - 1] == theirs[j - left - 1]:
                    left += 1
                right = 0
                while right < min(len(mine) - i, len(theirs) - j) and mine[i + right] == theirs[j + right]:
                    right += 1
                if right >= min(GRAM, size) and left + right >= size:
                    out.append((row, item, at - left, at + right))
            yield pd.DataFrame(out, columns=["row", "item_id", "start", "stop"])

    columns = ["row", "item_id", "size", "at", "first", "near", "t_at", "t_first", "t_near"]
    return pairs.select(*columns).mapInPandas(run, "row long, item_id string, start int, stop int").distinct()


def scan(docs: DataFrame, items: DataFrame, size: int = 10, item_id: str = "item_id") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items and item_ids (sorted texts) of every row of ``docs``.

    Null and empty texts have no words and no hits; items without a word have no
    window; items whose id is null count as one item, not listed among the ids.
    Repeated rows are judged each; an empty table on either side gives zero hits
    or an empty result.  text_hash (xxhash64 of the text) and doc_id tell rows apart.
    """
    prints = stage(item_prints(items, item_id, size), "benchmark-prints")
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())   # at most ``size`` numbers
    base = stage(doc_prints(docs, sizes, bloom_bits(prints)), "document-prints")
    theirs = prints.select("item_id", "size", "fp", F.col("at").alias("t_at"), F.col("first").alias("t_first"),
                           F.col("near").alias("t_near"))
    pairs = base.select("row", F.explode("prints").alias("p")).select("row", "p.*").join(theirs, ["size", "fp"])
    spans = stage(extended(pairs), "benchmark-spans")
    hits = (spans.select("row", F.explode(F.sequence("start", F.col("stop") - 1)).alias("word")).distinct()
            .groupBy("row").agg(F.count("*").alias("n_hit")))
    ids = (spans.select("row", "item_id").distinct().groupBy("row").agg(
        F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("item_ids")))
    return base.drop("prints").join(hits, "row", "left").join(ids, "row", "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` without a hit, with the columns they came with."""
    found = scan(docs.select("doc_id", "text"), items, size).filter("n_hit > 0")
    hit = stage(found.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct(), "contaminated")
    rows = docs.select(packed(docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    return rows.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("hash") == F.col("hit_hash")),
                     "left_anti").select("_row.*")
