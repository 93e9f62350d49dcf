"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within r bits share a variant within r / 2 bits of both.  So
every fingerprint emits all its variants within half the radius, and the
fingerprints that meet in a variant are linked.  At r = 4 these are 2081
variants, nearly all of which meet nothing; shuffling each would move a
hundred times the input.  So the variants are dealt by a prefix of theirs: a
task gets, for each prefix that a fingerprint's variants have, the fingerprint
once, makes the variants with this prefix again and sorts them.  With a prefix of 12
bits these are 79 rows a fingerprint instead of 2081, over 4096 cells; larger
inputs and crowded cells take prefixes of a few bits more.

Fingerprints that share a variant are within r bits of each other, so a
variant's group needs no pairs: its members are tied to the least one, each tie
is verified, and a cell passes on a spanning forest of its ties.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botlens.session import stage

from .common import packed, words_lower
from .components import connected

def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of a whole text (null or no word: zero)."""
    words = words_lower(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[starts[i]:ends[i + last] - 1], 42) for i in range(n)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):                  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def fingerprints(text: Column, shingle: int) -> Column:
    """Fingerprint of each text as a signed long."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return run(text)


@functools.cache
def masks(bits: int, radius: int) -> np.ndarray:
    """All words of ``bits`` bits with at most ``radius`` bits set."""
    out = [sum(1 << b for b in flips) for k in range(radius + 1) for flips in itertools.combinations(range(bits), k)]
    return np.array(out, np.uint64)


STEP = 4                 # bits by which a prefix grows
FIRST = 12               # bits of the shortest prefix that is dealt
CELL = 8_000_000         # variants a cell may hold before it is dealt by a longer prefix
ROWS = 1_000_000         # fingerprints it may hold
BATCH = 250_000          # variants that a task makes at a time


def forest(pairs: np.ndarray) -> np.ndarray:
    """Spanning forest of ``pairs`` of indices, each tied to its tree's least."""
    nodes, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:                                      # hook the larger root to the smaller, then shorten
        x, y = label[ends[:, 0]], label[ends[:, 1]]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[tied], nodes[label[tied]]], axis=1)


def meetings(fps: np.ndarray, mine: np.ndarray, cell: int, prefix: int, distance: int):
    """Forests of the pairs among ``fps[mine]`` that share a variant of the cell.

    A cell of more than BATCH variants is dealt by a longer prefix first; so is one whose
    members are too many for a number of theirs in the bits that the prefix leaves free.
    """
    half, own = distance // 2, fps[mine]
    used = np.bitwise_count((own >> np.uint64(64 - prefix)) ^ np.uint64(cell))
    left = [masks(64 - prefix, half - spent) for spent in range(half + 1)]
    made = sum(int((used == spent).sum()) * len(left[spent]) for spent in range(half + 1))
    if prefix < 64 and (made > BATCH or len(mine) > 1 << prefix):
        step = min(STEP, 64 - prefix)
        below = (own >> np.uint64(64 - prefix - step)) & np.uint64((1 << step) - 1)
        keys = []
        for flip in masks(step, half):
            fit = np.flatnonzero(used + np.bitwise_count(flip) <= half).astype(np.uint64)
            keys.append((below[fit] ^ flip) << np.uint64(32) | fit)
        keys = np.sort(np.concatenate(keys))
        tops, at = keys >> np.uint64(32), (keys & np.uint64((1 << 32) - 1)).astype(np.int64)
        borders = np.searchsorted(tops, np.arange((1 << step) + 1, dtype=np.uint64))
        for top, (start, end) in enumerate(itertools.pairwise(borders.tolist())):
            if end - start > 1:
                yield from meetings(fps, mine[at[start:end]], cell << step | top, prefix + step, distance)
        return
    # a variant's bits below the prefix, then the number of its member: sorted, those that meet lie together
    base = own << np.uint64(prefix) | np.arange(len(mine), dtype=np.uint64)
    keys = np.concatenate([(base[used == spent][:, None] ^ (left[spent] << np.uint64(prefix))[None, :]).ravel()
                           for spent in range(half + 1)])
    keys.sort()
    same = np.flatnonzero((keys[1:] ^ keys[:-1]) >> np.uint64(prefix) == 0)
    if not len(same):
        return
    first = np.r_[True, np.diff(same) != 1]
    starts = same[first][np.cumsum(first) - 1]
    pairs = mine[(keys[np.stack([same + 1, starts], axis=1)] & np.uint64((1 << prefix) - 1)).astype(np.int64)]
    yield forest(pairs[np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= distance])


def ties(fps: np.ndarray, cell: int, prefix: int, distance: int) -> np.ndarray:
    """Spanning forest of the links that the variants of one cell show: (fingerprint, the least it is tied to).

    Every fingerprint makes its variants whose top ``prefix`` bits are ``cell``;
    those that share one are tied to the least and each tie is verified.
    """
    fps = np.unique(fps)
    found = list(meetings(fps, np.arange(len(fps)), cell, prefix, distance))
    return fps[forest(np.concatenate(found))] if found else np.empty((0, 2), np.uint64)


def deal(rows: DataFrame, prefix: int, distance: int, before: int | None = None) -> DataFrame:
    """(fp, cell) with ``prefix`` bits from (fp, cell) with ``before`` (STEP fewer)."""
    before = prefix - STEP if before is None else before
    step = prefix - before
    flips = F.explode(F.array(*[F.lit(int(m)) for m in masks(step, distance // 2)]).cast("array<bigint>"))
    own = F.shiftrightunsigned("fp", 64 - prefix).bitwiseAND(F.lit((1 << step) - 1))
    cell = F.shiftleft(F.col("cell"), step).bitwiseOR(own.bitwiseXOR(F.col("flip")))
    made = rows.select("fp", "cell", flips.alias("flip")).select("fp", cell.alias("cell"))
    return made.filter(spent(prefix) <= distance // 2)


def spent(prefix: int):
    """Flips that a fingerprint's variants in its cell have above the prefix."""
    return F.bit_count(F.shiftrightunsigned("fp", 64 - prefix).bitwiseXOR(F.col("cell")))


def heavy(rows: DataFrame, prefix: int, distance: int) -> DataFrame:
    """Cells in which more than CELL variants or ROWS fingerprints meet."""
    made = F.lit(0)
    for used in range(distance // 2 + 1):
        made = F.when(spent(prefix) == used, len(masks(64 - prefix, distance // 2 - used))).otherwise(made)
    return (rows.groupBy("cell").agg(F.sum(made).alias("n"), F.count("*").alias("rows"))
            .filter((F.col("n") > CELL) | (F.col("rows") > ROWS)).select("cell"))


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints (column fp): each cell's forest.

    The first prefix grows with the number of fingerprints, crowded cells are dealt by a few
    bits more: a cell then holds a good part of CELL at any size, and cells grow no faster than the input.
    """
    if distance % 2:
        raise ValueError("the ball method needs an even bit distance")

    def run(pdf):
        prefix, cell = int(pdf["prefix"].iloc[0]), int(pdf["cell"].iloc[0])
        found = ties(pdf["fp"].to_numpy(np.int64).view(np.uint64), cell & ((1 << prefix) - 1), prefix, distance)
        return pd.DataFrame({"a": found[:, 0].astype(np.uint64).view(np.int64),
                             "b": found[:, 1].astype(np.uint64).view(np.int64)})

    prefix, variants = FIRST, fps.count() * len(masks(64, distance // 2))
    while prefix < 64 and variants >> prefix > CELL // 2:
        prefix += STEP
    rows, parts = deal(fps.select("fp", F.lit(0).cast("long").alias("cell")), prefix, distance, 0), []
    while True:
        full = None if prefix == 64 else stage(heavy(rows, prefix, distance), "cells")
        if full is None or not full.limit(1).count():
            parts.append(rows.withColumn("prefix", F.lit(prefix)))
            break
        parts.append(rows.join(full, "cell", "left_anti").select("fp", "cell").withColumn("prefix", F.lit(prefix)))
        rows = deal(rows.join(full, "cell", "left_semi").select("fp", "cell"), prefix + STEP, distance)
        prefix += STEP
    dealt = parts[0]
    for part in parts[1:]:
        dealt = dealt.unionByName(part)
    return dealt.groupBy("prefix", "cell").applyInPandas(run, "a long, b long").distinct()


def classes(marked: DataFrame, distance: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of ``marked`` (doc_id, fp)."""
    least = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-ids")
    roots = connected(links(least.select("fp"), distance)).withColumnRenamed("node", "fp")
    named = stage(least.join(roots, "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")), "roots")
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the least doc_id that can be reached over links of at most
    ``distance`` bits.  Null and empty texts have fingerprint zero and are
    linked like any other.  A row whose doc_id is null keeps a null doc_id and
    belongs to its fingerprint's component, whose id is null only if no member
    has an id.  Repeated rows come out as often as they came in; an empty table
    gives an empty result.
    """
    marked = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                               fingerprints(F.col("text"), shingle).alias("fp")), "fingerprints")
    return marked.join(classes(marked, distance), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row of each component, with the columns it came with.

    The least doc_id stays; of rows with the same id, and where no member has
    one, that with the least text hash, then the first read.
    """
    rows = stage(docs.select(
        packed(docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_at"),
        F.col("doc_id").cast("long").alias("_id"), fingerprints(F.col("text"), shingle).alias("_fp")), "fingerprinted")
    marked = rows.select("_at", F.col("_id").alias("doc_id"), F.col("_fp").alias("fp"),
                         F.coalesce(F.xxhash64("_row.text"), F.lit(0)).alias("tie"))
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tie", F.col("_at").alias("at")))
    stay = (marked.join(classes(marked.select("doc_id", "fp"), distance), "fp")
            .groupBy("root").agg(best.alias("best")).select(F.col("best.at").alias("_at")))
    # the rows that stay grow with the input: a shuffle join at every size
    return rows.join(stay.hint("merge"), "_at", "left_semi").select("_row.*")


def hex_fp(fp):
    """16 lowercase hex digits of a fingerprint kept as a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
