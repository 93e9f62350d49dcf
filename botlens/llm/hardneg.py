"""Hard-negative mining over candidate blocks in Hilbert order, with zone maps.

1. Every row's vector becomes integers; its place on a Hilbert curve through the
   vector space (``BITS`` bits a dimension) is its sort key.  Rows are range-partitioned
   by label and key, sorted, and written to Parquet as blocks of at most ``BLOCK`` rows
   of one label, each with a zone map: the least and greatest value of every dimension.
2. The anchors of neighbouring blocks form chunks of at most ``CHUNK`` anchors with a zone
   map of their own.  Scores inside an anchor's own block give a first bound on its last positive.
3. Positives: a chunk meets the blocks of its label whose greatest possible score (interval
   arithmetic over both zone maps) reaches a bound; in the task the same arithmetic, now
   for each single anchor, chooses the blocks that the anchor reads.  Bounds rise as blocks are read.
4. Negatives: a chunk meets the blocks of other labels whose possible scores overlap one of its
   anchors' windows [low * p, high * p]; again each anchor reads only blocks that overlap its own
   windows and can still beat what was found.

Nothing is approximate: a block is left out only if no row of it can be in the result.  How
much that saves depends on the data; independent random vectors of many dimensions cannot be
told apart by intervals, and there every block is read.

The anchors are the query set and are taken in waves of at most ``WAVE`` bytes, shipped to the
tasks as a broadcast table; each wave scans the blocks once and no candidate is shuffled.
A task sends at most the wanted number of rows an anchor (or window).

Defined cases: rows with a null label, id or vector or with a null or non-finite component take no
part; shorter vectors count as filled up with zeros; equal scores go by smaller id; rows with equal
ids are rows of their own; an anchor without positives, or a positive without negatives, has no rows;
an empty table gives no rows; further columns are ignored.  Integer scores must fit 64 bits,
otherwise ValueError.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from botlens.session import stage

BITS = 2
BLOCK = 1024
CHUNK = 512
WAVE = 16 << 20
NONE = -(1 << 63)


# ---- the curve ----

def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n x d, values below 2 ** bits), as n x bytes.

    Rows compare by bytes as their places compare.
    """
    x = cells.astype(np.int64).T.copy()                          # one row a dimension
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(d):
            upper = (x[i] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    planes = [(x >> level) & 1 for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).astype(np.uint8), axis=0).T


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class Grid:
    """Integer vectors of one table: their length, storage type and exact product type."""

    def __init__(self, size: int, least: float, most: float, scale: int):
        self.size, self.scale = max(size, 1), scale
        self.least, self.most = math.floor(scale * least), math.floor(scale * most)
        top = max(abs(self.least), abs(self.most), 1)
        if self.size * top * top >= 1 << 63:
            raise ValueError(f"inner products of {self.size} components up to {top} exceed 64 bits")
        self.kind = np.dtype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")
        exact = self.size * top * top                            # every partial sum stays below it
        self.work = np.dtype("f4" if exact < 1 << 24 else "f8" if exact < 1 << 53 else "i8")

    def pack(self, vectors) -> np.ndarray:
        out = np.zeros((len(vectors), self.size), np.float64)
        for i, v in enumerate(vectors):
            out[i, :len(v)] = v
        return np.floor(self.scale * out).astype(self.kind)

    def keys(self, rows: np.ndarray) -> list[bytes]:
        span = self.most - self.least + 1
        cells = (rows.astype(np.float64) - self.least) * (1 << BITS) // span
        return [k.tobytes() for k in hilbert_keys(cells.clip(0, (1 << BITS) - 1), BITS)]

    def read(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.size).astype(self.work)


# ---- blocks and chunks ----

def blocks_of(rows: DataFrame, grid: Grid) -> DataFrame:
    """(block, label, ids, vectors, least, most): rows of one label in the order of the curve."""
    def key(batches):
        for batch in batches:
            packed = grid.pack(batch["vector"].tolist())
            yield pd.DataFrame({"label": batch["label"], "id": batch["id"], "turn": batch["turn"],
                                "key": grid.keys(packed) if len(packed) else [], "vector": [v.tobytes() for v in packed]})

    def pack(batches):
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(frame):
            nonlocal number
            frame = frame.sort_values("id", kind="stable")
            data = b"".join(frame["vector"])
            whole = np.frombuffer(data, grid.kind).reshape(-1, grid.size)
            number += 1
            return {"block": (part << 32) + number, "label": frame["label"].iloc[0], "vectors": data,
                    "ids": frame["id"].to_numpy(np.int64).tobytes(), "least": whole.min(axis=0).tolist(),
                    "most": whole.max(axis=0).tolist()}

        def blocks(frame, last):
            """The full blocks of a sorted frame and what is left of it."""
            out, edges = [], np.flatnonzero(np.diff(frame["label"].to_numpy())) + 1
            runs = np.split(np.arange(len(frame)), edges)
            for i, run in enumerate(runs):
                end = len(run) if last or i < len(runs) - 1 else len(run) // BLOCK * BLOCK
                out += [block(frame.iloc[run[a:min(a + BLOCK, end)]]) for a in range(0, end, BLOCK)]
            return out, frame.iloc[runs[-1][end:]]

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 4 * BLOCK:
                out, rest = blocks(pd.concat(held, ignore_index=True), False)
                held = [rest]
                yield pd.DataFrame(out)
        if any(map(len, held)):
            yield pd.DataFrame(blocks(pd.concat(held, ignore_index=True), True)[0])

    spark = rows.sparkSession
    keyed = rows.withColumn("turn", F.monotonically_increasing_id()).mapInPandas(
        key, "label long, id long, turn long, key binary, vector binary")
    # id and row number deal out a vector that many rows share
    order = ["label", "key", "id", "turn"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("key", "turn").mapInPandas(
        pack, "block long, label long, ids binary, vectors binary, least array<long>, most array<long>")


def first_best(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each row without its own place (NONE if there are fewer others)."""
    held = scores.astype(np.int64)
    held[np.arange(len(own)), own] = NONE
    if held.shape[1] <= k:
        return np.full(len(own), NONE)
    return np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]


def chunks_of(blocks: DataFrame, grid: Grid, every: int, k: int) -> DataFrame:
    """(chunk, label, homes, places, ids, vectors, bounds, least, most): anchors of neighbouring blocks."""
    def gather(batches):
        part, number, held = TaskContext.get().partitionId(), 0, []

        def chunk():
            nonlocal number
            number += 1
            whole = np.concatenate([h[3] for h in held])
            joined = lambda i: np.concatenate([h[i] for h in held]).astype(np.int64)
            return {"chunk": (part << 32) + number, "label": held[0][5], "homes": joined(0).tobytes(),
                    "places": joined(1).tobytes(), "ids": joined(2).tobytes(), "vectors": whole.astype(grid.kind).tobytes(),
                    "bounds": joined(4).tobytes(), "lowest": int(joined(4).min()),
                    "least": whole.min(axis=0).astype(np.int64).tolist(), "most": whole.max(axis=0).astype(np.int64).tolist()}

        for batch in batches:
            out = []
            for row in batch.itertuples():
                ids = np.frombuffer(row.ids, np.int64)
                at = np.flatnonzero(ids % every == 0)
                if not len(at):
                    continue
                if held and (held[0][5] != row.label or sum(len(h[0]) for h in held) + len(at) > CHUNK):
                    out.append(chunk())
                    held = []
                whole = grid.read(row.vectors)
                for cut in np.array_split(at, -(-len(at) // CHUNK)):
                    if held and sum(len(h[0]) for h in held) + len(cut) > CHUNK:
                        out.append(chunk())
                        held = []
                    bounds = first_best(whole[cut] @ whole.T, cut, k)
                    held.append((np.full(len(cut), row.block), cut, ids[cut], whole[cut], bounds, row.label))
            if out:
                yield pd.DataFrame(out)
        if held:
            yield pd.DataFrame([chunk()])

    return blocks.select("block", "label", "ids", "vectors").mapInPandas(
        gather, "chunk long, label long, homes binary, places binary, ids binary, vectors binary, bounds binary, "
                "lowest long, least array<long>, most array<long>")


# ---- interval arithmetic ----

def product_bound(upper: bool) -> Column:
    """Greatest (least) inner product of a vector in the chunk's zone and one in the block's zone."""
    pick = F.greatest if upper else F.least
    zones = F.arrays_zip(F.col("c.least").alias("a"), F.col("c.most").alias("b"),
                         F.col("b.least").alias("c"), F.col("b.most").alias("d"))
    return F.aggregate(zones, F.lit(0).cast("long"), lambda total, z: total + pick(
        z["a"] * z["c"], z["a"] * z["d"], z["b"] * z["c"], z["b"] * z["d"]))


def score_bounds(anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with a vector in the zone."""
    above, below = np.maximum(anchors, 0), np.minimum(anchors, 0)
    least, most = np.asarray(least).astype(anchors.dtype), np.asarray(most).astype(anchors.dtype)
    return (above @ least + below @ most).astype(np.int64), (above @ most + below @ least).astype(np.int64)


class Best:
    """The k best (score, id) of each of many keys, best first; equal scores by smaller id."""

    def __init__(self, bounds: np.ndarray, k: int):
        n = len(bounds)
        self.k, self.bounds = k, bounds
        self.scores, self.ids = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """What a further score must reach."""
        return np.maximum(self.scores[:, -1], self.bounds)

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(keys):
            return
        touched = np.unique(keys)
        keys = np.concatenate([keys, np.repeat(touched, self.k)])
        scores = np.concatenate([scores, self.scores[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids, -scores, keys))                 # NONE is its own negative: but for it all sort right
        order = order[np.lexsort((scores[order] == NONE, keys[order]))]
        keys, scores, ids = keys[order], scores[order], ids[order]
        place = np.arange(len(keys)) - np.searchsorted(keys, keys)
        use = place < self.k
        self.scores[keys[use], place[use]] = scores[use]
        self.ids[keys[use], place[use]] = ids[use]

    def rows(self):
        return np.nonzero(self.scores != NONE)


def hits(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, best: Best, ceiling: np.ndarray | None = None):
    """Entries of a score matrix (a row a key) that belong among the best."""
    least = best.least()[keys][:, None]
    last = np.where(best.scores[keys, -1] == least[:, 0], best.ids[keys, -1], np.iinfo(np.int64).max)[:, None]
    use = (scores > least) | ((scores == least) & (ids[None, :] <= last))
    if ceiling is not None:
        use &= scores <= ceiling[:, None]
    return use


# ---- mining ----

def positives_of(blocks: DataFrame, chunks: DataFrame, grid: Grid, k: int) -> DataFrame:
    """(chunk, anchor, score, id): each task's best rows of the anchor's label."""
    def search(batches):
        held = {}
        for batch in batches:
            for row in batch.itertuples():
                if row.chunk not in held:
                    held[row.chunk] = (grid.read(row.anchors), np.frombuffer(row.homes, np.int64),
                                       np.frombuffer(row.places, np.int64), Best(np.frombuffer(row.bounds, np.int64), k))
                anchors, homes, places, best = held[row.chunk]
                _, most = score_bounds(anchors, row.least, row.most)
                read = np.flatnonzero(most >= best.least())
                if not len(read):
                    continue
                ids = np.frombuffer(row.ids, np.int64)
                scores = (anchors[read] @ grid.read(row.vectors).T).astype(np.int64)
                use = hits(scores, ids, read, best)
                home = np.flatnonzero(homes[read] == row.block)
                use[home, places[read[home]]] = False            # the anchor itself
                a, b = np.nonzero(use)
                best.add(read[a], scores[a, b], ids[b])
        for chunk, (*_, best) in held.items():
            a, place = best.rows()
            yield pd.DataFrame({"chunk": chunk, "anchor": a, "score": best.scores[a, place], "id": best.ids[a, place]})

    met = blocks.alias("b").join(F.broadcast(chunks.alias("c")), (F.col("b.label") == F.col("c.label"))
                                 & (product_bound(True) >= F.col("c.lowest")))
    met = met.select("c.chunk", F.col("c.vectors").alias("anchors"), "c.homes", "c.places", "c.bounds",
                     "b.block", "b.ids", "b.vectors", "b.least", "b.most")
    return met.mapInPandas(search, "chunk long, anchor long, score long, id long")


def negatives_of(blocks: DataFrame, chunks: DataFrame, grid: Grid, k: int, low: int, high: int) -> DataFrame:
    """(chunk, window, score, id): each task's best rows of other labels in each window."""
    def search(batches):
        held = {}
        for batch in batches:
            for row in batch.itertuples():
                if row.chunk not in held:
                    of = np.array(row.owner, np.int64)
                    floor = np.array([-(-low * int(p) // 100) for p in row.score], np.int64)
                    ceiling = np.array([min(high * int(p) // 100, -1 - NONE) for p in row.score], np.int64)
                    held[row.chunk] = grid.read(row.anchors), of, ceiling, Best(floor, k)
                anchors, of, ceiling, best = held[row.chunk]
                least, most = score_bounds(anchors, row.least, row.most)
                read = np.flatnonzero((most[of] >= best.least()) & (least[of] <= ceiling) & (best.bounds <= ceiling))
                if not len(read):
                    continue
                ids = np.frombuffer(row.ids, np.int64)
                own, place = np.unique(of[read], return_inverse=True)
                scores = (anchors[own] @ grid.read(row.vectors).T).astype(np.int64)
                for at in np.array_split(np.arange(len(read)), -(-len(read) // CHUNK)):
                    part = scores[place[at]]
                    a, b = np.nonzero(hits(part, ids, read[at], best, ceiling[read[at]]))
                    best.add(read[at][a], part[a, b], ids[b])
        for chunk, (*_, best) in held.items():
            a, place = best.rows()
            yield pd.DataFrame({"chunk": chunk, "window": a, "score": best.scores[a, place], "id": best.ids[a, place]})

    met = blocks.alias("b").join(F.broadcast(chunks.alias("c")), (F.col("b.label") != F.col("c.label"))
                                 & (product_bound(True) >= F.col("c.lowest")) & (product_bound(False) <= F.col("c.highest")))
    met = met.select("c.chunk", F.col("c.vectors").alias("anchors"), "c.owner", "c.score",
                     "b.ids", "b.vectors", "b.least", "b.most")
    return met.mapInPandas(search, "chunk long, window long, score long, id long")


def first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key over all tasks, with their rank."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def mine_wave(blocks: DataFrame, chunks: DataFrame, grid: Grid, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    found = first(positives_of(blocks, chunks, grid, positives), ["chunk", "anchor"], positives)
    # the windows of a chunk: at most CHUNK * positives
    windows = found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("anchor", "rank", "score", "id"))).alias("w"))
    part = stage(chunks.join(windows, "chunk").select(
        "chunk", "label", "ids", "vectors", "least", "most", F.col("w.anchor").alias("owner"), F.col("w.score").alias("score"),
        F.col("w.id").alias("positive"), F.array_min(F.transform("w.score", lambda p: F.floor(p.cast("decimal(19,0)") * low / 100))).alias("lowest"),
        F.array_max(F.transform("w.score", lambda p: F.ceil(p.cast("decimal(19,0)") * high / 100))).alias("highest")),
        "mining-windows")

    def named(batches):
        for batch in batches:
            for row in batch.itertuples():
                of = np.array(row.owner, np.int64)
                yield pd.DataFrame({"chunk": row.chunk, "window": np.arange(len(of)), "positive_score": np.array(row.score, np.int64),
                                    "anchor_id": np.frombuffer(row.ids, np.int64)[of], "positive_id": np.array(row.positive, np.int64)})

    names = part.select("chunk", "ids", "owner", "score", "positive").mapInPandas(
        named, "chunk long, window long, positive_score long, anchor_id long, positive_id long")
    best = first(negatives_of(blocks, part, grid, negatives, low, high), ["chunk", "window"], negatives)
    return names.join(best, ["chunk", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; a window holds the scores s with
    low * p <= 100 * s <= high * p for the positive's score p.
    """
    spark = rows.sparkSession
    q = lambda name: F.col(f"`{name}`")
    rows = rows.select(q(id).cast("long").alias("id"), q(label).cast("long").alias("label"), q(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    size, least, most = rows.agg(F.max(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    grid = Grid(size or 0, min(least or 0.0, 0.0), max(most or 0.0, 0.0), scale)
    blocks = stage(blocks_of(rows, grid), "mining-blocks")
    chunks = stage(chunks_of(blocks, grid, every, positives), "mining-chunks")
    # zones, vectors, bounds, places and windows of a chunk, with room for the positives
    each = CHUNK * (grid.size * grid.kind.itemsize + 32 + 24 * positives) + 16 * grid.size
    waves = max(1, -(-chunks.count() * each // WAVE))
    done = []
    for wave in range(waves):
        part = chunks.filter(F.pmod(F.xxhash64("chunk"), F.lit(waves)) == wave)
        found = mine_wave(blocks, part, grid, positives, negatives, low, high)
        done.append(found if waves == 1 else stage(found, "mined"))
    return reduce(DataFrame.unionByName, done)
