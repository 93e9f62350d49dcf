"""Line dedup: lines that many documents share are dropped from all of them.

Every line's key (white space stripped, A-Z lower-cased) has a 128-bit hash.  The
documents of each distinct hash are counted by Spark.  The hashes that are found in
``least`` documents are dealt to shards; each shard's task builds a minimal perfect
hash over its hashes (levels of bit arrays, a key is settled on the first level where
it meets no other) and puts 64 bits of fingerprint and the count at the key's slot.
Documents probe these arrays: the first half of a line's hash names shard and slot,
the second half must be the fingerprint there.  No line is joined with another.

The arrays are shipped to the tasks in waves of at most ``WAVE`` bytes.  As a rule one
wave holds them all (a shared line takes 10.5 bytes however long it is or however
often it occurs) and the documents are read once more; beyond it the hashes of all
lines are written once, every wave reads them and finds the lines that it knows, and
the found lines are joined to the documents by row number.  Both ways give the same rows.

Defined cases: a null or empty text is one empty line; a key of fewer than
``min_chars`` code points is never dropped; a line that stands several times in a
document counts once and goes everywhere; rows with equal or null doc_id are documents
of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlens.session import stage

from .common import encode

BLANKS = b" \t\n\x0b\x0c\r"                       # fixed values: stripped from both ends of a line
HELD = 400_000                                    # hashes that a counting task holds before it sends them on
SHARD = 1 << 18                                   # hashes of a shard, on average
WAVE = 32 << 20                                   # bytes of arrays that are shipped at once
LEVELS = 24
COUNT_MAX = (1 << 16) - 1


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys."""
    lines = encode(text).split(b"\n")
    return lines, [line.strip(BLANKS).lower() for line in lines]


def long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars


def halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


# ---- counting ----

def shared_lines(docs: DataFrame, least: int, min_chars: int) -> DataFrame:
    """(h1, h2, n): line hashes found in ``least`` documents or more."""
    def count(batches):
        held = Counter()

        def flush():
            h1, h2 = halves(b"".join(held))
            return pd.DataFrame({"h1": h1.view(np.int64), "h2": h2.view(np.int64), "n": list(held.values())})

        for batch in batches:
            for text in batch["text"]:
                keys = set(line_keys(text)[1])
                held.update(xxhash.xxh3_128_digest(k) for k in keys if long_enough(k, min_chars))
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    counts = docs.select("text").mapInPandas(count, "h1 long, h2 long, n long")
    return counts.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# ---- minimal perfect hash ----

def place(h1: np.ndarray, level: int, size: int) -> np.ndarray:
    """The keys' places among ``size`` bits of a level."""
    x = h1 ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class LineIndex:
    """Fingerprints and counts of a shard's line hashes, by a minimal perfect hash of the first half."""

    def __init__(self, sizes, words, prints, counts, rest1, rest2, rest_counts):
        self.sizes, self.words = sizes, words
        self.prints, self.counts = prints, counts
        self.rest1, self.rest2, self.rest_counts = rest1, rest2, rest_counts
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(sizes // 64)])
        self.longest = int(np.unique(rest1, return_counts=True)[1].max()) if len(rest1) else 0

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> LineIndex:
        left = np.arange(len(h1))
        sizes, bits, settled = [], [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = 64 * -(-len(left) // 32)                      # about two bits a key
            at = place(h1[left], level, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            taken = np.zeros(size, bool)
            taken[at[alone]] = True
            order = np.argsort(at[alone])
            sizes.append(size)
            bits.append(np.packbits(taken, bitorder="little").view("<u8"))
            settled.append(left[alone][order])
            left = left[~alone]
        slots = np.concatenate(settled) if settled else np.empty(0, np.int64)
        left = left[np.lexsort((h2[left], h1[left]))]            # the few that met others on every level
        words = np.concatenate(bits) if bits else np.empty(0, np.uint64)
        few = np.minimum(n, COUNT_MAX).astype(np.uint16)
        return cls(np.array(sizes, np.int64), words.astype(np.uint64), h2[slots], few[slots], h1[left], h2[left], few[left])

    FIELDS = {"sizes": np.int64, "words": np.uint64, "prints": np.uint64, "counts": np.uint16,
              "rest1": np.uint64, "rest2": np.uint64, "rest_counts": np.uint16}

    def dump(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name in self.FIELDS}

    @classmethod
    def load(cls, row) -> LineIndex:
        return cls(*(np.frombuffer(bytes(row[name]), kind) for name, kind in cls.FIELDS.items()))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The count of each line, 0 for one that is not in the index."""
        found = np.zeros(len(h1), np.int64)
        left = np.arange(len(h1))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                return found
            at = place(h1[left], level, size)
            word, bit = self.starts[level] + (at >> 6), (at & 63).astype(np.uint64)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            slot = self.before[word[hit]] + np.bitwise_count(below)
            here = left[hit]
            found[here] = np.where(self.prints[slot] == h2[here], self.counts[slot], 0)
            left = left[~hit]
        first = np.searchsorted(self.rest1, h1[left])
        for step in range(self.longest):
            at = np.minimum(first + step, len(self.rest1) - 1)
            same = (self.rest1[at] == h1[left]) & (self.rest2[at] == h2[left])
            found[left[same]] = self.rest_counts[at[same]]
        return found


def shard_of(h1, shards: int):
    return h1 % np.uint64(shards)


def index_shards(lines: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its arrays as binary columns, and their bytes."""
    def build(rows):
        arrays = LineIndex.build(rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64),
                                 rows["n"].to_numpy()).dump()
        return pd.DataFrame([{"shard": rows["shard"].iloc[0], "bytes": sum(map(len, arrays.values())), **arrays}])

    unsigned = F.col("h1").cast("decimal(20,0)") + F.when(F.col("h1") < 0, F.expr("18446744073709551616BD")).otherwise(0)
    schema = "shard long, bytes long, " + ", ".join(f"{name} binary" for name in LineIndex.FIELDS)
    return lines.withColumn("shard", (unsigned % shards).cast("long")).groupBy("shard").applyInPandas(build, schema)


class Probe:
    """Counts of lines from the shards of one wave."""

    def __init__(self, shards: int, rows):
        self.shards = shards
        self.held = {row["shard"]: LineIndex.load(row) for row in rows}

    def counts(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), np.int64)
        shard = shard_of(h1, self.shards).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        numbers, starts = np.unique(shard[order], return_index=True)
        for number, at in zip(numbers.tolist(), np.split(order, starts[1:])):
            if number in self.held:
                out[at] = self.held[number].probe(h1[at], h2[at])
        return out


def waves_of(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Shard numbers of each wave, at most WAVE bytes of arrays together (one shard at least)."""
    waves, room = [], 0
    for shard, size in sizes:
        if not waves or size > room:
            waves.append([])
            room = WAVE
        waves[-1].append(shard)
        room -= size
    return waves


def hashes_of(texts, min_chars: int):
    """Lines of all texts, the number of lines of each, their hashes, and whether they may be dropped."""
    lines, keys, sizes = [], [], []
    for text in texts:
        a, b = line_keys(text)
        lines += a
        keys += b
        sizes.append(len(a))
    h1, h2 = halves(b"".join(map(xxhash.xxh3_128_digest, keys)))
    may = np.fromiter((long_enough(k, min_chars) for k in keys), bool, len(keys))
    return lines, np.array(sizes, np.int64), h1, h2, may


RESULT = "doc_id string, n_lines long, n_dropped long, dropped array<struct<line:int,documents:int>>, text string"


def without(ids, texts, counts_of, min_chars: int) -> pd.DataFrame:
    """The texts without the lines to which ``counts_of(h1, h2, sizes)`` gives a count."""
    lines, sizes, h1, h2, may = hashes_of(texts, min_chars)
    counts = np.where(may, counts_of(h1, h2, sizes), 0)
    ends = np.cumsum(sizes)
    out = []
    for doc, start, end in zip(ids, (ends - sizes).tolist(), ends.tolist()):
        own = counts[start:end]
        gone = np.flatnonzero(own)
        body = lines[start:end] if not len(gone) else [lines[start + i] for i in np.flatnonzero(own == 0).tolist()]
        out.append((doc, end - start, len(gone), [{"line": i, "documents": int(own[i])} for i in gone.tolist()],
                    b"\n".join(body).decode("utf-8", "surrogatepass")))
    return pd.DataFrame(out, columns=["doc_id", "n_lines", "n_dropped", "dropped", "text"])


def dedup(docs: DataFrame, least: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped, text): documents without the lines found in ``least`` documents.

    ``dropped`` has the number of each line that went and in how many documents it was found
    (65,535: in as many or more); ``text`` is what stays, joined by line feeds.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("string"), "text")    # longs with nulls would come as floats
    shared = stage(shared_lines(docs, least, min_chars), "shared-lines")
    shards = max(1, -(-shared.count() // SHARD))
    arrays = stage(index_shards(shared, shards), "line-index")
    sizes = [tuple(r) for r in arrays.select("shard", "bytes").orderBy("shard").collect()]
    waves = waves_of(sizes)

    def shipped(wave):
        rows = arrays.filter((F.col("shard") >= wave[0]) & (F.col("shard") <= wave[-1])).collect()
        return spark.sparkContext.broadcast([row.asDict() for row in rows])

    if len(waves) <= 1:
        held = shipped(waves[0]) if waves else None

        def drop(batches):
            probe = Probe(shards, held.value if held else [])
            for batch in batches:
                yield without(batch["doc_id"], batch["text"], lambda h1, h2, _: probe.counts(h1, h2), min_chars)

        return docs.mapInPandas(drop, RESULT).withColumn("doc_id", F.col("doc_id").cast(kind))

    docs = stage(docs.withColumn("row", F.monotonically_increasing_id()), "line-documents")

    def hashed(batches):
        for batch in batches:
            _, sizes, h1, h2, may = hashes_of(batch["text"], min_chars)
            both = np.stack([h1, h2], axis=1)
            cuts = np.cumsum(sizes)[:-1]
            yield pd.DataFrame({"row": batch["row"], "hashes": [x.tobytes() for x in np.split(both, cuts)]})

    hashes = stage(docs.mapInPandas(hashed, "row long, hashes binary"), "line-hashes")
    found = None
    for wave in waves:
        held = shipped(wave)

        def look(batches, held=held):
            probe = Probe(shards, held.value)
            for batch in batches:
                own = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in batch["hashes"]]
                if not own:
                    continue
                both = np.concatenate(own)
                counts = probe.counts(both[:, 0], both[:, 1])
                cuts = np.cumsum([len(x) for x in own])[:-1]
                rows = [(row, [{"line": i, "documents": int(c[i])} for i in np.flatnonzero(c).tolist()])
                        for row, c in zip(batch["row"], np.split(counts, cuts)) if c.any()]
                yield pd.DataFrame(rows, columns=["row", "dropped"])

        part = stage(hashes.mapInPandas(look, "row long, dropped array<struct<line:int,documents:int>>"), "line-hits")
        found = part if found is None else found.unionByName(part)
        held.destroy()
    # one row a document: the hits of a document are at most its lines
    found = found.groupBy("row").agg(F.flatten(F.collect_list("dropped")).alias("known"))

    def drop_known(batches):
        for batch in batches:
            def counts_of(h1, h2, sizes):
                counts = np.zeros(len(h1), np.int64)
                starts = np.cumsum(sizes) - sizes
                for start, known in zip(starts.tolist(), batch["known"]):
                    for hit in (known if known is not None else ()):
                        counts[start + hit["line"]] = hit["documents"]
                return counts
            yield without(batch["doc_id"], batch["text"], counts_of, min_chars)

    kept = docs.join(found, "row", "left").select("doc_id", "text", "known").mapInPandas(drop_known, RESULT)
    return kept.withColumn("doc_id", F.col("doc_id").cast(kind))
