"""Removal of repeated word windows with sharded repeated-phrase automata.

1. Every window of SIZE words holds a phrase of PHRASE words whose hash is the
   least of the window.  These phrases are counted over all documents; a window
   that recurs has one that recurs.
2. Documents are dealt into shards of a few MB.  Each shard compiles the
   recurring phrases that its documents have into an Aho-Corasick automaton over
   word numbers and streams its documents through it.  The windows around each
   occurrence are candidates, and the shard names the first of each.
3. Those first ones are compared over all shards, and each shard hears which of
   its windows start earlier elsewhere.
4. Every other occurrence of a window loses its words.

What recurs is exchanged by hash in blocks of packed numbers: a block holds what
one task has for one slot.  A phrase goes to its slot once for each document that
has it, twice if it recurs there, as two numbers; a window once for each shard.  Window hashes have 64 bits;
two different windows take each other's place with a chance of 2 ** -64 a pair.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlens.session import stage

from .common import WORD_BYTES, encode
from .grams import least_in_windows, rolling, word_hashes

SHARD = 4 << 20        # bytes of text in a shard of documents, about
SLOT = 16 << 20        # bytes of text whose hashes a slot takes, about
HELD = 1 << 20         # hashes that a task holds before it passes them on
LAST_ID = (1 << 63) - 1


def packed(values) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def longs(blocks) -> np.ndarray:
    return np.frombuffer(b"".join(blocks), np.int64)


def among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values the sorted array holds; a binary search each, however long it is."""
    if not len(held):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(held, values), len(held) - 1)
    return held[at] == values


def by_slot(hashes: np.ndarray, slots: int, *others: np.ndarray):
    """(slot, hashes, *others) of each slot that has some; the order within a slot is kept."""
    slot = (hashes.view(np.uint64) >> np.uint64(20)) % np.uint64(slots)
    order = np.argsort(slot, kind="stable")
    found, starts = np.unique(slot[order], return_index=True)
    for s, part in zip(found.tolist(), np.split(order, starts[1:])):
        yield int(s), hashes[part], *(x[part] for x in others)


def phrases(hashes: np.ndarray, size: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the phrases that stand for the windows of a text."""
    if len(hashes) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = rolling(hashes, phrase)
    at = least_in_windows(grams, size - phrase + 1)
    return at, grams[at].view(np.int64)


def recurring_phrases(docs: DataFrame, size: int, phrase: int, slots: int) -> DataFrame:
    """(shard, hashes): packed hashes of the recurring phrases that a shard's documents have."""
    def emit(batches):
        held, shards, n = [], [], 0

        def blocks():
            for slot, h, s in by_slot(np.concatenate(held), slots, np.concatenate(shards)):
                yield slot, packed(h), packed(s)

        columns = ["slot", "hashes", "shards"]
        for batch in batches:
            for shard, text in zip(batch["shard"].tolist(), batch["text"]):
                _, own = phrases(word_hashes(encode(text)), size, phrase)
                own, count = np.unique(own, return_counts=True)
                own = np.concatenate([own, own[count > 1]])       # twice tells that it recurs
                held.append(own)
                shards.append(np.full(len(own), shard, np.int64))
                n += len(own)
            if n >= HELD:
                yield pd.DataFrame(list(blocks()), columns=columns)
                held, shards, n = [], [], 0
        if n:
            yield pd.DataFrame(list(blocks()), columns=columns)

    def count(pdf):
        hashes, shards = longs(pdf["hashes"]), longs(pdf["shards"])
        order = np.lexsort((shards, hashes))
        hashes, shards = hashes[order], shards[order]
        same = hashes[1:] == hashes[:-1]
        recurs = np.r_[same, False] | np.r_[False, same]
        hashes, shards = hashes[recurs], shards[recurs]
        once = np.r_[True, (hashes[1:] != hashes[:-1]) | (shards[1:] != shards[:-1])][:len(hashes)]
        hashes, shards = hashes[once], shards[once]
        order = np.argsort(shards, kind="stable")
        found, starts = np.unique(shards[order], return_index=True)
        return pd.DataFrame([(s, packed(hashes[part])) for s, part in zip(found, np.split(order, starts[1:]))],
                            columns=["shard", "hashes"])

    return (docs.select("shard", "text").mapInPandas(emit, "slot int, hashes binary, shards binary")
            .groupBy("slot").applyInPandas(count, "shard long, hashes binary"))


ALPHABET = 64          # symbols at each place of a word's number: a node has at most so many children


def automaton_of(found: list[list[bytes]]):
    """(automaton, codes, width): phrases as texts of word numbers.

    A number is ``width`` characters, each place with an alphabet of its own, so
    matches keep to word borders and no node has many children (they are
    searched one by one).
    """
    words = dict.fromkeys(w for phrase in found for w in phrase)
    width = 1
    while ALPHABET ** width < len(words):
        width += 1
    codes = {w: "".join(chr(1 + place * ALPHABET + i // ALPHABET ** place % ALPHABET) for place in range(width))
             for i, w in enumerate(words)}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase in found:
        automaton.add_word("".join([codes[w] for w in phrase]))
    automaton.make_automaton()
    return automaton, codes, width


def candidates(words: list[bytes], automaton, codes: dict, width: int, size: int) -> np.ndarray:
    """Starts of the windows that hold an occurrence of a phrase."""
    marks = np.zeros(len(words) + 2, np.int32)
    get, other = codes.get, "\0" * width
    for last, length in automaton.iter("".join([get(w, other) for w in words])):
        end = (last + 1) // width                    # word after the occurrence
        marks[max(0, end - size)] += 1               # first start whose window reaches the end
        marks[end - length // width + 1] -= 1
    inside = np.cumsum(marks)[:max(0, len(words) - size + 1)] > 0
    return np.flatnonzero(inside)


def ranked(doc_ids: pd.Series) -> np.ndarray:
    """Ids as numbers that order documents; null comes last."""
    return doc_ids.astype("Int64").fillna(LAST_ID).to_numpy(np.int64)


def first_windows(docs: DataFrame, recurring: DataFrame, size: int, phrase: int, slots: int) -> DataFrame:
    """Rows of two kinds: documents (slot null) with their candidate starts, and, by slot, packed
    hashes of the shard's candidate windows with the least document that holds each."""
    def run(key, texts, blocks):
        shard = int(key[0])
        wanted = np.sort(longs(blocks["hashes"]))
        split, hashed, has, found = [], [], [], {}
        for text in texts["text"]:
            raw = encode(text)
            words, hashes = WORD_BYTES.findall(raw), word_hashes(raw)
            split.append(words)
            hashed.append(hashes)
            at, own = phrases(hashes, size, phrase)
            at = at[among(own, wanted)]
            has.append(len(at))
            for i in at.tolist():
                found.setdefault(tuple(words[i:i + phrase]))
        starts = [np.empty(0, np.int64)] * len(split)
        if found:
            automaton, codes, width = automaton_of(list(found))
            # a text none of whose windows stands for a recurring phrase has no window that recurs
            starts = [candidates(w, automaton, codes, width, size) if n else none
                      for w, n, none in zip(split, has, starts)]
        out, windows, owners = [], [], []
        for doc_id, rank, text, words, hashes, own in zip(texts["doc_id"], ranked(texts["doc_id"]), texts["text"], split,
                                                          hashed, starts):
            plain = not len(own)
            out.append((shard, doc_id, len(words), hashlib.sha256(b" ".join(words)).hexdigest() if plain else None,
                        None if plain else text, None if plain else packed(own.astype(np.int32)), None, None, None))
            if not plain:
                windows.append(rolling(hashes, size)[own].view(np.int64))
                owners.append(np.full(len(own), rank))
        if windows:
            hashes, owner = np.concatenate(windows), np.concatenate(owners)
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            once = np.r_[True, hashes[1:] != hashes[:-1]]
            order = np.argsort(owner[once], kind="stable")       # long runs of one document
            for slot, h, o in by_slot(hashes[once][order], slots, owner[once][order]):
                out.append((shard, None, None, None, None, None, slot, packed(h), packed(o)))
        table = pd.DataFrame(out, columns=["shard", "doc_id", "n_words", "sha", "text", "starts", "slot", "hashes", "owners"])
        return table.astype({"doc_id": "Int64", "n_words": "Int64", "slot": "Int64"})

    kinds = ("shard long, doc_id long, n_words long, sha string, text string, starts binary, slot long, "
             "hashes binary, owners binary")
    return docs.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInPandas(run, kinds)


def earlier_elsewhere(blocks: DataFrame) -> DataFrame:
    """(shard, hashes): a shard's windows that a smaller document of another shard holds."""
    def run(pdf):
        hashes, owners = longs(pdf["hashes"]), longs(pdf["owners"])
        shards = np.repeat(pdf["shard"].to_numpy(np.int64), [len(x) // 8 for x in pdf["hashes"]])
        order = np.lexsort((owners, hashes))
        hashes, owners, shards = hashes[order], owners[order], shards[order]
        first = np.r_[True, hashes[1:] != hashes[:-1]]
        least = owners[first][np.cumsum(first) - 1]
        late = owners > least
        hashes, shards = hashes[late], shards[late]
        order = np.argsort(shards, kind="stable")
        found, starts = np.unique(shards[order], return_index=True)
        return pd.DataFrame([(s, packed(hashes[part])) for s, part in zip(found, np.split(order, starts[1:]))],
                            columns=["shard", "hashes"])

    return blocks.select("slot", "shard", "hashes", "owners").groupBy("slot").applyInPandas(
        run, "shard long, hashes binary")


def cut(docs: DataFrame, earlier: DataFrame, size: int) -> DataFrame:
    """Documents with candidates after removal: (doc_id, n_words, n_removed, kept_sha256, removed)."""
    def run(key, texts, blocks):
        away = np.sort(longs(blocks["hashes"]))
        rows, all_hashes, all_starts, all_ranks = [], [], [], []
        for rank, text, starts in zip(ranked(texts["doc_id"]), texts["text"], texts["starts"]):
            raw = encode(text)
            at = np.frombuffer(starts, np.int32).astype(np.int64)
            rows.append(WORD_BYTES.findall(raw))
            all_hashes.append(rolling(word_hashes(raw), size)[at].view(np.int64))
            all_starts.append(at)
            all_ranks.append(np.full(len(at), rank))
        if not rows:
            return pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])
        hashes, starts, ranks = map(np.concatenate, (all_hashes, all_starts, all_ranks))
        row = np.repeat(np.arange(len(rows)), [len(x) for x in all_starts])
        order = np.lexsort((starts, ranks, hashes))
        h, r, s = hashes[order], ranks[order], starts[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
        local = (r > r[first][group]) | (s > s[first][group])      # an earlier start in this shard
        late = np.empty(len(h), bool)
        late[order] = local
        late |= among(hashes, away)
        out = []
        bounds = np.searchsorted(row, np.arange(len(rows) + 1))
        for i, (doc_id, words) in enumerate(zip(texts["doc_id"], rows)):
            own = slice(bounds[i], bounds[i + 1])
            gone = starts[own][late[own]]
            marks = np.zeros(len(words) + 1, np.int32)
            np.add.at(marks, gone, 1)
            np.add.at(marks, gone + size, -1)
            removed = np.cumsum(marks[:-1]) > 0
            kept = b" ".join([w for w, x in zip(words, removed.tolist()) if not x])
            edges = np.flatnonzero(np.diff(np.r_[False, removed, False].astype(np.int8)))
            spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
            out.append((doc_id, len(words), int(removed.sum()), hashlib.sha256(kept).hexdigest(), spans))
        table = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])
        return table.astype({"doc_id": "Int64"})

    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start long, end long>>"
    return docs.groupBy("shard").cogroup(earlier.groupBy("shard")).applyInPandas(run, kinds)


def dedup(docs: DataFrame, size: int = 20, phrase: int = 10) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word spans of every row.

    A word goes if a window that covers it has the words of a window that starts
    earlier: in a smaller doc_id, or in the same doc_id at a smaller start.  Rows
    with one doc_id count as one document (a repeated row keeps what its twin
    keeps); a null doc_id comes after all others.  Null and empty texts have no
    words; an empty table gives an empty result.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, slots = total // SHARD + 1, total // SLOT + 1
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(shards)).alias("shard"))
    recurring = recurring_phrases(dealt, size, phrase, slots)
    found = stage(first_windows(dealt, recurring, size, phrase, slots), "windows")
    texts = found.filter("slot is null")
    earlier = earlier_elsewhere(found.filter("slot is not null"))
    done = cut(texts.filter("sha is null").select("shard", "doc_id", "text", "starts"), earlier, size)
    clean = texts.filter("sha is not null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"))
    return clean.unionByName(done)
