"""Ranked lexical search: the best documents for each item, by accumulator-limited term-at-a-time.

1. Index: every document's length and its counts of the items' terms, written once.
2. Statistics: documents, terms and each term's document frequency over the whole index.
3. Search: each task turns its documents into inverted lists, shard by shard (``SHARD``
   postings), and takes each item's terms one at a time, rarest first.  A document
   gets an accumulator when a term first meets it.  As soon as the bounds of the terms
   to come together cannot reach the k-th partial score (nor the k-th score that the
   task already has for the item), no further accumulators are made; those that
   exist are updated by all remaining terms, so their scores are exact.
4. A task sends its k best an item; Spark merges them in two steps.

The stop is exact: a document without an accumulator can reach only the bounds of the
remaining terms, and partial scores never fall.  A tie could still be won by a smaller
doc_id, so the bounds must stay strictly below.

The items are the query set.  They are taken in blocks of at most about ``BLOCK`` bytes
of text (dealt by hash), so the vocabulary that is shipped to the tasks is bounded; each
block makes its own passes over the documents.

Defined cases: null and empty texts have no terms and no rank; an item without terms
has no rows; items with equal item_id are ranked on their own; rows with equal doc_id
are documents of their own; a null doc_id comes after all others among equal scores;
empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from botlens.session import stage

from .common import encode

SHARD = 2_000_000                                 # postings that a task holds as inverted lists
BLOCK = 4 << 20                                   # bytes of item texts that are searched at once
SALTS = 32
# term characters [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]: digits, letters and everything beyond ASCII
TERMS = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, A-Z lower-cased, in order."""
    return encode(text).translate(TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ---- index ----

def index(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs): length and counts of the vocabulary's terms of each document with a term."""
    def build(batches):
        number = vocabulary.value
        known = number.keys()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                terms = terms_of(text)
                hits = [number[t] for t in terms if t in known]
                ids, tfs = np.unique(np.array(hits, np.int32), return_counts=True)
                rows.append((len(terms), ids.astype(np.int32).tobytes(), tfs.astype(np.int32).tobytes()))
            frame = pd.DataFrame(rows, columns=["n", "terms", "tfs"])
            frame.insert(0, "doc_id", batch["doc_id"])
            yield frame[frame["n"] > 0]

    # ids travel as text: a batch of longs with nulls would come as floats
    docs = docs.select(F.col("doc_id").cast("string"), "text")
    return docs.mapInPandas(build, "doc_id string, n long, terms binary, tfs binary")


def frequencies(indexed: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; tasks send one count a term."""
    def count(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            if len(batch):
                df += np.bincount(np.frombuffer(b"".join(batch["terms"]), np.int32), minlength=size)
        held = np.flatnonzero(df)
        yield pd.DataFrame({"term": held, "df": df[held]})

    out = np.zeros(size, np.int64)
    for row in indexed.select("terms").mapInPandas(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


# ---- search ----

class Lists:
    """Inverted lists of one shard of documents: for each term its documents and integer impacts."""

    def __init__(self, frame: pd.DataFrame, n_docs: int, n_terms: int):
        self.size = len(frame)
        self.ids = frame["doc_id"].tolist()
        m = np.array([25 + (75 * n * n_docs) // n_terms for n in frame["n"].tolist()], np.int64)
        terms = np.frombuffer(b"".join(frame["terms"]), np.int32)
        tf = np.frombuffer(b"".join(frame["tfs"]), np.int32).astype(np.int64)
        docs = np.repeat(np.arange(self.size), [len(t) // 4 for t in frame["terms"]])
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
        order = np.argsort(terms, kind="stable")
        self.docs, self.impact = docs[order], impact[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.bounds = np.append(starts, len(order))
        self.top = np.maximum.reduceat(self.impact, starts) if len(starts) else np.empty(0, np.int64)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Places of the terms among this shard's lists, -1 for those without one."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)


def best_of(lists: Lists, terms: np.ndarray, factors: np.ndarray, k: int, floor: int = 0) -> list[tuple[int, int]]:
    """(score, document) of the k best documents of a shard (ties included beyond k).

    ``terms`` come rarest first; ``factors`` are their weights times their repeats in the item;
    only scores of ``floor`` or more are wanted.
    """
    at = lists.find(terms)
    at, factors = at[at >= 0], factors[at >= 0]
    if not len(at):
        return []
    to_come = np.append(np.cumsum((factors * lists.top[at])[::-1])[::-1], 0)
    if to_come[0] < floor:
        return []
    scores = np.zeros(lists.size, np.int64)
    made = np.zeros(lists.size, bool)
    n_made, open_, kth = 0, True, 0
    for i, (place, factor) in enumerate(zip(at.tolist(), factors.tolist())):
        # the k-th partial score is at most what the terms so far can give: until then it is not looked up
        if open_ and n_made >= k and to_come[i] < to_come[0] - to_come[i]:
            kth = int(np.partition(scores[made], n_made - k)[n_made - k])
        if open_ and to_come[i] < max(kth, floor):
            open_ = False
        docs = lists.docs[lists.bounds[place]:lists.bounds[place + 1]]
        gain = lists.impact[lists.bounds[place]:lists.bounds[place + 1]] * factor
        if open_:
            made[docs] = True
            n_made = int(np.count_nonzero(made))
        else:
            known = made[docs]
            docs, gain = docs[known], gain[known]
        scores[docs] += gain                      # a list names a document once
    found = np.flatnonzero(made & (scores >= max(1, floor)))
    if len(found) > k:
        least = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= least]
    return list(zip(scores[found].tolist(), found.tolist()))


def search_block(docs: DataFrame, items: list[tuple[int, str | None]], k: int) -> DataFrame | None:
    """(q, doc_id, score): each task's best documents for the given (q, text) items."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    wanted = []
    for q, text in items:
        numbers = [vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)]
        wanted.append((q, *np.unique(np.array(numbers, np.int32), return_counts=True)))
    if not vocabulary:
        return None
    indexed = stage(index(docs, spark.sparkContext.broadcast(vocabulary)), "lexical-index")
    n_docs, n_terms = indexed.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = frequencies(indexed, len(vocabulary))
    weights = np.array([weight(n_docs, d) for d in df.tolist()], np.int64)
    queries = []
    for q, terms, repeats in wanted:
        factors = weights[terms] * repeats
        use = (df[terms] > 0) & (factors > 0)
        terms, factors = terms[use], factors[use]
        rarest = np.lexsort((terms, df[terms]))
        queries.append((q, terms[rarest], factors[rarest]))
    shipped = spark.sparkContext.broadcast((queries, int(n_docs), int(n_terms)))

    def search(batches):
        queries, n_docs, n_terms = shipped.value
        best = [[] for _ in queries]              # the k best so far as a heap, least first
        order = 0

        def shard(frames):
            nonlocal order
            lists = Lists(pd.concat(frames, ignore_index=True), n_docs, n_terms)
            for heap, (_, terms, factors) in zip(best, queries):
                floor = heap[0][0] if len(heap) == k else 0
                for score, doc in best_of(lists, terms, factors, k, floor):
                    doc_id = lists.ids[doc]
                    missing = doc_id is None or doc_id != doc_id
                    order += 1
                    entry = (score, not missing, 0 if missing else -int(doc_id), -order)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)

        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += sum(map(len, batch["terms"])) // 4
            if postings > SHARD:
                shard(held)
                held, postings = [], 0
        if held and any(map(len, held)):
            shard(held)
        rows = [(q, str(-e[2]) if e[1] else None, e[0]) for (q, _, _), heap in zip(queries, best) for e in heap]
        yield pd.DataFrame(rows, columns=["q", "doc_id", "score"])

    found = indexed.mapInPandas(search, "q long, doc_id string, score long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    items = stage(items.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"), "lexical-items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(1, blocks))))
    found = []
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).select("q", "text").collect()
        part = search_block(docs, [tuple(r) for r in rows], k)
        if part is not None:
            found.append(part if blocks == 1 else stage(part, "lexical-best"))
    if not found:
        best = spark.createDataFrame([], "q long, doc_id long, score long")
    else:
        best = reduce(DataFrame.unionByName, found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # first within salts: one item's candidates come from every task
    best = best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))
    best = best.withColumn("place", place).filter(F.col("place") <= k)
    place = F.row_number().over(Window.partitionBy("q").orderBy(*order))
    best = best.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.join(items.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
