"""Brown class-based bigram model, trained and applied over whole texts.

P(text) is the product over its tokens (words and one end) of the class
transition P(c | class before) and the word emission P(w | c).  The classes
are found by exchange: the texts are written as numbers of words once, and one pass
over those that train counts which words stand before and after each word seen
LEAST times or more, in blocks that stay in Spark.  Every round counts the classes there and moves half of the words to the
class that gives the corpus the highest likelihood: at first the CLUSTERED most
frequent words only, then all.  Tasks choose for a word whose contexts lie in one
block.  The contexts of the most frequent words are split over the blocks; their
class counts are added up by Spark and they move on the driver, which also gets
the class transitions and the classes that change.  Rarer words, seen or not,
belong to one of four fixed classes by their last character; their counts are
exact and the vocabulary has no limit.

Workers hold the HEAD most frequent words in memory.  The rarer ones are looked
up by a join on the word, where no key is frequent.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlens.session import stage

from .common import encode, frequent, words_lower
from .grams import word_hashes
from .substrings import packed

CLASSES = 40              # classes found by clustering
CLUSTERED = 4096          # words that are clustered first, among themselves
LEAST = 5                 # times a word must be seen to be clustered after them
LATER = 4                 # exchange rounds of all words, half of them moving in each
SLOT = 1 << 19            # contexts that a slot takes, about
HEAD = 1 << 18            # words whose counts every worker holds
TYPES = 1 << 18           # words that a task counts at once
ROUNDS = 8                # exchange rounds of the first words, half of them moving in each
PARTS = 16                # pieces that sums are added up in
SMOOTH = 50.0             # weight of the class's overall share in a transition
CHUNK = 1 << 20           # pairs counted at once in a task
FIXED = 4                 # classes of all other words: . ! ? / , ; : / ASCII / other last characters
# class numbers: clustered 0..CLASSES-1, then the fixed ones, then the text border
BORDER = CLASSES + FIXED
LAST = np.full(256, 2, np.int64)
LAST[[ord(c) for c in ".!?"]] = 0
LAST[[ord(c) for c in ",;:"]] = 1
LAST[128:] = 3


def last_class(word) -> F.Column:
    """Number (0 to FIXED - 1) of the fixed class of a word, as LAST gives it for its last byte."""
    last = F.right(word, F.lit(1))
    return (F.when(last.isin(*".!?"), 0).when(last.isin(*",;:"), 1)
            .when(F.octet_length(last) > 1, 3).otherwise(2))


class Ids(dict):
    """Word -> number; words that are not held give -1 - (their fixed class)."""

    def __missing__(self, word):
        return -1 - int(LAST[word[-1]])


def training(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text); a null doc_id is not held out."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text")


def vocabulary(train: DataFrame) -> DataFrame:
    """(word, c) of every word of the training texts, ends not counted."""
    def run(batches):
        found = Counter()

        def rows():
            return pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in found], "c": list(found.values())})

        for batch in batches:
            for text in batch["text"]:
                found.update(words_lower(text))
                if len(found) >= TYPES:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    return train.select("text").mapInPandas(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def find_hashed(words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """Places of words among sorted hashes, -1 for others."""
    if not words or not len(hashes):
        return np.full(len(words), -1)
    own = word_hashes(b" ".join(words)).view(np.int64)
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    return np.where(hashes[at] == own, at, -1)


BLOCK = "size int, runs int, a binary, lengths binary, b binary, n binary"


def narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest bytes each that hold the largest."""
    return packed(values.astype(np.min_scalar_type(int(values.max(initial=0)))))


def widened(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n if n else 1}").astype(np.int64)


def put_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple:
    """A row of BLOCK columns: a by its runs, and the others, in few bytes."""
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return (len(a), len(starts), narrow(a[starts]), narrow(np.diff(np.r_[starts, len(a)])), narrow(b), narrow(n))


def get_pairs(frame: pd.DataFrame):
    """(a, b, n) of each row of BLOCK columns."""
    for size, runs, a, lengths, b, n in frame[["size", "runs", "a", "lengths", "b", "n"]].itertuples(index=False):
        yield np.repeat(widened(a, runs), widened(lengths, runs)), widened(b, size), widened(n, size)


def summed(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int):
    """The distinct pairs (a, b), b < size, sorted, with the sums of n."""
    code = a * size + b
    order = np.argsort(code)
    code, n = code[order], n[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[starts] // size, code[starts] % size, np.add.reduceat(n, starts)


class Pairs(NamedTuple):
    """How often which number stands before (side 0) or after (1) which word.

    Numbers: ``known`` words, the ``first`` of them being the most frequent, then
    the fixed classes and the border.  ``blocks`` holds (number * 2 + side, other,
    n), sorted and put by put_pairs.  The contexts of the first words and of the
    numbers after the words are dealt by the other number, those of any other word
    lie in one block.  ``rows`` (shared) has the row of each number in what
    contexts() counts.
    """
    blocks: DataFrame
    first: int
    known: int
    rows: Broadcast


def numbered(docs: DataFrame, words: list[bytes], hashes: np.ndarray) -> DataFrame:
    """(row, doc_id, held_out, low, high, rare): each document's words as numbers (two bytes and the rest), those
    that are not among ``words`` also as texts.  Numbers: the words held, the hashed ones, the fixed classes."""
    shared = docs.sparkSession.sparkContext.broadcast((words, hashes))

    def run(batches):
        words, hashes = shared.value
        ids = Ids({w: i for i, w in enumerate(words)})
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = words_lower(text)
                row = np.fromiter(map(ids.__getitem__, found), np.int64, len(found))
                rare = np.flatnonzero(row < 0)
                names = [found[i] for i in rare.tolist()]
                at = find_hashed(names, hashes)
                row[rare] = len(words) + np.where(at >= 0, at, len(hashes) - 1 - row[rare])
                out.append((packed((row & 0xFFFF).astype(np.uint16)), narrow(row >> 16),
                            b" ".join(names).decode("utf-8", "surrogatepass")))
            table = pd.DataFrame(out, columns=["low", "high", "rare"])
            yield pd.concat([batch[["row"]].reset_index(drop=True), batch["doc_id"].astype("Int64").reset_index(drop=True),
                             batch[["held_out"]].reset_index(drop=True), table], axis=1)

    return stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInPandas(
        run, "row long, doc_id long, held_out boolean, low binary, high binary, rare string"), "numbered")


def numbers(low: bytes, high: bytes) -> np.ndarray:
    low = np.frombuffer(low, np.uint16).astype(np.int64)
    return low | widened(high, len(low)) << 16


def word_pairs(train: DataFrame, n_held: int, n_words: int, fixed: np.ndarray, own: np.ndarray, first: int,
               tokens: int) -> Pairs:
    """Pairs of the numbered words: all but those held from ``n_held`` on, ``own`` being the fixed classes of these.

    ``n_words`` are all, and ``fixed`` has the fixed classes of those after the first.
    """
    known = n_words - len(own)
    size = known + FIXED + 1
    slots = max(12, 2 * tokens // SLOT)
    number_of = np.concatenate([np.arange(n_held), known + own, np.arange(n_held, size)]).astype(np.int32)
    shared = train.sparkSession.sparkContext.broadcast(number_of)

    def run(batches):
        number_of = shared.value
        held, n = [], 0

        def dealt():
            code, count = np.unique(np.concatenate(held), return_counts=True)
            a, b = code // size, code % size
            word = np.flatnonzero(b < known)
            # each pair stands with the number before it and, if a word comes after, with that one
            number, other = np.concatenate([a * 2 + 1, b[word] * 2]), np.concatenate([b, a[word]])
            count = np.concatenate([count, count[word]])
            slot = number // 2
            slot += np.where((slot < first) | (slot >= known), other, 0)
            slot %= slots
            order = np.argsort(slot.astype(np.min_scalar_type(slots)), kind="stable")
            number, other, count, slot = number[order], other[order], count[order], slot[order]
            found, starts = np.unique(slot, return_index=True)
            return pd.DataFrame([(int(s), *put_pairs(x, y, z)) for s, x, y, z in zip(
                found, np.split(number, starts[1:]), np.split(other, starts[1:]), np.split(count, starts[1:]))],
                columns=["slot", "size", "runs", "a", "lengths", "b", "n"])

        for batch in batches:
            for low, high in zip(batch["low"], batch["high"]):
                row = np.full(len(low) // 2 + 2, size - 1)
                row[1:-1] = number_of[numbers(low, high)]
                held.append(row[:-1] * size + row[1:])
                n += len(row)
                if n >= CHUNK:
                    yield dealt()
                    held, n = [], 0
        if n:
            yield dealt()

    def merge(pdf):
        parts = map(np.concatenate, zip(*get_pairs(pdf)))
        return pd.DataFrame([put_pairs(*summed(*parts, size))], columns=["size", "runs", "a", "lengths", "b", "n"])

    blocks = stage(train.select("low", "high").mapInPandas(run, f"slot long, {BLOCK}")
                   .groupBy("slot").applyInPandas(merge, BLOCK), "word-pairs")
    rows = np.concatenate([np.arange(first), first + fixed.astype(np.int64), first + np.arange(FIXED + 1)]).astype(np.int32)
    return Pairs(blocks, first, known, train.sparkSession.sparkContext.broadcast(rows))


def first_pairs(pairs: Pairs) -> Pairs:
    """The pairs as they are with all later words in their fixed classes: few, for the rounds of the first words."""
    rows, first = pairs.rows, pairs.first
    size = first + FIXED + 1

    def run(batches):
        held, n = [], 0

        def block():
            return pd.DataFrame([put_pairs(*summed(*map(np.concatenate, zip(*held)), size))],
                                columns=["size", "runs", "a", "lengths", "b", "n"])

        for batch in batches:
            for a, b, count in get_pairs(batch):
                row_of = rows.value
                number, side = row_of[a // 2].astype(np.int64), a % 2
                kept = (side == 1) | (number < first)
                held.append(summed((number * 2 + side)[kept], row_of[b].astype(np.int64)[kept], count[kept], size)
                            if kept.any() else (a[:0], b[:0], count[:0]))
                n += len(held[-1][0])
                if n >= CHUNK:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    blocks = stage(pairs.blocks.mapInPandas(run, BLOCK), "first-pairs")
    return Pairs(blocks, first, first, blocks.sparkSession.sparkContext.broadcast(np.arange(size, dtype=np.int32)))


def contexts(pairs: Pairs, now: np.ndarray, moves: np.ndarray | None = None):
    """(found, moves, chosen) under the classes ``now`` of all numbers.

    found: [row, side, class] counts, a row for each of the first words, each
    fixed class with the later words in it, and the border: at most
    (CLUSTERED + 5) * 2 * (CLASSES + 5) numbers.  moves: [class before, class]
    counts.  chosen, if transition counts are given: (words, classes) of the later
    words that go to another class by these.
    """
    kinds, first, known = BORDER + 1, pairs.first, pairs.known
    n_rows = pairs.first + FIXED + 1
    cells = n_rows * 2 * kinds
    into = None if moves is None else log_share(moves)
    cost = None if moves is None else np.log(moves.sum(0)[:CLASSES] + 1)
    shared, rows = pairs.blocks.sparkSession.sparkContext.broadcast((now.astype(np.int16), into, cost)), pairs.rows

    def run(batches):
        (now, into, cost), row_of = shared.value, rows.value
        sums = np.zeros(cells + kinds * kinds)
        for batch in batches:
            for a, b, n in get_pairs(batch):
                number, side, c = a // 2, a % 2, now[b].astype(np.int64)
                sums[:cells] += np.bincount((row_of[number] * 2 + side) * kinds + c, n, cells)
                after = side == 1
                sums[cells:] += np.bincount(now[number[after]].astype(np.int64) * kinds + c[after], n[after], kinds * kinds)
                part = slice(*np.searchsorted(number, [first, known]))
                if into is None or part.start == part.stop:
                    continue
                own, at = np.unique(number[part], return_inverse=True)
                found = np.bincount((at * 2 + side[part]) * kinds + c[part], n[part], len(own) * 2 * kinds)
                best = best_class(found.reshape(-1, 2, kinds), into, cost)
                own, best = own[best != now[own]], best[best != now[own]]
                yield pd.DataFrame({"part": [-1], "sums": [None], "words": [packed(own)], "classes": [packed(best.astype(np.int16))]})
        split = np.array_split(sums, PARTS)
        yield pd.DataFrame({"part": range(PARTS), "sums": map(packed, split), "words": None, "classes": None})

    def add_up(key, pdf):
        return pd.DataFrame({"part": [int(key[0])], "sums": [packed(np.sum([np.frombuffer(x) for x in pdf["sums"]], 0))]})

    out = pairs.blocks.mapInPandas(run, "part int, sums binary, words binary, classes binary")
    chosen = []
    if moves is not None:
        out = stage(out, "contexts")
        chosen = [(np.frombuffer(r.words, np.int64), np.frombuffer(r.classes, np.int16))
                  for r in out.filter("part < 0").select("words", "classes").collect()]
    sums = out.filter("part >= 0").groupBy("part").applyInPandas(add_up, "part int, sums binary").collect()
    shared.unpersist()
    total = np.zeros(cells + kinds * kinds)
    if sums:
        total = np.concatenate([np.frombuffer(r.sums) for r in sorted(sums, key=lambda r: r.part)])
    return total[:cells].reshape(n_rows, 2, kinds), total[cells:].reshape(kinds, kinds), chosen


def log_share(moves: np.ndarray) -> np.ndarray:
    """[class before, class] log shares of the transitions."""
    return np.log((moves + 0.5) / (moves.sum(1, keepdims=True) + 0.5 * (BORDER + 1)))


def best_class(found: np.ndarray, into: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The class of highest likelihood for words with these [word, side, class] contexts."""
    gain = (found[:, 0] @ into + found[:, 1] @ into.T)[:, :CLASSES]
    return (gain - found[:, 0].sum(1)[:, None] * cost).argmax(1)


def likelihood(moves: np.ndarray) -> float:
    """Log likelihood of the corpus up to the words' own entropy, which no class changes."""
    log = lambda x: x * np.log(np.maximum(x, 1))
    return float(log(moves).sum() - log(moves.sum(0)).sum() - log(moves.sum(1)).sum())


def first_classes(pairs: Pairs) -> np.ndarray:
    """Start of the exchange: the first words grouped by the most frequent words around them (k-means, fixed seeds)."""
    fixed = np.arange(CLASSES, BORDER + 1)
    if not pairs.first:
        return fixed
    near = np.concatenate([np.minimum(np.arange(pairs.first), CLASSES - 1), fixed])
    around = contexts(pairs, near[pairs.rows.value])[0][:pairs.first]
    rows = np.sqrt(around / np.maximum(around.sum(2, keepdims=True), 1)).reshape(pairs.first, -1)
    seeds, far = [0], np.full(pairs.first, np.inf)
    while len(seeds) < min(CLASSES, pairs.first):     # the word farthest from all seeds so far
        far = np.minimum(far, ((rows - rows[seeds[-1]]) ** 2).sum(1))
        seeds.append(int(far.argmax()))
    centres = rows[seeds]
    for _ in range(10):
        classes = ((centres ** 2).sum(1) - 2 * rows @ centres.T).argmin(1)
        centres = np.stack([rows[classes == k].mean(0) if (classes == k).any() else centres[k]
                            for k in range(len(centres))])
    return np.concatenate([classes, fixed])


def exchange(pairs: Pairs, rounds: int = ROUNDS, later: int = LATER) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all numbers, and the transition counts.

    In the first ``rounds`` the first words move, the others being in their fixed
    classes; in the ``later`` ones all words do, the first time only those that
    have not yet.  Half of the words move at once, and what does not raise the
    likelihood is not kept.
    """
    few, first = first_pairs(pairs), pairs.first
    best = (-np.inf, first_classes(few), None)
    for part, turns in ((few, rounds), (pairs, later if pairs.known > first else -1)):
        now, last = best[1:]
        all_move = part is pairs
        if all_move:                                  # the classes of all numbers from here on
            now = now[pairs.rows.value]
            best = (best[0], now, last)
        for turn in range(turns + 1):
            found, moves, chosen = contexts(part, now, last if all_move else None)
            value, last = likelihood(moves), moves
            if value > best[0]:
                best = (value, now, moves)
            elif turn > 1:
                break
            if turn == turns:
                break
            now = now.copy()
            for words, classes in chosen:
                half = (words % 2 == turn % 2) | (turn == 0)
                now[words[half]] = classes[half]
            if first and not (all_move and turn == 0):
                half = np.arange(first) % 2 == turn % 2
                now[:first][half] = best_class(found[:first], log_share(moves), np.log(moves.sum(0)[:CLASSES] + 1))[half]
    return best[1].astype(np.int64), best[2]


def later_words(counts: DataFrame, held: list[bytes], held_counts: np.ndarray, first: int):
    """(n_held, hashes, fixed) of the words seen LEAST times or more: how many are held, the sorted hashes of the
    others, and the fixed classes of all after the ``first``: held ones, then by hash."""
    n_held = max(first, int((held_counts >= LEAST).sum()))
    fixed = np.array([LAST[w[-1]] for w in held[first:n_held]], np.int8)
    others = counts.filter(F.col("c") >= LEAST)
    if held:
        others = others.filter(F.col("c") < int(held_counts[-1]))

    def run(batches):
        for batch in batches:
            words = [encode(w) for w in batch["word"]]
            yield pd.DataFrame({"h": [packed(word_hashes(b" ".join(words)).view(np.int64))],
                                "k": [packed(np.array([LAST[w[-1]] for w in words], np.int8))]})

    rows = others.select("word").mapInPandas(run, "h binary, k binary").collect()
    hashes = np.frombuffer(b"".join(r.h for r in rows), np.int64)
    hashes, at = np.unique(hashes, return_index=True)
    return n_held, hashes, np.concatenate([fixed, np.frombuffer(b"".join(r.k for r in rows), np.int8)[at]])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and empty texts are the end alone.  Rows that repeat are scored, and if
    they train counted, each; an empty table gives an empty result, and without
    a training document every probability is one type's of one.
    """
    rows = training(docs)
    train = rows.filter("not held_out")
    counts = stage(vocabulary(train), "vocabulary")
    ends = train.count()
    held, held_counts = frequent(counts, HEAD)
    clustered = min(CLUSTERED, len(held))
    types, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    total, n_types = tokens + ends, types + (ends > 0)
    n_held, hashes, later = later_words(counts, held, held_counts, clustered)
    own = np.array([LAST[w[-1]] for w in held], np.int64)
    texts = numbered(rows, held, hashes)
    n_words = len(held) + len(hashes)
    classes, moves = exchange(word_pairs(texts.filter("not held_out"), n_held, n_words, later, own[n_held:], clustered, tokens))
    # emission totals of the fixed classes: all words but the clustered ones, and one unseen type
    rest = {r.k: r.v for r in counts.groupBy(last_class(F.col("word")).alias("k")).agg(F.count("*").alias("v")).collect()}
    fixed_v = np.array([rest.get(k, 0) for k in range(FIXED)], float) + 1
    np.subtract.at(fixed_v, np.concatenate([own[:clustered], later.astype(np.int64)]), 1)
    per_class = moves.sum(0)                             # tokens of each class
    fixed_total = per_class[CLASSES:BORDER] + fixed_v

    share = (moves.sum(0) + 1) / (moves.sum() + BORDER + 1)
    step = np.log10((moves + SMOOTH * share) / (moves.sum(1, keepdims=True) + SMOOTH))
    class_of = np.concatenate([classes[:n_held], CLASSES + own[n_held:], classes[n_held:-1]]).astype(np.int8)
    kept = class_of[:len(held)]
    totals = np.concatenate([np.maximum(per_class[:CLASSES], 1), fixed_total])
    emit = np.log10((held_counts + (kept >= CLASSES)) / totals[kept])
    floor = np.log10(total + n_types + 1)
    base = np.log10(held_counts + 1) - floor
    end = float(np.log10(ends + 1) - floor)
    shared = docs.sparkSession.sparkContext.broadcast((class_of, emit, base, step, BORDER))

    def run(batches):
        class_of, emit, base, step, border = shared.value
        for batch in batches:
            out = []
            for low, high, names in zip(batch["low"], batch["high"], batch["rare"]):
                row = numbers(low, high)
                c = np.concatenate([[border], class_of[row], [border]])
                rare = row >= len(emit)
                left = Counter(zip(names.split(" ") if names else (), c[1:-1][rare].tolist()))
                row = row[~rare]
                out.append((len(rare) + 1, len(row) + 1, float(base[row].sum()) + end,
                            float(emit[row].sum() + step[c[:-1], c[1:]].sum()), " ".join([w for w, _ in left]),
                            np.array([k for _, k in left], np.int32), np.array(list(left.values()), np.int64)))
            table = pd.DataFrame(out, columns=["n_tokens", "held", "base_part", "part", "rare", "k", "n"])
            yield pd.concat([batch[["row"]].reset_index(drop=True), batch["doc_id"].astype("Int64").reset_index(drop=True),
                             batch[["held_out"]].reset_index(drop=True), table], axis=1)

    parts = stage(texts.mapInPandas(
        run, "row long, doc_id long, held_out boolean, n_tokens long, held long, base_part double, part double, "
             "rare string, k array<int>, n array<long>"), "scores")
    emission = F.element_at(F.array(*[F.lit(float(np.log10(t))) for t in totals]), F.col("k") + 1)
    c = F.coalesce("c", F.lit(0))
    extra = F.when(F.col("k") < CLASSES, F.when(c == 0, 1).otherwise(0)).otherwise(1)
    each = F.arrays_zip(F.split("rare", " ").alias("word"), "k", "n")
    rare = (parts.filter("rare != ''").select("row", F.explode(each).alias("r")).select("row", "r.word", "r.k", "r.n")
            .join(counts, "word", "left").groupBy("row").agg(
                F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
                F.sum(F.col("n") * (F.log10(c + 1) - floor)).alias("base_rest"),
                F.sum(F.col("n") * (F.log10(c + extra) - emission)).alias("rest")))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return parts.drop("rare", "k", "n").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        # the end is known once a document has trained
        (F.col("held") - F.lit(int(ends == 0)) + zero("known")).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_part") + zero("base_rest")).alias("base_score"), (F.col("part") + zero("rest")).alias("score"))
