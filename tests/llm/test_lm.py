import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from botlens.llm import lm


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for b in "\t\n\x0b\x0c\r":
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_base(rows):
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update([*tokens(t), None])
    total, types = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        ts = [*tokens(t), None]
        out.append((i, held(i), len(ts), sum(count[w] > 0 for w in ts), total,
                    sum(math.log10((count[w] + 1) / (total + types + 1)) for w in ts)))
    return sorted(out, key=repr)


def corpus(n, seed=1):
    """Two grammars: nouns follow articles, verbs follow nouns."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "anv"]
    rows = []
    for i in range(n):
        words = [rng.choice(kinds[j % 3]) + ("." if j % 9 == 8 else "") for j in range(rng.randrange(3, 60))]
        if i % 10 == 0:
            words.append(f"rare{rng.randrange(40)}é")
        rows.append((i, " ".join(words).title()))
    return rows + [(None, rows[0][1]), (3, rows[3][1]), (n, None), (n + 1, ""), (n + 2, "x " * 50_000)]


@pytest.mark.parametrize("head", [1 << 18, 60])
def test_base_score_is_exact_and_the_model_beats_it(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "CLUSTERED", 120)
    rows = corpus(300)
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (repr(r[:5]), round(r[5], 6))
    mine = sorted((tuple(r)[:6] for r in got), key=key)
    want = sorted(brute_base(rows), key=key)
    for a, b in zip(mine, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
    out = [r for r in got if r.held_out and r.n_tokens > 3 and r.n_tokens < 100]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_model_is_a_distribution_over_next_words(spark, monkeypatch):
    """One-word texts of all types, one of each fixed class being unseen, and the empty text: the sum is at most one."""
    monkeypatch.setattr(lm, "CLUSTERED", 20)
    rng = random.Random(2)
    train = [(i, " ".join(rng.choices(["a", "b", "c.", "d,", "é", "f"], k=5))) for i in range(100)]
    rows = train + [(1000 + i, w) for i, w in enumerate(["a", "b", "c.", "d,", "é", "f", "new", "new.", "new,", "newé"])]
    # ids above 999 must not train: keep those that are held out
    ids = [i for i in range(1000, 4000) if held(i)]
    rows = train + [(ids[k], w) for k, (_, w) in enumerate(rows[100:])]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # P(w, end) <= P(w): the one-word texts together cannot exceed one
    assert 0 < sum(10 ** got[i].score for i, _ in rows[100:]) <= 1 + 1e-9


def test_exchange_finds_the_word_kinds(spark, monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 3)
    monkeypatch.setattr(lm, "BORDER", 3 + lm.FIXED)
    rows = [r for r in corpus(400) if r[1]]
    train = spark.createDataFrame(rows[:400], "doc_id long, text string")
    words = [f"{k}{i}".encode() for i in range(30) for k in "anv"]
    random.Random(3).shuffle(words)
    none = np.empty(0, np.int64)
    pairs = lm.word_pairs(lm.numbered(lm.training(train), words, none), len(words), len(words), none, none, len(words), 12_000)
    classes, moves = lm.exchange(pairs, rounds=12)
    by_kind = {k: Counter(int(c) for w, c in zip(words, classes) if w[:1] == k) for k in (b"a", b"n", b"v")}
    assert len({c.most_common(1)[0][0] for c in by_kind.values()}) == 3
    assert all(c.most_common(1)[0][1] >= 25 for c in by_kind.values())
    assert np.isclose(moves.sum(), sum(len(tokens(t)) + 1 for _, t in rows[:400]))


def test_empty_table_and_no_training_document(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = next(i for i in range(100) if held(i))
    r = lm.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


@pytest.mark.parametrize("head", [1 << 18, 60])
def test_words_beyond_the_first_are_clustered_too(spark, monkeypatch, head):
    """Whether workers hold them or know them by hash: the later words' classes tell what follows."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "CLUSTERED", 30)
    df = spark.createDataFrame(corpus(300), "doc_id long, text string").cache()

    def gain():
        out = [r for r in lm.score(df).collect() if r.held_out and 3 < r.n_tokens < 100]
        return sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)

    with_later = gain()
    monkeypatch.setattr(lm, "LEAST", 1 << 40)
    assert with_later > gain() + 0.1


def test_later_transitions_are_those_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "SLOT", 500)
    rows = [r for r in corpus(120) if r[1] and not held(r[0])][:100]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm.vocabulary(train).cache()
    words, n = lm.frequent(counts, 50)
    first = 20
    n_held, hashes, fixed = lm.later_words(counts, words, n, first)
    assert len(hashes) and n_held == len(words)
    n_words, none = len(words) + len(hashes), np.empty(0, np.int64)
    pairs = lm.word_pairs(lm.numbered(lm.training(train), words, hashes), n_held, n_words, fixed, none, first, 3000)
    assert pairs.blocks.count() > 5
    _, moves = lm.exchange(pairs, later=0)
    classes, after = lm.exchange(pairs)
    size = len(words) + len(hashes)
    assert lm.likelihood(after) > lm.likelihood(moves) and (classes[:size] < lm.CLASSES).mean() > 0.9
    want = np.zeros_like(after)
    for _, text in rows:
        row = [lm.BORDER]
        for w in map(str.encode, tokens(text)):
            at = int(lm.find_hashed([w], hashes)[0])
            row.append(classes[words.index(w)] if w in words else classes[len(words) + at] if at >= 0
                       else lm.CLASSES + lm.LAST[w[-1]])
        for a, b in zip(row, [*row[1:], lm.BORDER]):
            want[a, b] += 1
    assert np.array_equal(after, want)


def test_contexts_are_those_of_the_texts(spark, monkeypatch):
    """Whatever the blocks: counts of the classes around each word, and the choice of the words that lie in one block."""
    monkeypatch.setattr(lm, "SLOT", 300)
    rows = [r for r in corpus(60) if r[1]][:60]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    words, n = lm.frequent(lm.vocabulary(train).cache(), 1000)
    all_words, words = words[:90], words[:80]        # ten words are held, but not clustered
    first, rng, last_of = 10, np.random.default_rng(1), np.array([lm.LAST[w[-1]] for w in all_words])
    texts = lm.numbered(lm.training(train), all_words, np.empty(0, np.int64))
    pairs = lm.word_pairs(texts, 80, 90, last_of[first:80], last_of[80:], first, 2000)
    now = np.concatenate([rng.integers(0, lm.CLASSES, len(words)), np.arange(lm.CLASSES, lm.BORDER + 1)])
    last = rng.integers(1, 100, (lm.BORDER + 1, lm.BORDER + 1)).astype(float)
    found, moves, chosen = lm.contexts(pairs, now, last)
    want, steps = np.zeros((len(now), 2, lm.BORDER + 1)), np.zeros_like(last)
    number = {w: i for i, w in enumerate(words)}
    for _, text in rows:
        row = [number.get(w, len(words) + lm.LAST[w[-1]]) for w in map(str.encode, tokens(text))]
        row = [len(now) - 1, *row, len(now) - 1]
        for a, b in zip(row, row[1:]):
            want[a, 1, now[b]] += 1
            want[b, 0, now[a]] += 1
            steps[now[a], now[b]] += 1
    assert np.array_equal(found[:first], want[:first]) and np.array_equal(moves, steps)
    best = lm.best_class(want[first:len(words)], lm.log_share(last), np.log(last.sum(0)[:lm.CLASSES] + 1))
    got = now[first:len(words)].copy()
    for w, c in chosen:
        got[w - first] = c
    assert np.array_equal(got, best)


def test_score_is_the_model_s_probability(spark, monkeypatch):
    """The score of every text by brute force from the classes that exchange gave, words held or found by hash."""
    monkeypatch.setattr(lm, "HEAD", 60)
    monkeypatch.setattr(lm, "CLUSTERED", 20)
    seen, plain = {}, lm.exchange
    monkeypatch.setattr(lm, "exchange", lambda pairs: seen.setdefault("model", plain(pairs)))
    rows = corpus(200)
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes, moves = seen["model"]
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    docs = spark.createDataFrame([r for r in rows if not held(r[0])], "doc_id long, text string")
    counts = lm.vocabulary(docs).cache()
    assert {r.word: r.c for r in counts.collect()} == count
    words, n = lm.frequent(counts, 60)
    n_held, hashes, _ = lm.later_words(counts, words, n, 20)

    def number(w):
        if w in words[:n_held]:
            return int(classes[words.index(w)])
        at = int(lm.find_hashed([w], hashes)[0])
        return int(classes[n_held + at]) if at >= 0 else lm.CLASSES + int(lm.LAST[w[-1]])

    kind = {w: number(w.encode()) for w in {w for _, t in rows for w in tokens(t)}}
    mass = Counter()
    for w, c in count.items():
        mass[kind[w]] += c + (kind[w] >= lm.CLASSES)
    share = (moves.sum(0) + 1) / (moves.sum() + lm.BORDER + 1)
    step = (moves + lm.SMOOTH * share) / (moves.sum(1, keepdims=True) + lm.SMOOTH)
    want = []
    for i, t in rows:
        total, before = 0.0, lm.BORDER
        for w in tokens(t):
            k, c = kind[w], count[w]
            # one unseen type has a place in every fixed class
            emit = (c + 1) / (mass[k] + 1) if k >= lm.CLASSES else max(c, 1) / max(mass[k], 1)
            total, before = total + math.log10(step[before, k]) + math.log10(emit), k
        want.append((repr(i), total + math.log10(step[before, lm.BORDER])))
    for a, b in zip(sorted((repr(r.doc_id), r.score) for r in got), sorted(want), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-9)
