import hashlib
import random

import numpy as np
import pytest

from botlens.llm import grams, substrings


def words(text):
    for b in "\t\n\x0b\x0c\r":
        text = (text or "").replace(b, " ")
    return [w for w in (text or "").split(" ") if w]


def brute(rows, size):
    first = {}
    rank = lambda i: (i is None, i or 0)
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - size + 1):
            key = tuple(w[s:s + size])
            first[key] = min(first.get(key, ((True, 1 << 63), 0)), (rank(i), s))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for s in range(len(w) - size + 1) if first[tuple(w[s:s + size])] < (rank(i), s) for p in range(s, s + size)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    fresh = lambda k, m=500: " ".join(f"w{rng.randrange(m)}" for _ in range(k))
    shared = [fresh(rng.choice([19, 20, 21, 45])) for _ in range(6)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1]
            if rng.random() < 0.5:
                w = text.split(" ")
                w[rng.randrange(len(w))] = "changed"
                text = " ".join(w)
        else:
            text = " ".join([fresh(rng.randrange(60)), rng.choice(shared), fresh(rng.randrange(30))] * rng.choice([1, 1, 2]))
        rows.append((i, text))
    rng.shuffle(rows)
    return rows


def run(spark, rows, size=20, phrase=10):
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), size, phrase).collect()
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr)


@pytest.mark.parametrize("shard, slot, size, phrase", [(4 << 20, 16 << 20, 20, 10), (2000, 900, 20, 10), (3000, 5000, 7, 3)])
def test_matches_brute_force(spark, monkeypatch, shard, slot, size, phrase):
    monkeypatch.setattr(substrings, "SHARD", shard)
    monkeypatch.setattr(substrings, "SLOT", slot)
    rows = corpus(120, 7)
    rows += [(None, rows[0][1]), (None, rows[1][1]), (5, next(t for i, t in rows if i == 5)), (900, None), (901, ""),
             (902, " \t"), (903, "same " * 400), (904, "É à\x0bb\xa0c " * 30)]
    assert run(spark, rows, size, phrase) == brute(rows, size)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_word_hashes_tell_words_apart():
    rng = np.random.default_rng(2)
    for text in ("", " ", "a", " a  b\n", "é à\x0b b\xa0c d", "x" * 70 + " y", "aa a aaa \x00 \x00\x00"):
        found = grams.word_hashes(text.encode())
        assert len(found) == len(words(text))
        assert len(set(found.tolist())) == len(set(words(text)))
    many = {"".join(chr(97 + c) for c in rng.integers(0, 4, n)) for n in rng.integers(1, 12, 40_000)}
    assert len(set(grams.word_hashes(" ".join(many).encode()).tolist())) == len(many)
    a, b = grams.word_hashes(b"one two one"), grams.word_hashes("éé  one\ttwo".encode())
    assert a[0] == a[2] == b[1] and a[1] == b[2]


def test_window_selection_and_rolling_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 11, 12, 300):
        hashes = rng.integers(0, 40, n).astype(np.uint64)
        for span in (1, 2, 5, 11):
            want = sorted({i + int(j) for i in range(n - span + 1)
                           for j in np.flatnonzero(hashes[i:i + span] == hashes[i:i + span].min())})
            assert grams.least_in_windows(hashes, span).tolist() == want
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    twice = np.concatenate([h, h[::-1], h])
    r = grams.rolling(twice, 20)
    assert (r[:381] == r[800:]).all() and len(np.unique(r)) == len(np.unique(r[:800]))
