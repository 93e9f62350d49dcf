import random
from collections import defaultdict

import numpy as np
import pytest

from botlens.llm import linededup

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, min_chars):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    seen = defaultdict(set)
    for at, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            seen[key(line)].add(at)
    gone = {k for k, docs in seen.items() if len(k) >= min_chars and len(docs) >= least}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        dropped = [(i, len(seen[key(x)])) for i, x in enumerate(lines) if key(x) in gone]
        out.append((doc, len(lines), len(dropped), dropped, "\n".join(kept)))
    return sorted(out, key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    shared = [f"Shared line {i}" for i in range(40)] + ["É", " x", "  ", "", "SHARED LINE 1\r", "\tshared line 2 "]
    rows = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.4 else f"own {rng.random()}" for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join(lines + lines[:1])))
    return rows + [(None, None), (None, "Shared line 3"), (7, ""), (7, "shared line 3\n\n\nx"), (900, "\n" * 50),
                   (901, "É\né\nshared LINE 4"), (902, "long " * 60_000 + "\nshared line 5")]


def run(spark, rows, least=10, min_chars=1, **columns):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in columns.items():
        docs = docs.selectExpr("*", f"{value} AS `{name}`")
    got = linededup.dedup(docs, least, min_chars).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, [(d.line, d.documents) for d in r.dropped], r.text) for r in got), key=repr)


@pytest.mark.parametrize("least, min_chars", [(10, 1), (3, 1), (2, 8), (1, 1), (10, 0)])
def test_matches_brute_force(spark, least, min_chars):
    rows = corpus(150, 3)
    assert run(spark, rows, least, min_chars) == brute(rows, least, min_chars)


def test_waves_and_shards_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD", 7)
    monkeypatch.setattr(linededup, "HELD", 20)
    monkeypatch.setattr(linededup, "WAVE", 400)
    rows = corpus(80, 4)
    assert run(spark, rows, 3) == brute(rows, 3, 1)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = corpus(30, 5)
    assert run(spark, rows, 3, h1="1", row="2", shard="'a'", known="3") == brute(rows, 3, 1)


def test_nothing_shared(spark):
    rows = [(i, f"line {i}") for i in range(20)]
    assert run(spark, rows) == brute(rows, 10, 1)


def test_index_is_minimal_and_exact():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 5_000):
        h1, h2 = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
        counts = rng.integers(1, 100_000, n)
        index = linededup.LineIndex.load(linededup.LineIndex.build(h1, h2, counts).dump())
        assert len(index.prints) + len(index.rest1) == n
        assert len(index.words) * 64 <= 4 * n + 64 * linededup.LEVELS
        assert (index.probe(h1, h2) == np.minimum(counts, linededup.COUNT_MAX)).all()
        assert not index.probe(h1, h2 ^ np.uint64(1)).any()
        assert not index.probe(rng.integers(0, 1 << 64, 500, dtype=np.uint64), rng.integers(0, 1 << 64, 500, dtype=np.uint64)).any()


def test_index_tells_equal_first_halves_apart():
    h1 = np.array([5, 5, 5, 9], np.uint64)
    h2 = np.array([1, 2, 3, 1], np.uint64)
    index = linededup.LineIndex.build(h1, h2, np.array([10, 20, 30, 40]))
    assert index.probe(h1, h2).tolist() == [10, 20, 30, 40]
    assert index.probe(h1, h2 + np.uint64(7)).tolist() == [0, 0, 0, 0]
