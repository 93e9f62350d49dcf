import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from botlens.llm import lexsearch

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(ASCII))


def brute(docs, items, k):
    texts = [(doc, terms(text)) for doc, text in docs]
    n_docs, n_terms = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    df = Counter(t for _, ts in texts for t in set(ts))
    out = []
    for item, text in items:
        scored = []
        for doc, ts in texts:
            tf, score = Counter(ts), 0
            for t in terms(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + 75 * len(ts) * n_docs // n_terms
                    score += w * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, place, doc, -s) for place, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: f"W{int(rng.paretovariate(0.7)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)]           # ties
    docs += [(3, docs[3][1]), (None, docs[3][1]), (None, None), (5000, ""), (5001, "... !"), (5002, "É_é w1-W2 ß\x00w3"),
             (5003, "w1 " * 30_000)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(25)]
    items += [(3, docs[3][1]), (3, "w1 w1 w1 W2"), (None, "é ß"), (90, None), (91, "?"), (92, "nowhere to be found"), (93, "w1")]
    return docs, items


def run(spark, docs, items, k=10):
    got = lexsearch.rank(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS terms", "3 AS salt"),
                         spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS q", "2 AS rank"), k)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("shard, block, k", [(2_000_000, 4 << 20, 10), (60, 150, 10), (500, 4 << 20, 1), (10, 4 << 20, 3)])
def test_matches_brute_force(spark, monkeypatch, shard, block, k):
    monkeypatch.setattr(lexsearch, "SHARD", shard)
    monkeypatch.setattr(lexsearch, "BLOCK", block)
    docs, items = corpus(200, 6)
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = corpus(20, 7)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == []
    assert run(spark, [(1, None), (2, "")], items) == []


def shard(n, seed, rare):
    """Lists of n documents over a few common terms and one rare one, and the terms rarest first."""
    rng = np.random.default_rng(seed)
    rows = []
    for doc in range(n):
        own = np.flatnonzero(rng.random(8) < 0.8).astype(np.int32)
        own = np.append(own, np.int32(8)) if doc % rare == 0 else own
        rows.append((str(doc), 50, own.tobytes(), rng.integers(1, 6, len(own)).astype(np.int32).tobytes()))
    lists = lexsearch.Lists(pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tfs"]), n, 50 * n)
    return lists, np.array([8, 0, 1, 2, 3, 4, 5, 6, 7])


def test_accumulators_are_limited_and_scores_exact():
    lists, order = shard(4_000, 2, 100)
    factors = np.array([9000, *[20] * 8])
    whole = np.zeros(lists.size, np.int64)
    for t, f in zip(order, factors):
        whole[lists.docs[lists.bounds[t]:lists.bounds[t + 1]]] += f * lists.impact[lists.bounds[t]:lists.bounds[t + 1]]
    got = lexsearch.best_of(lists, order, factors, 10)
    least = np.sort(whole)[-10]
    assert sorted(got) == sorted((int(s), i) for i, s in enumerate(whole.tolist()) if s >= least)

    # the common terms come after the stop: no document without the rare term gets an accumulator
    held = []
    spy = type("Spy", (), {"__getattr__": lambda self, name: getattr(lists, name)})()
    real = np.count_nonzero
    lexsearch.np.count_nonzero, undo = (lambda x: held.append(real(x)) or real(x)), real
    try:
        lexsearch.best_of(spy, order, factors, 10)
    finally:
        lexsearch.np.count_nonzero = undo
    assert held == [40]


def test_a_floor_leaves_out_only_lower_scores():
    lists, order = shard(500, 3, 7)
    factors = np.array([30, *range(10, 18)])
    every = lexsearch.best_of(lists, order, factors, 500)
    floor = sorted(every)[-20][0]
    assert sorted(lexsearch.best_of(lists, order, factors, 500, floor)) == [x for x in sorted(every) if x[0] >= floor]


def test_terms():
    for text in ("", "Aß é_b-c9 \x00x\x7fy", "ÀÉ ABC d", "a\ud800b"):
        assert [t.decode("utf-8", "surrogatepass") for t in lexsearch.terms_of(text)] == terms(text)
