import random

import pytest
import xxhash

import corpus_pipeline
from botlens.llm import simhash


def brute_fp(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    for b in "\t\n\x0b\x0c\r":
        words = words.replace(b, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, k, d):
    fps = [brute_fp(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                label[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def run(spark, rows, k=4, d=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs, k, d).select(
        "doc_id", simhash.hex_fp("fp").alias("f"), "component_id").collect()
    return sorted(map(tuple, got), key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        if i % 3 and out:
            words = rng.choice(out).split(" ")
            if rng.random() < 0.7 and len(words) > 3:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 40, 200, 400]))]
        out.append(" ".join(words))
    return out


def test_matches_brute_force(spark):
    rows = list(enumerate(texts(150, 1)))
    rows += [(None, rows[0][1]), (None, "alone without an id here"), (3, rows[3][1]), (500, None), (501, ""),
             (502, " \t\n"), (503, "É à A b"), (504, "x " * 70000)]
    assert run(spark, rows) == brute_components(rows, 4, 4)


def test_dense_cells_are_dealt_by_longer_prefixes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 12_000)
    rows = list(enumerate(texts(120, 2)))
    assert run(spark, rows) == brute_components(rows, 4, 4)


def test_smaller_radius_empty_table_and_odd_distance(spark):
    rows = list(enumerate(texts(60, 3)))
    assert run(spark, rows, 2, 2) == brute_components(rows, 2, 2)
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def clustered(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = rng.choice(out) if out and rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randrange(4)):
            base ^= 1 << rng.randrange(64)
        out.append(base)
    return sorted(set(out))


def crowded(monkeypatch):
    """Fingerprints (signed too) of one cell of 12 bits that holds twice what it may; the tables deal() then makes."""
    fps = sorted({f & (1 << 52) - 1 | 0xABC << 52 for f in clustered(300, 4)})
    monkeypatch.setattr(simhash, "CELL", len(fps) * 1379 // 2)
    dealt, deal = [], simhash.deal

    def counted(*args):
        dealt.append(deal(*args))
        return dealt[-1]
    monkeypatch.setattr(simhash, "deal", counted)
    return fps, [f - (1 << 64) * (f >> 63) for f in fps], dealt


def cells(dealt):
    return [rows.select("cell").distinct().count() for rows in dealt]


def test_cells_slightly_over_the_limit_are_not_dealt_many_times(spark, monkeypatch):
    fps, signed, dealt = crowded(monkeypatch)
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4).collect()
    assert cells(dealt) == [79, 16]                  # by 12 bits more: 4096
    mask = (1 << 64) - 1
    assert roots_of(fps, [(r.a & mask, r.b & mask) for r in found]) == roots_of(fps, close_pairs(fps, 4))


def test_pipeline_stage_with_cells_over_the_limit(spark, monkeypatch):
    fps, signed, dealt = crowded(monkeypatch)
    monkeypatch.setattr(simhash, "fingerprints", lambda text, shingle: text.cast("long"))
    docs = spark.createDataFrame([(i, str(f)) for i, f in enumerate(signed)], "doc_id long, text string")
    left = corpus_pipeline.near_duplicates(spark, docs, None).collect()
    assert cells(dealt) == [79, 16]
    roots = set(roots_of(fps, close_pairs(fps, 4)).values())
    assert sorted(r.doc_id for r in left) == sorted(fps.index(f) for f in roots)


def close_pairs(fps, distance):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= distance]


def roots_of(fps, pairs):
    label = {f: f for f in fps}

    def find(f):
        while label[f] != f:
            f = label[f]
        return f
    for a, b in pairs:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("batch", [500, 20_000, 250_000])
def test_forest_of_a_cell_however_it_is_split(monkeypatch, batch):
    monkeypatch.setattr(simhash, "BATCH", batch)
    cell = 0xABC
    fps = sorted({f & (1 << 52) - 1 | (cell ^ flip) << 52 for f in clustered(250, 5) for flip in (0, 1, 0x900)}
                 | {f ^ 3 << 20 for f in clustered(5, 6)})
    got = simhash.ties(simhash.np.array(fps + fps[:9], "uint64"), cell, 12, 4).tolist()
    expected = [pair for pair in close_pairs(fps, 4) if meet(*pair, cell)]
    assert roots_of(fps, got) == roots_of(fps, expected)
    assert len(got) == sum(f != r for f, r in roots_of(fps, expected).items())


def meet(a, b, cell):
    """Whether two words share a variant (two flips each at most) whose top 12 bits are ``cell``."""
    used = [(f >> 52 ^ cell).bit_count() for f in (a, b)]
    return max(used) <= 2 and ((a ^ b) & (1 << 52) - 1).bit_count() <= 4 - sum(used)


def test_forest_of_the_longest_prefix():
    fps = [0b1, 0b10, 0b100, 0b11000, 0b111]
    got = simhash.ties(simhash.np.array(fps, "uint64"), 0, 64, 4).tolist()
    assert sorted(got) == [[0b10, 0b1], [0b100, 0b1], [0b11000, 0b1]]
