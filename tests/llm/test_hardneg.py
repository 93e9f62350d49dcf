import itertools
import math

import numpy as np
import pytest

from botlens.llm import hardneg


def brute(rows, every=50, positives=5, negatives=3):
    use = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
           if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max((len(v) for _, _, v in use), default=0)
    use = [(i, lab, v + [0] * (size - len(v))) for i, lab, v in use]
    out = []
    for at, (i, lab, v) in enumerate(use):
        if i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for n, (j, other, w) in enumerate(use) if n != at]
        same = sorted(((-s, j) for s, j, other in scored if other == lab))[:positives]
        for s, j in same:
            fit = sorted((-t, h) for t, h, other in scored if other != lab and 50 * -s <= 100 * t <= 95 * -s)
            out += [(i, j, place, h, -s, -t) for place, (t, h) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def table(n, size, seed, spread=0.15):
    """Clusters of vectors; each label holds several clusters, each cluster several labels."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + spread * rng.normal(size=size)
        rows.append((i, int(rng.integers(4)), [float(np.float32(x)) for x in v / np.linalg.norm(v)]))
    same = rows[0][2]
    rows += [(n + i, 1, same) for i in range(60)]                                # one vector many times
    rows += [rows[50], rows[50], (100, 2, same)]                                 # repeated rows, a repeated id
    rows += [(n + 100, None, same), (n + 101, 1, None), (None, 1, same), (n + 102, 1, [None] * size),
             (n + 103, 2, [float("nan")] * size), (n + 104, 3, [float("inf")] + same[1:]), (n + 150, 3, []),
             (n + 200, 2, same[:3]), (n + 250, 9, same)]
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr(
        "*", "1 AS id", "2 AS vector", "3 AS key", "4 AS block")
    return sorted(map(tuple, hardneg.mine(df, **options).collect()))


@pytest.mark.parametrize("block, chunk, wave", [(1024, 512, 16 << 20), (16, 5, 16 << 20), (32, 4, 6000)])
def test_matches_brute_force(spark, monkeypatch, block, chunk, wave):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "CHUNK", chunk)
    monkeypatch.setattr(hardneg, "WAVE", wave)
    rows = table(500, 8, 1)
    assert run(spark, rows, every=25) == brute(rows, every=25)


def times(rows, factor):
    return [(i, lab, [float(np.float32(factor * x)) for x in v] if v and v[0] is not None else v) for i, lab, v in rows]


def test_wide_values_and_options(spark):
    rows = times(table(200, 5, 2), 300.0)
    assert run(spark, rows, every=20, positives=2, negatives=4) == brute(rows, 20, 2, 4)
    large = times(rows, 1e4)
    assert run(spark, large, every=20) == brute(large, 20)
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(0, 1, [1e30, 1.0])])


def test_empty_and_lonely(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0, 0.0])]) == []
    assert run(spark, [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.6, 0.0])]) == brute(
        [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.6, 0.0])])


@pytest.mark.parametrize("d, bits", [(1, 3), (2, 3), (3, 2), (4, 2), (5, 1)])
def test_the_curve_visits_neighbours(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    keys = [k.tobytes() for k in hardneg.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = np.floor(256 * (centres[np.repeat(np.arange(6), 100)] + 0.05 * rng.normal(size=(600, 8))))
    anchors = rows[::20].astype("f8")
    read = 0
    for block in np.split(rows, 30):
        least, most = hardneg.score_bounds(anchors, block.min(axis=0), block.max(axis=0))
        scores = anchors @ block.T
        assert (least <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most).all()
        best = np.sort(anchors @ rows.T, axis=1)[:, -6]
        read += int((most >= best).sum())
    assert read < 0.4 * 30 * len(anchors)        # a third or so of the blocks is read for clustered vectors


def test_zone_maps_keep_blocks_from_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 16)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 6))
    rows = [(i, i % 2, [float(x) for x in centres[i % 5] + 0.02 * rng.normal(size=6)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, label long, vector array<double>")
    grid = hardneg.Grid(6, -5.0, 5.0, 256)
    blocks = hardneg.stage(hardneg.blocks_of(df, grid))
    assert blocks.agg({"label": "count"}).first()[0] >= 600 // 16
    chunks = hardneg.stage(hardneg.chunks_of(blocks, grid, 50, 5))
    pairs = blocks.alias("b").join(chunks.alias("c"), hardneg.F.col("b.label") == hardneg.F.col("c.label"))
    kept = pairs.filter(hardneg.product_bound(True) >= hardneg.F.col("c.lowest")).count()
    assert 0 < kept < pairs.count()
