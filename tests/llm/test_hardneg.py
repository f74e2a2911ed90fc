"""Hard negatives against a plain loop over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from cuelake.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, u string, place string, dim string, found string, score string"


def brute(table):
    rows = []
    for vec_id, vector, label in table:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        rows.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    place = {None: math.inf}
    out = Counter()
    for i, (a, label, x) in enumerate(rows):
        if a is None or a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), place.get(b, b), j, lab == label) for j, (b, lab, y) in enumerate(rows) if j != i and len(y) == len(x)]
        scored.sort()
        for p, pp, pj, _ in [s for s in scored if s[3]][:5]:
            near = [s for s in scored if not s[3] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            for rank, (n, _, nj, _) in enumerate(near, 1):
                out[(a, rows[pj][0], rank, rows[nj][0], -p, -n)] += 1
    return out


def vectors(seed, n, dim=24, spread=0.6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        c = centres[r.randrange(6)]
        out.append((i, [round(x + r.gauss(0, spread), r.choice([0, 1, 4])) for x in c], r.randrange(4)))
    return out


def odd():
    base = vectors(3, 400)
    copies = [(1000 + i, base[0][1], i % 3) for i in range(150)]  # many copies of one vector, equal scores
    return base + copies + [
        (5000, None, 1), (5050, base[1][1], None), (5100, [1.0, None] + [0.5] * 22, 1), (5150, [float("nan")] * 24, 2), (5200, [float("inf")] + [0.0] * 23, 2),
        (None, base[7][1], 1), (None, base[8][1], 2), (5250, [], 1), (5251, [], 1), (5253, [], 2), (5300, [1.0, 2.0], 1), (5301, [1.5, 2.0], 1), (5302, [1.0, 1.2], 3),
        (50, base[50][1], base[50][2]), (5350, [0.0] * 24, 0), (5400, [-x for x in base[2][1]], 1), (5450, base[9][1], -3)]


def result(spark, table):
    df = spark.createDataFrame([(*row, "c", "c", "c", "c", "c") for row in table], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in hardneg.hard_negatives(df).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_odd_rows(spark):
    assert result(spark, odd()) == brute(odd())


def test_clustered_rows(spark):
    table = vectors(11, 900, spread=0.2)
    assert result(spark, table) == brute(table)


@pytest.mark.parametrize("chunk", [7, 64])
def test_cells(chunk, monkeypatch):
    """The arrays alone: small chunks, so that thresholds prune between them."""
    monkeypatch.setattr(hardneg, "CHUNK_ROWS", chunk)
    table = vectors(chunk, 500, spread=0.2)
    v = np.array([[math.floor(256 * x) for x in vec] for _, vec, _ in table])
    ids, labels = np.arange(500), np.array([label for *_, label in table])
    rows = hardneg._Rows(ids, ids, labels, v)
    anchors = rows.take(np.arange(0, 500, 50))
    score = v @ v.T
    found = hardneg._positives(anchors, rows, 5)
    group, value = hardneg._first(*(np.concatenate(c) for c in zip(*found)), 5, np.concatenate([f[3] for f in found]))
    for i, a in enumerate(anchors.u):
        want = sorted((-score[a, j], j) for j in ids if j != a and labels[j] == labels[a])[:5]
        assert value[group == i].tolist() == [j for _, j in want]


def test_bounds_hold():
    r = np.random.default_rng(2)
    for dim in (1, 3, 4, 17, 64):
        a = hardneg._Rows(np.arange(40), np.arange(40), np.zeros(40, int), r.integers(-300, 300, (40, dim)))
        b = hardneg._Rows(np.arange(90), np.arange(90), np.zeros(90, int), r.integers(-300, 300, (90, dim)) // r.integers(1, 40, (90, 1)))
        score = a.v @ b.v.T
        low, high = np.quantile(score, 0.9, axis=1), np.quantile(score, 0.97, axis=1)
        left, right = hardneg._surviving(a, b, low, high)
        inside = (score >= low[:, None]) & (score <= high[:, None])
        assert not np.delete(inside, left, axis=0).any() and not np.delete(inside, right, axis=1).any()
        for mean, dev in [x for x in a.levels][:1]:
            mid, radius = mean @ b.levels[0][0].T, dev @ b.levels[0][1].T
            assert (np.abs(score - mid) <= radius + hardneg._slack(a, b)).all()


def test_large_components_are_exact(spark):
    r = random.Random(4)
    table = [(i, [float(np.float32(r.uniform(-3e5, 3e5))) for _ in range(3)], i % 2) for i in range(200)]
    assert result(spark, table) == brute(table)


def test_empty(spark):
    assert result(spark, []) == Counter()
