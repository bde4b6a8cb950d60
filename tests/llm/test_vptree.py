"""Vantage-point trees and hard negatives against brute force, with one leaf and with many."""

import random

import numpy as np
import pytest

from platehouse.llm import vptree
from platehouse.llm.vptree import Block, Space, Tree


def _space(x):
    return Space(x.shape[1], int((x**2).sum(axis=1).max()))


def test_bounds_hold_for_every_row_and_leaf():
    rng = np.random.default_rng(13)
    x = np.concatenate((rng.integers(-40, 40, (700, 8)), np.zeros((300, 8), np.int64)))
    space = _space(x)
    points, q = space.augmented(x, False), space.augmented(rng.integers(-40, 40, (30, 8)), True)
    assert np.allclose((points**2).sum(axis=1), space.norm2)
    for closed in (True, False):
        tree = Tree(points, 40, 16, closed)
        assert np.array_equal(np.sort(np.concatenate(tree.leaves)), np.arange(len(x)))
        low, high = tree.bounds(q)
        d = vptree._distances(q, points)
        for leaf, rows in enumerate(tree.leaves):
            assert (low[:, leaf] - space.slack <= d[:, rows].min(axis=1)).all() and (d[:, rows].max(axis=1) <= high[:, leaf] + space.slack).all()
        assert all((tree.leaf_of(points[rows]) == leaf).all() for leaf, rows in enumerate(tree.leaves))


@pytest.mark.parametrize("wide", [1, 1 << 21])
@pytest.mark.parametrize("same", [True, False])
def test_search_is_brute_force(same, wide):
    rng = np.random.default_rng(1)
    x = rng.integers(-6, 6, (900, 5)) * wide
    ids, labels = rng.permutation(900), rng.integers(0, 3, 900)
    q, kinds = x[:60], labels[:60]
    scores = q @ x.T
    lo, hi = np.where(rng.random(60) < 0.3, vptree._LEAST, rng.integers(0, 30, 60) * wide**2), rng.integers(20, 90, 60) * wide**2
    found = Block(_space(x), ids, labels, x).search(q, kinds, lo, hi, 4, same)
    expected = []
    for i in range(60):
        fit = [(-s, n) for s, n, k in zip(scores[i].tolist(), ids.tolist(), labels.tolist(), strict=True) if lo[i] <= s <= hi[i] and (k == kinds[i]) == same]
        expected += [(i, -s, n) for s, n in sorted(fit)[:4]]
    assert list(zip(*(c.tolist() for c in found), strict=True)) == expected


def _expected(rows):
    kept = {}
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(c is None or not np.isfinite(c) for c in vector):
            continue
        v = [int(np.floor(float(np.float32(c)) * 256)) for c in vector]
        row = ((label + 1) % 10 if vec_id % 7 == 0 else label, v)
        if sum(c * c for c in v) < 1 << 56:
            kept[vec_id] = min(kept.get(vec_id, row), row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for anchor, (label, v) in kept.items():
        if anchor % 50:
            continue
        scored = sorted((-dot(v, w), i, kind) for i, (kind, w) in kept.items() if i != anchor)
        for s, positive, _ in [r for r in scored if r[2] == label][:5]:
            fit = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(anchor, positive, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit)]
    return sorted(out)


def _rows():
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)], rng.randrange(10)) for i in range(1500)]
    rows += [(1500 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(400)]  # copies of one vector
    rows += [(2000, None, 1), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2100, [float("nan")] * 6, 2), (2150, [float("inf")] * 6, 2), (2200, [1.0] * 6, None), (None, [1.0] * 6, 3)]
    rows += [(2250, [3e38] * 6, 2), (2300, [2e5] * 6, 2), (2301, [1.9e5] * 6, 2), (2302, [1.2e5] * 6, 3), (2350, [], 1), (2400, [1.0, 1.0], 1), (2450, [-2.0] * 6, 4)]
    rows += [(50, [0.1] * 6, 9), (51, [9.0] * 6, 9), *rows[:40]]
    return rows


def _mined(spark, rows):
    df = spark.createDataFrame([(i, v, k, 1, "x", 2) for i, v, k in rows], "vec_id long, embedding array<float>, label int, qid int, leaf string, _n int").repartition(4)
    return sorted(map(tuple, vptree.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_negatives_are_brute_force(spark):
    assert _mined(spark, _rows()) == _expected(_rows())


def test_negatives_with_many_leaves(spark, monkeypatch):
    for name, value in (("LEAF_ROWS", 60), ("MOST_LEAVES", 16), ("SAMPLE_ROWS", 500)):
        monkeypatch.setattr(vptree, name, value)
    assert _mined(spark, _rows()) == _expected(_rows())


def test_empty_table_and_few_rows(spark):
    assert _mined(spark, []) == []
    assert _mined(spark, [(0, [1.0, 0.0], 1)]) == []
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.75, 0.0], 3)]
    assert _mined(spark, few) == _expected(few)
