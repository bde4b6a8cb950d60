"""Greedy matching on arrays against a plain walk, over batch borders and with sliced pairs."""

import random

import pytest

from platehouse.operators import evaluation


def _iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    common = max(0.0, w) * max(0.0, h)
    union = a[2] * a[3] + b[2] * b[3] - common
    return common / union if union > 0 else 0.0


@pytest.mark.parametrize(("batch", "pairs"), [(10_000, 2_000_000), (7, 5)])
def test_matches_are_a_plain_walk(spark, monkeypatch, batch, pairs):
    monkeypatch.setattr(evaluation, "MOST_PAIRS", pairs)
    rng = random.Random(6)
    box = lambda: [float(rng.randrange(12)), float(rng.randrange(12)), float(rng.randrange(0, 9)), 6.0]
    image = lambda: rng.choice([1] * 6 + list(range(2, 30)) + [None])
    truths = [(i, image(), rng.randrange(2), box()) for i in range(150)]
    predictions = [(1000 + i, image(), rng.randrange(2), box(), rng.choice([0.1, 0.5, 0.5, 0.9])) for i in range(200)]
    thresholds, expected = (0.3, 0.6), {}
    for threshold in thresholds:
        used = set()
        for i, im, kind, b, _ in sorted(predictions, key=lambda p: (-p[4], p[0])):
            free = [(_iou(b, t[3]), t[0]) for t in truths if t[1] == im and t[2] == kind and t[0] not in used]
            best = max((x for x in free if x[0] >= threshold), default=None)
            used.add(best and best[1])
            expected.setdefault(i, []).append(best and best[1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        t = spark.createDataFrame(truths, "id long, image_id long, category_id long, bbox array<double>").repartition(3)
        p = spark.createDataFrame(predictions, "id long, image_id long, category_id long, bbox array<double>, score double").repartition(3)
        assert {r["prediction_id"]: r["truth_ids"] for r in evaluation.match_all(t, p, thresholds).collect()} == expected
        assert evaluation.match_all(t, p.limit(0), thresholds).count() == 0
        assert {x for r in evaluation.match_all(t.limit(0), p, thresholds).collect() for x in r["truth_ids"]} == {None}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
