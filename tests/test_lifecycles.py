"""Lifecycles and folds against a plain walk, with a key that fills most ranges, ties and nulls."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from platehouse.functions.folding import Machine, fold
from platehouse.operators import annotations, lifecycles

START = dt.datetime(2024, 1, 1)


def _commands(kinds, n=3000, seed=1):
    rng = random.Random(seed)
    ids = ["hot"] * 20 + [f"r{i}" for i in range(30)] + ["zz"]
    return [(rng.choice(ids), START + dt.timedelta(seconds=rng.randrange(4000)), i, rng.choice(kinds), rng.choice("ab"), rng.choice(["m", "n", None])) for i in range(n)]


def _walked(rows, start, step):
    out, states = [], {}
    for row in sorted(rows, key=lambda r: r[:3]):
        states[row[0]], got = step(states.get(row[0], start), row)
        out.append(got)
    return sorted(out, key=str)


def _micros(at):
    return int((at - START).total_seconds()) * 1_000_000 + 1_704_067_200_000_000


def _df(spark, rows, last):
    return spark.createDataFrame(rows, f"id string, at timestamp, seq int, command string, {last}").repartition(5)


def test_actions(spark):
    rows = _commands(["CLAIM", "CLAIM", "FAIL", "RELEASE", "ABANDON", "SUCCEED", "odd"])
    rows = [r for r in rows if r[3] not in ("SUCCEED", "ABANDON") or r[2] % 9 == 0]

    def step(state, row):
        status, n, since = state
        at, command, ok = _micros(row[1]), row[3], False
        if command == "CLAIM":
            if status is None or (status != "SUCCEEDED" and n < 4 and (status != "RUNNING" or since < at - 60_000_000)):
                ok, status, n, since = True, "RUNNING", n + 1, at
        elif status is not None and command != "odd":
            ok, since = True, at
            n = 4 if command == "ABANDON" else max(0, n - 1) if command == "RELEASE" else n
            status = "SUCCEEDED" if command == "SUCCEED" else "FAILED"
        return (status, n, since), (row[0], at, command, ok, status, n)

    got = lifecycles.action_history(_df(spark, rows, "lease string, manifest string"), 60.0, 4).collect()
    assert sorted(map(tuple, got), key=str) == _walked(rows, (None, 0, 0), step)


def test_exports(spark):
    rows = _commands(["CLAIM", "COMPLETE", "FAIL", "FAIL"])

    def step(state, row):
        status, holder, n, since, manifest = state
        at, command, export, digest, ok = _micros(row[1]), row[3], row[4], row[5], False
        if command == "CLAIM" and status == "EXPORTING" and holder == export:
            ok = True
        elif command == "CLAIM" and (status in ("READY", "EXPORT_FAILED") or (status == "EXPORTING" and since < at - 5_000_000)):
            ok, status, holder, n, since, manifest = True, "EXPORTING", export, n + 1, at, None
        elif command == "COMPLETE" and holder == export and status in ("EXPORTING", "EXPORTED") and manifest in (None, digest):
            ok, status, manifest = True, "EXPORTED", digest
        elif command == "FAIL" and holder == export and status == "EXPORTING":
            ok, status = True, "EXPORT_FAILED"
        return (status, holder, n, since, manifest), (row[0], at, command, export, ok, status, holder, n, manifest)

    got = lifecycles.export_history(_df(spark, rows, "export_id string, manifest string"), 5.0).collect()
    assert sorted(map(tuple, got), key=str) == _walked(rows, ("READY", None, 0, 0, None), step)


def test_leases_are_lost_and_kept(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [("m", at(0), 0, "CLAIM", "a", None), ("m", at(5), 1, "CLAIM", "b", None), ("m", at(20), 2, "CLAIM", "b", None), ("m", at(21), 3, "DELETE", "a", None), ("m", at(22), 4, "FAIL", "b", None), ("m", at(23), 5, "DELETE", "b", None), ("m", at(24), 6, "CLAIM", "c", None), ("m", at(25), 7, "DELETE", "c", None), ("m", at(90), 8, "CLAIM", "d", None)]
    got = lifecycles.lease_history(_df(spark, rows, "lease_id string, x string"), 10.0).orderBy("at").collect()
    assert [(r["accepted"], r["state"], r["holder"]) for r in got] == [(True, "DELETING", "a"), (False, "DELETING", "a"), (True, "DELETING", "b"), (False, "DELETING", "b"), (True, "FAILED", None), (False, "FAILED", None), (True, "DELETING", "c"), (True, "DELETED", None), (False, "DELETED", None)]


@pytest.mark.parametrize("ranges", [1, 3, 9])
def test_one_key_fills_many_ranges_and_ends_once(spark, ranges):
    rows = [("hot", i, i % 7 + 1) for i in range(900)] + [(f"k{i:02}", 0, 1) for i in range(40)] + [("z", i, i + 1) for i in range(50)]
    step = lambda s, row: ((s[0] + (row[2] == s[0]),), None)
    machine = Machine((1,), step, "id string, revision int, n int", lambda key, s: (key[0], s[0], 0))
    got = fold(spark.createDataFrame(rows, "id string, at int, expected int").repartition(4), ["id"], ["at", "expected"], machine, ranges).collect()
    expected, revisions = {}, {}
    for key, _, wanted in sorted(rows):
        revisions[key] = revisions.get(key, 1) + (wanted == revisions.get(key, 1))
        expected[key] = revisions[key]
    assert len(got) == len(expected) and {r["id"]: r["revision"] for r in got} == expected
    assert fold(spark.createDataFrame([], "id string, at int, expected int"), ["id"], ["at", "expected"], machine, ranges).count() == 0


def test_sampling_after_gaps(spark):
    rng = random.Random(4)
    frames = [(v, f) for v in range(4) for f in sorted(rng.sample(range(400), 120))]
    expected = []
    for v in range(4):
        due = 0
        for _, f in (x for x in frames if x[0] == v):
            if (f + 0.5) * 4 >= due * 25:  # 25 frames a second, four of them wanted
                due += 1
                expected.append((v, f))
    df = spark.createDataFrame(frames, "video_id long, frame_id long").repartition(3)
    assert sorted(map(tuple, annotations.sampled_frames(df, 25.0, 4.0).collect())) == expected


def test_claims_of_media_and_events_that_may_go(spark):
    day = lambda n: START + dt.timedelta(days=n)
    media = spark.createDataFrame([("a", day(0), "k1", None, None), ("b", day(1), "k2", "FAILED", day(2)), ("c", day(2), "k3", "DELETING", day(3)), ("d", day(3), "k4", "DELETING", day(30)), ("e", day(4), "k5", "DELETED", day(5)), ("f", day(5), None, None, None), ("g", day(50), "k6", None, None), ("h", day(6), "pin", None, None)], "event_id string, occurred_at timestamp, key string, state string, updated_at timestamp")
    pins = spark.createDataFrame([("pin",), (None,)], "key string")
    at = lambda n: F.lit(day(n)).cast("timestamp")
    claims = lambda n: [tuple(r) for r in lifecycles.claim_media(media, pins, at(20), at(10), n).collect()]
    assert claims(9) == [("a", "k1", False), ("b", "k2", False), ("c", "k3", True)] and claims(1) == [("a", "k1", False)]
    events = media.select(F.col("event_id").alias("id"), "occurred_at")
    samples = spark.createDataFrame([("e", "EXPORTED"), ("f", "READY"), (None, "READY")], "source_event_id string, status string")
    assert [r["id"] for r in lifecycles.deletable_events(events, media, samples, at(20)).collect()] == ["e"]
