"""Operators against literal expectations and brute force."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from platehouse.operators import datasets, evaluation, events, identity, journeys, policy, quality, reid, retention, stats, topology, voting
from platehouse.streaming import tracks

T0 = datetime(2023, 3, 4, 5, 6)
EDGE = "id string, from_camera_id string, to_camera_id string, minimum_travel_seconds double, typical_travel_seconds double, maximum_travel_seconds double, enabled boolean"


def test_pages_join_up_to_the_whole_order(spark):
    rows = spark.createDataFrame([(f"e{i:02}", T0 + timedelta(seconds=i // 3)) for i in range(20)], "id string, occurred_at timestamp_ntz")
    seen, cursor = [], None
    while True:
        found = events.page(rows, 6, cursor).collect()
        seen += [r["id"] for r in found[:6]]
        if len(found) <= 6:
            break
        cursor = (str(found[5]["occurred_at"]), found[5]["id"])
    assert seen == [r["id"] for r in rows.orderBy(F.desc("occurred_at"), F.desc("id")).collect()]
    assert events.decode_cursor(events.encode_cursor("2026", "x")) == ("2026", "x")
    with pytest.raises(ValueError):
        events.decode_cursor("%%%")


def test_first_write_wins_on_either_key(spark):
    rows = [("a", "k1", 1), ("a", "k2", 2), ("b", "k2", 3), ("c", "k2", 4), ("d", "k9", 5)]
    incoming = spark.createDataFrame(rows, "id string, sem string, at int")
    stored = spark.createDataFrame([("z", "k9", 0)], "id string, sem string, at int")
    kept = events.insert_if_absent(stored, incoming, "id", ["sem"], ["at"]).collect()
    ids, sems, expect = {"z"}, {"k9"}, []
    for i, s, at in rows:
        if i not in ids and s not in sems:
            ids.add(i), sems.add(s), expect.append(i)
    assert sorted(r["id"] for r in kept) == expect == ["a", "b"]


def test_voting(spark):
    read = [("43C06172", 0.5), ("43C06I72", 0.9), ("43C06172", 0.6), ("88K99999", 0.99), ("43C06172", 0.7)]
    rows = [("p", i, t, t, t, False, c, 0.7, 0.8) for i, (t, c) in enumerate(read)] + [("q", 0, "77123", "77123", "771.23", True, 0.99, 0.9, 0.9), ("q", 1, "18B477123", "18B477123", "18B4-771.23", False, 0.4, 0.9, 0.9), ("r", 0, None, None, None, False, 0.9, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "track_id string, frame_id int, raw string, compact string, normalized string, partial boolean, ocr_confidence double, quality_score double, detection_confidence double")
    got = {r["track_id"]: r for r in voting.vote(df).collect()}
    assert set(got) == {"p", "q"}
    # four readings within two edits outweigh the surest one; the misread character is outvoted
    assert (got["p"]["compact"], got["p"]["normalized"], got["p"]["observations"]) == ("43C06172", "43C-061.72", 4)
    assert got["p"]["raw"] == "43C06172" and 0 < got["p"]["confidence"] < 0.999
    assert got["q"]["normalized"] == "18B4-771.23" and not got["q"]["partial"] and got["q"]["observations"] == 1


def test_crossing(spark):
    rows = [("in", 0, 3.0, 8.0), ("in", 1, 3.0, 6.0), ("in", 2, 3.0, 2.0), ("out", 0, 4.0, 1.0), ("out", 1, 4.0, 9.0), ("no", 0, 5.0, 9.0), ("no", 1, 6.0, 7.0)]
    df = spark.createDataFrame(rows, "track_id string, frame_id int, x double, y double")
    got = {r["track_id"]: r["direction"] for r in voting.crossing(df, ((0.0, 5.0), (9.0, 5.0)), "ENTER").collect()}
    assert got == {"in": "ENTER", "out": "EXIT", "no": "UNKNOWN"}


def test_sessions_match_the_stream(spark):
    rng = random.Random(3)
    at, ticks = 0.0, []
    for _ in range(120):
        at += rng.choice([0.25, 0.5, 1.0, 2.0, 2.5])
        ticks.append((at, [t for t in "abc" if rng.random() < 0.3]))
    open_, gone, closed = {}, {}, []
    for now, seen in ticks:
        closed += tracks.advance(open_, gone, now, seen, set())
    closed += [(t, *v, "END") for t, v in open_.items()]
    base = datetime(2026, 1, 1)
    stamp = lambda s: base + timedelta(seconds=s)
    obs = spark.createDataFrame([("c", 0, t, stamp(now)) for now, seen in ticks for t in seen], "camera_id string, epoch int, track_id string, at timestamp_ntz")
    every = spark.createDataFrame([("c", 0, stamp(now)) for now, _ in ticks], "camera_id string, epoch int, at timestamp_ntz")
    got = voting.sessions(obs, every).groupBy("track_id", "session").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n")).collect()
    assert sorted((r["track_id"], (r["a"] - base).total_seconds(), (r["b"] - base).total_seconds(), r["n"]) for r in got) == sorted((t, a, b, n) for t, a, b, n, _ in closed)


def test_candidates_and_reid(spark):
    edges = spark.createDataFrame([("n1", "west", "gate", 20.0, 90.0, 200.0, True), ("n2", "east", "gate", 5.0, 40.0, 80.0, True), ("n3", "roof", "gate", 0.0, 10.0, 5000.0, False)], EDGE)
    rows = [("now", "v0", "gate", 0), ("west90", "v1", "west", -90), ("west20", "v2", "west", -20), ("west201", "v3", "west", -201), ("roof10", "v4", "roof", -10), ("east40", "v5", "east", -40), ("own", "v0", "west", -80)]
    prints = spark.createDataFrame([(i, v, c, T0 + timedelta(seconds=s), "43C06172", "car", None, 1) for i, v, c, s in rows], "id string, vehicle_id string, camera_id string, observed_at timestamp_ntz, plate string, vehicle_type string, color string, embedding_id int")
    found = topology.candidates(prints, edges).where("source_id = 'now'").orderBy("place").collect()
    assert [(r["candidate_id"], r["time_score"]) for r in found] == [("east40", 1.0), ("west90", 1.0), ("west20", 0.0)]
    scored = {r["candidate_id"]: r for r in reid.score_pairs(topology.candidates(prints, edges).where("source_id = 'now'"), prints).collect()}
    assert scored["east40"]["decision"] == "MATCH" and scored["west20"]["decision"] == "REVIEW"
    sparse = prints.withColumn("plate", F.lit(None).cast("string"))
    assert all(r["decision"] != "MATCH" for r in reid.score_pairs(topology.candidates(sparse, edges), sparse).collect())


def test_candidates_take_the_newest_places_of_a_busy_camera(spark):
    rng = random.Random(7)
    edges = [("x", "a", "b", 1.0, 30.0, 60.0, True), ("y", "b", "b", 0.0, 5.0, 400.0, True), ("z", "c", "b", 2.5, 2.5, 90.0, True)]
    rows = [(f"i{n:04}", f"v{rng.randrange(9)}", rng.choice("aabc"), T0 + timedelta(seconds=rng.randrange(600))) for n in range(700)]
    got = topology.candidates(spark.createDataFrame(rows, "id string, vehicle_id string, camera_id string, observed_at timestamp_ntz"), spark.createDataFrame(edges, EDGE), per_edge=7, per_source=1000).collect()
    expect = set()
    for source, vehicle, camera, at in rows:
        for edge, start, end, low, _, high, _ in edges:
            if camera == end:
                near = sorted(((t, i, v) for i, v, c, t in rows if c == start and low <= (at - t).total_seconds() <= high), reverse=True)[:7]
                expect |= {(source, i, edge) for _, i, v in near if i != source and v != vehicle}
    assert {(r["source_id"], r["candidate_id"], r["edge_id"]) for r in got} == expect and len(got) == len(expect)


def test_nearest_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(reid, "QUERY_BLOCK", 3)
    vectors = np.random.default_rng(3).normal(size=(60, 5))
    df = spark.createDataFrame([(i, f"m{i % 2}", [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, model string, values array<double>")
    got = {(r["query_id"], r["place"]): r["id"] for r in reid.nearest(df.where("id % 5 = 0"), df, -1.0, 4).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 60, 5):
        others = sorted(((float(unit[q] @ unit[i]), i) for i in range(60) if i != q and i % 2 == q % 2), reverse=True)[:4]
        assert [got[q, n] for n in range(4)] == [i for _, i in others]


def test_journey(spark):
    edges = spark.createDataFrame([("1", "p", "q", 10.0, 20.0, 45.0, True), ("2", "q", "r", 5.0, 9.0, 30.0, True)], EDGE)
    ev = spark.createDataFrame([("k", "v", "r", T0 + timedelta(seconds=100)), ("i", "v", "p", T0), ("j", "v", "q", T0 + timedelta(seconds=33))], "id string, vehicle_id string, camera_id string, occurred_at timestamp_ntz")
    found = journeys.segments(ev, edges).orderBy("to_event").collect()
    assert [(r["elapsed_seconds"], r["feasible"], r["truncated"]) for r in found] == [(33.0, True, False), (67.0, False, False)]
    assert [r["truncated"] for r in journeys.segments(ev, edges, 2).collect()] == [True]
    assert journeys.summarize(ev, journeys.segments(ev, edges)).first()["infeasible"] == 1


def test_rules_follow_two_valued_logic(spark):
    rows = [("1", "cam", "red", ["BLOCK"]), ("2", "cam", None, []), ("3", None, "blue", [])]
    ev = spark.createDataFrame(rows, "id string, camera_id string, color string, list_types array<string>")
    c = policy.Condition
    cases = {"EQ": (c("color", "EQ", None), {"2"}), "NEQ": (c("color", "NEQ", "red"), {"2", "3"}), "IN": (c("color", "IN", ["red", None]), {"1", "2"}), "NOT_IN": (c("color", "NOT_IN", ["red"]), {"2", "3"}), "CONTAINS": (c("watchlist", "CONTAINS", "BLOCK"), {"1"}), "EXISTS": (c("camera_id", "EXISTS", False), {"3"})}
    for condition, expect in cases.values():
        assert {r["id"] for r in ev.where(policy.compile_condition(condition)).collect()} == expect
    with pytest.raises(ValueError):
        policy.validate(policy.Rule("x", "x", 1, (c("owner", "EQ", 1),)))
    assert policy.apply_rules(ev, []).count() == 0


def test_quality_and_feedback(spark):
    rows = [("43C-061.72", "CONFIRMED", 0.7, True, True, T0), (None, "NO_PLATE", None, False, False, T0 + timedelta(hours=1))]
    ev = spark.createDataFrame(rows, "plate string, status string, plate_confidence double, reviewed boolean, corrected boolean, occurred_at timestamp_ntz").withColumn("model_name", F.lit("m")).withColumn("model_version", F.lit("1"))
    total = quality.facets(ev, "2023-03-01", "2023-03-08").where("facet = 'total'").first()
    assert (total["events"], total["readable"], total["success_rate"], total["unknown_rate"], total["correction_rate"]) == (2, 1, 0.5, 0.5, 1.0)


def _brute_ap(truths, preds, thr):
    def iou(a, b):
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        common = max(0, w) * max(0, h)
        union = a[2] * a[3] + b[2] * b[3] - common
        return common / union if union > 0 else 0

    used, tp, pr = set(), 0, []
    for n, p in enumerate(sorted(preds, key=lambda p: (-p[4], p[0])), 1):
        best, top = None, thr
        for t in truths:
            if t[1] == p[1] and t[0] not in used and iou(t[3], p[3]) >= top:
                best, top = t[0], iou(t[3], p[3])
        if best is not None:
            used.add(best)
            tp += 1
        pr.append((tp / len(truths), tp / n))
    return sum(max((b for a, b in pr if a >= i / 100), default=0) for i in range(101)) / 101


def test_average_precision(spark):
    rng = random.Random(5)
    truths = [(i, rng.randrange(6), 1, [rng.randrange(20), rng.randrange(20), 10 + rng.randrange(5), 10]) for i in range(30)]
    preds = [(100 + i, rng.randrange(6), 1, [rng.randrange(20), rng.randrange(20), 10 + rng.randrange(5), 10], round(rng.random(), 2)) for i in range(60)]
    box = lambda rows: [(*r[:3], [float(x) for x in r[3]], *r[4:]) for r in rows]
    t = spark.createDataFrame(box(truths), "id long, image_id long, category_id long, bbox array<double>")
    p = spark.createDataFrame(box(preds), "id long, image_id long, category_id long, bbox array<double>, score double")
    got = {r["threshold"]: r["average_precision"] for r in evaluation.average_precision(t, p, (0.3, 0.5)).collect()}
    for thr in (0.3, 0.5):
        assert got[thr] == pytest.approx(_brute_ap(truths, preds, thr))
    pr = evaluation.precision_recall(evaluation.match(t, p), t).first()
    assert pr["true_positives"] + pr["false_positives"] == 60


def test_suppression_and_association(spark):
    boxes = spark.createDataFrame([(1, 1, 0, [0.0, 0.0, 10.0, 10.0], 0.9), (2, 1, 0, [1.0, 0.0, 11.0, 10.0], 0.8), (3, 1, 1, [1.0, 0.0, 11.0, 10.0], 0.7)], "id long, image_id long, category_id long, bbox array<double>, score double")
    assert sorted(r["id"] for r in evaluation.suppress(boxes, 0.5).collect()) == [1, 3]
    assert [r["id"] for r in evaluation.suppress(boxes, 0.5, True).collect()] == [1]
    tr = spark.createDataFrame([(1, 7, [0.0, 0.0, 10.0, 10.0]), (1, 8, [50.0, 50.0, 1.0, 1.0])], "frame_id long, track_id long, bbox array<double>")
    de = spark.createDataFrame([(1, 70, [1.0, 0.0, 10.0, 10.0])], "frame_id long, detection_id long, bbox array<double>")
    assert {r["track_id"]: r["detection_id"] for r in evaluation.associate(tr, de).collect()} == {7: 70, 8: None}


def test_ocr_metrics_and_gate(spark):
    rows = spark.createDataFrame([("43C-061.72", "43C-061.72", 0.7), ("88K-999.99", "88K-999.9G", 0.6)], "label string, predicted string, confidence double")
    m = evaluation.ocr_metrics(rows)
    assert m.first()["exact_accuracy"] == 0.5 and m.first()["character_accuracy"] > 0.9
    assert m.select(evaluation.gate({"exact_accuracy": F.col("exact_accuracy") >= 0.6, "character_accuracy": F.col("character_accuracy") >= 0.5})).first()[0] == ["exact_accuracy"]


def test_identity(spark):
    rows = [(f"{i}", "v", f"P{i % 3}" if i else None, 0.5 + i / 100, "car" if i % 2 else "truck", 0.5, None if i < 2 else "red", T0 + timedelta(seconds=i)) for i in range(6)]
    p = spark.createDataFrame(rows, "id string, vehicle_id string, plate string, plate_confidence double, vehicle_type string, vehicle_confidence double, color string, observed_at timestamp_ntz")
    r = identity.rebuild(p).first()
    assert (r["primary_plate"], r["vehicle_type"], r["color"], r["observation_count"]) == ("P2", "truck", "red", 6)
    m = identity.merge_in_order(p).first()
    assert (m["primary_plate"], m["vehicle_type"], m["color"], m["aliases"]) == ("P1", "truck", "red", ["P1", "P2", "P0"])


def test_datasets(spark):
    rows = spark.createDataFrame([(1, "x", "g1"), (2, "x", "g2"), (3, "y", "g1")], "id int, text string, grp string")
    got = {r["id"]: (r["conflict"], r["copies"]) for r in datasets.dedup_content(rows, F.col("text"), "id", "grp").collect()}
    assert got == {1: (True, 2), 3: (False, 1)}
    split = datasets.split_by_group(rows, "grp", "s")
    assert datasets.leaking_groups(split, "grp").count() == 0
    assert {r["split"] for r in datasets.missing_splits(split, ["train", "nowhere"]).collect()} >= {"nowhere"}


def test_retention_boundary_is_strict(spark):
    rows = spark.createDataFrame([("at", T0), ("old", T0 - timedelta(seconds=1)), ("pinned", T0 - timedelta(days=1))], "id string, occurred_at timestamp_ntz")
    rows = rows.withColumns({m: F.lit(None).cast("string") for m in retention.MEDIA})
    pins = spark.createDataFrame([("pinned", "READY")], "source_event_id string, status string")
    assert [r["id"] for r in retention.expired_events(rows, pins, str(T0 + timedelta(days=10)), 10, 5).collect()] == ["old"]


def test_stats(spark):
    values = [float(x) for x in np.random.default_rng(1).exponential(5, 101)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    s = stats.latency_summary(df, "v").first()
    assert s["p95"] == pytest.approx(np.percentile(values, 95), abs=1e-3) and s["count"] == 101
    assert stats.nearest_rank(df.withColumn("g", F.lit(1)), "v", 0.95, ["g"]).first()["v"] == sorted(values)[95]
    assert stats.jain(df.limit(0), "v").first()["fairness"] == 0.0


def test_redaction(spark):
    from platehouse.operators import state

    docs = ['{"user":"u","apiToken":"x","url":"https://h/p?q=1#f","cam":"RTSP://a","deep":{"password":1,"list":["Bearer x",1,null]}}', '{"u":"https://me:pw@h/"}', None]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(state.redact(F.col("d"))).collect()]
    assert got == ['{"user":"u","apiToken":"[REDACTED]","url":"https://h/p","cam":"[REDACTED]","deep":{"password":"[REDACTED]","list":["[REDACTED]",1,null]}}', '{"u":"[REDACTED]"}', None]


def test_consensus_and_sampling(spark):
    from platehouse.operators import annotations

    rows = [(1, i, "ONE", [float(x), 0.0, 10.0, 10.0], [[float(x), 0.0], [x + 10.0, 0.0], [x + 10.0, 10.0]]) for i, x in enumerate([0.0, 0.2, 0.4, 40.0])]
    found = annotations.consensus(spark.createDataFrame(rows, "image_id long, id long, layout string, bbox array<double>, polygon array<array<double>>")).orderBy("id").collect()
    assert [(r["id"], r["votes"], r["bbox"]) for r in found] == [(0, 3, [0.2, 0.0, 10.0, 10.0]), (3, 1, [40.0, 0.0, 10.0, 10.0])]
    frames = spark.range(50).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_id"))
    due, expect = 0.0, []
    for f in range(50):
        if f / 30.0 + 0.5 / 30.0 >= due:
            due += 1 / 7.0
            expect.append(f)
    assert sorted(r["frame_id"] for r in annotations.sampled_frames(frames, 30.0, 7.0).collect()) == expect


def test_audit_redaction_reads_whole_pages(spark, tmp_path):
    from platehouse.plans import registry
    from platehouse.plans import catalog  # noqa: F401

    pages = [(1, "https://x/a", "<p>" + "y" * 200), (2, "https://x/a", "z" * 4096 + "tail"), (3, None, "Bearer abc"), (4, "ftp://x", None), (6, "x", "é\"\\\n" * 1500), (10, "https://x/a", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["url"], r["html"]) for r in registry.queries()["audit_redaction"](spark, str(tmp_path)).collect()}
    assert got == {1: ("https://x/a", pages[0][2]), 2: ("https://x/a", "z" * 4096), 3: (None, "[REDACTED]"), 4: ("ftp://x?q=1#x", None), 6: ("x?q=1#x", pages[4][2][:4096]), 10: ("[REDACTED]", "")}


def test_audit_redaction_takes_small_batches(spark, tmp_path):
    import pyarrow as pa

    from platehouse.plans import registry

    settings = [f"spark.sql.execution.arrow.{s}" for s in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {s: spark.conf.get(s) for s in settings}
    try:
        for s in settings:
            spark.conf.unset(s)
        spark.range(40).selectExpr("id AS page_id", "'https://x/a' AS url", "repeat('y', 1000000) AS html").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
        shown = registry.queries()["audit_redaction"](spark, str(tmp_path))
        assert shown.selectExpr("max(length(html))", "count(html)").first()[:] == (4096, 40)
        rows_at_once = F.arrow_udf(lambda a: pa.array([len(a)] * len(a), pa.int64()), "long")
        assert spark.read.parquet(str(tmp_path / "pages.parquet")).select(rows_at_once("html").alias("n")).agg(F.max("n")).first()[0] <= 9
    finally:
        for s, v in before.items():
            spark.conf.set(s, v)


def test_redaction_limits(spark):
    from platehouse.operators import state

    deep = "1"
    for _ in range(10):
        deep = '{"d":' + deep + "}"
    wide = "[" + ",".join(["0"] * 1001) + "]"
    many = "{" + ",".join(f'"k{i}":0' for i in range(1001)) + "}"
    got = [json.loads(r[0]) for r in spark.createDataFrame([(d,) for d in (deep, wide, many, '{"n":NaN}')], "d string").select(state.redact(F.col("d"))).collect()]
    levels, at = 0, got[0]
    while isinstance(at, dict):
        levels, at = levels + 1, at["d"]
    assert (levels, at) == (9, "[TRUNCATED]") and got[1] == [0] * 1000 + ["[TRUNCATED]"] and len(got[2]) == 1001 and got[2]["_truncated"] is True and got[3] == {"n": "[NON_FINITE]"}


def test_cursors_are_bound_to_their_filters(spark):
    from platehouse.operators import annotations

    items = spark.createDataFrame([(f"r{i:02}", "OPEN" if i % 2 else "DONE", "x") for i in range(20)], "review_id string, status string, reason string")
    seen, cursor = [], None
    while True:
        found = [r["review_id"] for r in annotations.review_queue(items, "OPEN", None, 3, cursor).collect()]
        seen += found[:3]
        if len(found) <= 3:
            break
        cursor = events.encode_bound(found[2], {"status": "OPEN", "reason": None})
    assert seen == [f"r{i:02}" for i in range(1, 20, 2)]
    for status, text in (("DONE", cursor), ("OPEN", "%%%")):
        with pytest.raises(ValueError):
            annotations.review_queue(items, status, None, 3, text)


def test_recent_ids_and_causes(spark):
    from platehouse.operators import state

    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "id string, at int")
    assert [(r["id"], r["at"]) for r in state.recent_ids(rows, "id", "at", 2).collect()] == [("c", 4), ("b", 2)]
    assert [r["causes"] for r in state.failure_causes(rows, {"late": F.col("at") > 2, "first": F.col("id") == "a"}).orderBy("at").collect()] == [["first"], [], ["late", "first"], ["late"]]
    assert [(r["id"], r["at"]) for r in state.newest_per_key(rows, ["id"], [F.desc("at")]).orderBy("id").collect()] == [("a", 3), ("b", 2), ("c", 4)]


def test_due_and_accepted_readings(spark):
    frames = spark.createDataFrame([("t", f, f + 1) for f in (0, 1, 3, 4, 9, 10, 14, 30)], "track_id string, frame_id long, seen long")
    stable = spark.createDataFrame([("t", 14, "x")], "track_id string, frame_id long, normalized string")
    assert [r["frame_id"] for r in voting.due_frames(frames, 4, stable).orderBy("frame_id").collect()] == [0, 4, 9, 14]
    rows = [("c", 0, "nonsense", 0.99), ("c", 1, "43C06172", 0.5), ("c", 2, "43C06173", 0.8), ("c", 3, "43C06174", 0.95), ("d", 0, "43C06172", 0.2)]
    tries = spark.createDataFrame(rows, "crop string, variant int, text string, confidence double")
    assert [(r["crop"], r["compact"]) for r in voting.accepted_readings(tries, ["crop"], 0.3, 0.75).collect()] == [("c", "43C06173")]
    assert [r["compact"] for r in voting.accepted_readings(tries, ["crop"], 0.3).collect()] == ["43C06174"]


def test_seeks_and_suggestions(spark):
    from platehouse.operators import annotations

    videos = spark.createDataFrame([("v", 10.0, 12), ("empty", 10.0, 0)], "video_id string, fps double, frame_count int")
    assert [r["frame_index"] for r in annotations.seek_samples(videos, 0.25).orderBy("frame_index").collect()] == [0, 3, 5, 8, 10]
    assert [r["frame_index"] for r in annotations.seek_samples(videos, 0.04).orderBy("frame_index").collect()] == list(range(12))
    box = [1.0, 2.0, 3.0, 4.0]
    pairs = [([box], [box]), ([box], [[1.0, 2.009, 3.0, 4.0]]), ([box], [[1.0, 2.02, 3.0, 4.0]]), ([box, box], [box]), ([], [])]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<array<double>>, b array<array<double>>").orderBy("i").select(annotations.same_boxes(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False]


def test_performance_gates(spark):
    good = "0" * 64
    rows = [("a", "detector-runtime-benchmark", good, 5.0, 10.0, None, True, True), ("b", "edge-capacity-benchmark", "x", 1.5, 300.0, 0.2, False, None)]
    schema = "file string, kind string, model_sha256 string, latency_count double, p95_ms double, drop_ratio double, gate_passed boolean, accuracy_representative boolean"
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in stats.verify_gates(df).collect()] == [("b", f) for f in ("invalid_model_hash", "missing_latency_samples", "drop_ratio_exceeds_limit", "p95_latency_exceeds_limit", "gate_failed")]
    assert {tuple(r) for r in stats.verify_gates(df.where("file = 'c'")).collect()} == {(None, f) for f in ("missing_kind:detector-runtime-benchmark", "missing_kind:edge-capacity-benchmark", "missing_accuracy_representative_detector_gate")}


def test_a_question_for_a_plate_takes_the_form_that_events_hold(spark):
    assert events.canonical("43c 06172", spark) == "43C-061.72" and events.canonical("??", spark) is None
    seen = spark.createDataFrame([("v", "43C-061.72", 0.5, T0), ("w", "88K-999.99", 0.9, T0)], "vehicle_id string, plate string, plate_confidence double, observed_at timestamp_ntz").withColumns({"vehicle_type": F.lit("car"), "vehicle_confidence": F.lit(1.0), "color": F.lit(None).cast("string")})
    assert [r["vehicle_id"] for r in identity.by_plate(identity.rebuild(seen), "43C-061.72").collect()] == ["v"]
