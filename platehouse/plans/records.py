"""Registered queries of lists, pages, sinks and finalized events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platehouse.functions import plates
from platehouse.functions.scratch import new_path
from platehouse.operators import annotations, datasets, events, identity, policy, state, stats, topology, voting
from platehouse.plans import fixtures as fx
from platehouse.plans.catalog import _PLATE_SQL, FROM, TO, vote_sql
from platehouse.plans.registry import query
from platehouse.sources import files


def _stamp(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


@query("WITH {ve} SELECT id, vehicle_id FROM ve WHERE camera_id = 'cam-3' AND observed_at BETWEEN TIMESTAMP '" + FROM + "' AND TIMESTAMP '" + TO + "' ORDER BY observed_at DESC, id DESC LIMIT 500")
def camera_window(spark, sf_dir):
    """A camera's observations in a time window, both ends included."""
    return events.in_camera_window(fx.events(spark, sf_dir), "cam-3", _stamp(FROM), _stamp(TO), 500).select("id", "vehicle_id")


@query("SELECT 'e' || s_suppkey AS id, 'cam-' || (s_suppkey % 8) AS from_camera_id, 'cam-' || (s_nationkey % 8) AS to_camera_id FROM supplier WHERE s_acctbal > 0 AND s_nationkey % 8 = 4 ORDER BY 2, 3, 1 LIMIT 200")
def topology_list(spark, sf_dir):
    """Edges into a camera that are in use, in order of their ends."""
    edges = fx.table(spark, sf_dir, "supplier").selectExpr("concat('e', CAST(s_suppkey AS STRING)) AS id", "concat('cam-', CAST(s_suppkey % 8 AS STRING)) AS from_camera_id", "concat('cam-', CAST(s_nationkey % 8 AS STRING)) AS to_camera_id", "s_acctbal > 0 AS enabled")
    return topology.listed(edges, to_camera="cam-4", enabled_only=True).select("id", "from_camera_id", "to_camera_id")


@query("WITH {ve} SELECT id FROM ve WHERE status = 'CONFIRMED' AND model_version = 'v1' AND occurred_at >= TIMESTAMP '" + FROM + "' AND occurred_at < TIMESTAMP '" + TO + "'")
def dataset_samples(spark, sf_dir):
    """Samples by state and model, reviewed from a time up to before another."""
    rows = fx.events(spark, sf_dir).select("id", "status", "model_version", F.col("occurred_at").alias("reviewed_at"))
    return rows.where(events.matching({"status": "CONFIRMED", "model_version": "v1"}, at="reviewed_at", start=_stamp(FROM), end=_stamp(TO), half_open=True)).select("id")


_CHANGED = "coalesce(valid_from, valid_until, TIMESTAMP '2024-01-01')"


@query("WITH {wl} SELECT id FROM wl WHERE list_type = 'BLOCK' AND enabled ORDER BY " + _CHANGED + " DESC, id DESC LIMIT 20")
def watchlist_page(spark, sf_dir):
    """By type and state, the last changed first."""
    rows = fx.watchlist(spark, sf_dir).withColumn("updated_at", F.coalesce("valid_from", "valid_until", _stamp("2024-01-01")))
    return policy.list_watchlist(rows, "BLOCK", True, 20).select("id")


@query("WITH {wl} SELECT list_type, count(*) AS entries FROM wl WHERE contains(upper(plate), '1') OR contains(upper(id), '1') GROUP BY 1")
def watchlist_counts(spark, sf_dir):
    """What a search finds, by type."""
    return policy.counts_by_type(policy.search_watchlist(fx.watchlist(spark, sf_dir), "1"))


def _tracks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("track_id", F.concat("camera_id", F.lit(":"), (F.col("user_id") % 40).cast("string")))


_TRACK = "camera_id || ':' || (user_id % 40)"


@query("WITH {ve}, " + _PLATE_SQL + ", a AS (SELECT " + _TRACK + " AS track_id, event_id AS variant, ve.raw AS text, plate_confidence AS confidence, compact FROM ve JOIN w USING (id) WHERE plate_confidence >= 0.05 AND compact IS NOT NULL), z AS (SELECT *, max((confidence >= 0.3)::INT) OVER (PARTITION BY track_id ORDER BY variant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM a) SELECT track_id, arg_max(variant, (confidence, -variant)) AS variant, max(confidence) AS confidence, arg_max(compact, (confidence, -variant)) AS compact FROM z WHERE coalesce(done, 0) = 0 GROUP BY 1")
def accepted_readings(spark, sf_dir):
    """The best valid reading of each crop, up to the first that is sure enough."""
    attempts = _tracks(fx.events(spark, sf_dir)).select("track_id", F.col("event_id").alias("variant"), F.col("raw").alias("text"), F.col("plate_confidence").alias("confidence"))
    return voting.accepted_readings(attempts, ["track_id"], 0.05, 0.3).select("track_id", "variant", "confidence", "compact")


@query("WITH RECURSIVE {ve}, a AS (SELECT camera_id AS track_id, event_id AS frame_id, plate, row_number() OVER (PARTITION BY camera_id ORDER BY event_id) AS seen FROM ve), s AS (SELECT camera_id AS track_id, min(event_id) AS stable FROM (SELECT camera_id, event_id, count(*) OVER (PARTITION BY camera_id, plate ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM ve WHERE plate IS NOT NULL AND plate_confidence >= 0.05) WHERE n >= 9 GROUP BY 1), "
       "f AS (SELECT a.track_id, frame_id, seen FROM a LEFT JOIN s USING (track_id) WHERE plate IS NOT NULL AND (stable IS NULL OR frame_id <= stable)), g AS (SELECT track_id, min(frame_id) AS frame_id, min(seen) AS seen FROM f GROUP BY 1 UNION ALL SELECT f.track_id, min(f.frame_id), min(f.seen) FROM g JOIN f ON f.track_id = g.track_id AND f.seen >= g.seen + 5 GROUP BY f.track_id, g.frame_id) SELECT track_id, frame_id FROM g")
def due_readings(spark, sf_dir):
    """A try every five frames of a track that show a plate, until its reading is stable."""
    from pyspark.sql import Window

    rows = fx.events(spark, sf_dir).select(F.col("camera_id").alias("track_id"), F.col("event_id").alias("frame_id"), "plate", F.col("plate").alias("normalized"), F.lit(False).alias("partial"), F.col("plate_confidence").alias("ocr_confidence"), F.row_number().over(Window.partitionBy("camera_id").orderBy("event_id")).cast("long").alias("seen"))
    seen = rows.where("plate IS NOT NULL")
    return voting.due_frames(seen, 5, voting.stable_at(seen, 0.05, 9))


_ITEMS = "SELECT lpad(doc_id::VARCHAR, 9, '0') AS review_id, CASE WHEN n_chars % 3 = 0 THEN 'PENDING' ELSE 'DONE' END AS status, lang AS reason FROM documents"


@query("SELECT review_id, status, reason FROM (" + _ITEMS + ") WHERE status = 'PENDING' AND reason = 'en' AND review_id > '000000300' ORDER BY review_id LIMIT 41")
def review_queue(spark, sf_dir):
    """A page by review_id whose cursor holds for its filters alone."""
    items = fx.table(spark, sf_dir, "documents").selectExpr("lpad(CAST(doc_id AS STRING), 9, '0') AS review_id", "CASE WHEN n_chars % 3 = 0 THEN 'PENDING' ELSE 'DONE' END AS status", "lang AS reason")
    cursor = events.encode_bound("000000300", {"status": "PENDING", "reason": "en"})
    return annotations.review_queue(items, "PENDING", "en", 40, cursor)


@query("SELECT sample_id, lighting FROM (SELECT lpad(doc_id::VARCHAR, 9, '0') AS sample_id, upper(lang) AS lighting FROM documents WHERE n_chars % 5 = 0) WHERE lighting = 'DE' AND sample_id > '000000100' ORDER BY sample_id LIMIT 26")
def registry_page(spark, sf_dir):
    """T4: a page of a source's samples whose cursor is bound to the source's digest and the filters."""
    samples = fx.table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("sample_id"), F.col("lang").alias("lighting"), (F.col("n_chars") % 5).alias("annotation_count"))
    cursor = events.encode_bound("000000100", {"source": "s1", "digest": "d1", "kind": "NEGATIVE", "lighting": "de"})
    return annotations.sample_page(samples, "s1", "d1", "NEGATIVE", "de", 25, cursor).select("sample_id", "lighting")


@query("SELECT source AS source_id, row_number() OVER (ORDER BY max(doc_id) // 10 DESC, source DESC) AS place FROM documents GROUP BY 1")
def dataset_catalog(spark, sf_dir):
    """Dataset versions, the newest first."""
    versions = fx.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id")).agg(F.floor(F.max("doc_id") / 10).alias("created_at"))
    return datasets.catalog_order(versions)


@query("WITH {ve} SELECT vehicle_id, strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S.%f') AS occurred_at, arg_min(id, (occurred_at, id)) AS id FROM ve WHERE vehicle_id IS NOT NULL GROUP BY 1")
def distinct_vehicles(spark, sf_dir):
    """Each id once, where it first stands."""
    found = events.first_occurrences(fx.events(spark, sf_dir), "vehicle_id", ["occurred_at", "id"])
    return found.select("vehicle_id", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("occurred_at"), "id")


@query("WITH v AS (SELECT p_partkey AS video_id, (10 + p_size % 20)::DOUBLE AS fps, p_size * 7 AS n FROM part), s AS (SELECT video_id, n, fps, k * 0.06 AS seconds, ceil(round(k * 0.06 * fps, 6))::BIGINT AS frame_index FROM v, range(2000) r(k) WHERE k * 0.06 * fps < n) SELECT video_id, frame_index, round(min(seconds), 6)::DOUBLE AS offset_seconds FROM s WHERE frame_index < n GROUP BY 1, 2")
def seek_samples(spark, sf_dir):
    """Seeks at a fixed interval; those that land on a frame again are left out."""
    videos = fx.table(spark, sf_dir, "part").selectExpr("p_partkey AS video_id", "CAST(10 + p_size % 20 AS DOUBLE) AS fps", "p_size * 7 AS frame_count")
    return annotations.seek_samples(videos, 0.06).withColumn("offset_seconds", F.round("offset_seconds", 6))


def _colliding(rows: DataFrame) -> DataFrame:
    """Pairs of events share an id, and many share camera, track and type."""
    return rows.select(F.concat(F.lit("k"), F.floor(F.col("event_id") / 2).cast("string")).alias("id"), "camera_id", (F.col("event_id") % 997 + F.col("event_id") % 3).alias("track_id"), "event_type", "event_id")


_OPEN = "n{i} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY camera_id, track_id, event_type ORDER BY event_id) AS b FROM r{i}), s{i} AS (SELECT * FROM n{i} WHERE a = 1 AND b = 1), r{j} AS (SELECT id, camera_id, track_id, event_type, event_id FROM n{i} WHERE id NOT IN (SELECT id FROM s{i}) AND (camera_id, track_id, event_type) NOT IN (SELECT (camera_id, track_id, event_type) FROM s{i}))"
_ROUNDS = 8


_FIRST = ("WITH {ve}, r0 AS (SELECT 'k' || (event_id // 2) AS id, camera_id, event_id % 997 + event_id % 3 AS track_id, event_type, event_id FROM ve), "
          + ", ".join(_OPEN.format(i=i, j=i + 1) for i in range(_ROUNDS)))


@query(_FIRST + " " + " UNION ALL ".join(f"SELECT id, event_id FROM s{i}" for i in range(_ROUNDS)))
def first_writes(spark, sf_dir):
    """The first write of either key wins."""
    rows = _colliding(fx.events(spark, sf_dir))
    return events.insert_if_absent(rows.limit(0), rows, "id", ["camera_id", "track_id", "event_type"], ["event_id"]).select("id", "event_id")


@query("SELECT count(*) AS messages, count(*) FILTER (event_id % 17 = 0) AS rejected FROM events")
def worker_counters(spark, sf_dir):
    """What a worker counts, as observed metrics of its scan."""
    from pyspark.sql import Observation

    rows = fx.events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 17 != 0, F.to_json(F.struct("id"))).otherwise("broken").alias("value"))
    seen = Observation("worker")
    rows.withColumn("_m", F.from_json("value", "id STRING")).observe(seen, F.count("*").alias("messages"), F.count_if(F.col("_m.id").isNull()).alias("rejected")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["messages"], seen.get["rejected"])], "messages long, rejected long")


@query("SELECT o_orderpriority AS action, count(*) AS entries FROM orders WHERE o_orderkey % 10 < 2 GROUP BY 1")
def audit_sink(spark, sf_dir):
    """Two appends to a log that is read back."""
    entries = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("action"), "o_orderkey")
    path = new_path(spark, "audit")
    for n in (0, 1):
        files.append_audit(entries.where(F.col("o_orderkey") % 10 == n).drop("o_orderkey"), path)
    return spark.read.schema("id STRING, action STRING").json(path).groupBy("action").agg(F.count("*").alias("entries"))


_REPORT = "SELECT o_orderkey::VARCHAR AS file, CASE o_orderkey % 3 WHEN 0 THEN 'edge-capacity-benchmark' WHEN 1 THEN 'other' ELSE 'detector-runtime-benchmark' END AS kind, CASE WHEN o_custkey % 5 <> 0 THEN sha256(o_orderkey::VARCHAR) ELSE 'x' END AS sha, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 11 END AS n, o_totalprice / 1000 - 5 AS p95, CASE WHEN o_custkey % 4 <> 0 THEN (o_custkey % 30) / 20.0 - 0.1 END AS dropped, o_custkey % 6 <> 0 AS passed FROM orders"


@query("WITH r AS (" + _REPORT + "), f AS (SELECT file, unnest([CASE WHEN sha = 'x' THEN 'invalid_model_hash' END, CASE WHEN n IS NULL OR n <= 0 THEN 'missing_latency_samples' END, CASE WHEN p95 < 0 THEN 'invalid_p95_latency' END, CASE WHEN kind LIKE 'edge%' AND dropped IS NULL THEN 'missing_drop_ratio' END, CASE WHEN kind LIKE 'edge%' AND (dropped < 0 OR dropped > 1) THEN 'invalid_drop_ratio' END, CASE WHEN kind LIKE 'edge%' AND dropped > 0.1 AND dropped <= 1 THEN 'drop_ratio_exceeds_limit' END, CASE WHEN kind LIKE 'edge%' AND p95 > 250 THEN 'p95_latency_exceeds_limit' END, CASE WHEN NOT passed THEN 'gate_failed' END]) AS failure FROM r) SELECT file, failure FROM f WHERE failure IS NOT NULL UNION ALL SELECT NULL, 'missing_accuracy_representative_detector_gate'")
def performance_gates(spark, sf_dir):
    """M5: what benchmark reports fail by, and what no report shows."""
    kind = "CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'edge-capacity-benchmark' WHEN 1 THEN 'other' ELSE 'detector-runtime-benchmark' END AS kind"
    reports = fx.table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS file", kind, "CASE WHEN o_custkey % 5 <> 0 THEN sha2(CAST(o_orderkey AS STRING), 256) ELSE 'x' END AS model_sha256", "CAST(CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 11 END AS DOUBLE) AS latency_count", "o_totalprice / 1000 - 5 AS p95_ms", "CASE WHEN o_custkey % 4 <> 0 THEN CAST((o_custkey % 30) / 20.0 - 0.1 AS DOUBLE) END AS drop_ratio", "o_custkey % 6 <> 0 AS gate_passed", "false AS accuracy_representative")
    return stats.verify_gates(reports)


@query("WITH l AS (SELECT doc_id AS line, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE 's' || (doc_id % 700) END AS s, doc_id % 29 = 0 AS broken FROM documents), g AS (SELECT *, s IS NULL OR broken AS bad FROM l) SELECT line, CASE WHEN bad THEN 'INVALID' ELSE 'DUPLICATE' END AS problem FROM (SELECT *, min(CASE WHEN NOT bad THEN line END) OVER (PARTITION BY s) AS first FROM g) WHERE bad OR line > first")
def annotation_scan(spark, sf_dir):
    """Lines of annotations that keep a dataset from being built."""
    d = fx.table(spark, sf_dir, "documents")
    text = F.to_json(F.struct(F.when(F.col("doc_id") % 31 != 0, F.concat(F.lit("s"), (F.col("doc_id") % 700).cast("string"))).alias("sampleId"), F.lit("a.jpg").alias("imagePath"), F.col("source").alias("groupId")))
    lines = d.select(F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 29 == 0, "{broken").otherwise(text).alias("value"))
    return files.scan_samples(lines).where("problem IS NOT NULL").select("line", "problem")


def _detector_samples(spark, sf_dir) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").withColumn("group_id", F.col("source"))
    box = F.struct(F.col("lang").alias("class_name"), F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("bbox"))
    boxes = F.slice(F.array(box, box), 1, (F.col("n_chars") % 3).cast("int"))
    return datasets.split_by_group(d.select(F.col("doc_id").cast("string").alias("sample_id"), "group_id", F.col("lang").alias("camera_id"), boxes.alias("annotations")), "group_id", "7")


@query("SELECT split, count(*) AS images, sum(n_chars % 3)::BIGINT AS annotations, count(*) FILTER (n_chars % 3 = 0) AS negatives, count(DISTINCT source) AS group_count, 0 AS problems FROM (SELECT *, CASE WHEN s < 0.8 THEN 'train' WHEN s < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, (('0x' || substr(sha256('7:' || source), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0 AS s FROM documents)) GROUP BY 1")
def coco_export(spark, sf_dir):
    """A dataset written, verified and its manifest."""
    path = new_path(spark, "dataset")
    classes = ["de", "en", "es", "fr"]
    manifest = files.export_coco(_detector_samples(spark, sf_dir), classes, path)
    problems = files.verify_coco(spark, path, classes).count()
    return manifest.select("split", "images", "annotations", "negatives", "group_count", F.lit(problems).cast("int").alias("problems"))


@query("WITH s AS (SELECT doc_id, text AS label, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) SELECT split, count(*) AS samples, 0 AS differences FROM s GROUP BY 1")
def label_export(spark, sf_dir):
    """Labels written by split, and read again against the manifest."""
    samples = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("label"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    path = new_path(spark, "labels")
    manifest = files.export_labels(samples, path)
    differences = files.verify_export(spark, path, "id STRING, label STRING", manifest).count()
    return manifest.select("split", "samples", F.lit(differences).cast("int").alias("differences"))


_SHIFTED = "CASE WHEN l_linenumber = 3 THEN 0.02 ELSE 0.004 END"


@query("SELECT l_orderkey AS review_id, bool_and(" + _SHIFTED + " <= 0.01) AND count(*) > 0 AND NOT bool_or(l_returnflag = 'A') AS same FROM lineitem GROUP BY 1")
def unchanged_suggestions(spark, sf_dir):
    """Reviews whose boxes are the suggestions, place by place and within a hundredth."""
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS review_id", "l_returnflag", "struct(l_linenumber AS n, array(1D, 2D, 3D, 4D) AS s, array(1D, 2D + " + _SHIFTED + ", 3D, 4D) AS b) AS x")
    some = rows.groupBy("review_id").agg(F.sort_array(F.collect_list("x")).alias("x"), F.sort_array(F.collect_list(F.when(F.col("l_returnflag") != "A", F.col("x")))).alias("y"))
    return some.select("review_id", annotations.same_boxes(F.transform("y", lambda v: v["b"]), F.transform("x", lambda v: v["s"])).alias("same"))


@query("WITH {ve}, l AS (SELECT vehicle_id, arg_max(id, (occurred_at, id)) AS latest_event, arg_max(camera_id, (occurred_at, id)) AS camera_id FROM ve WHERE vehicle_id IS NOT NULL AND event_id % 3 = 0 GROUP BY 1), i AS (SELECT vehicle_id, count(*) AS observation_count FROM ve WHERE vehicle_id IS NOT NULL GROUP BY 1) SELECT vehicle_id, observation_count, latest_event, camera_id FROM i LEFT JOIN l USING (vehicle_id)")
def identities_with_latest(spark, sf_dir):
    """Identities and their latest event, where one is kept."""
    rows = fx.events(spark, sf_dir).where("vehicle_id IS NOT NULL")
    return identity.with_latest(identity.rebuild(rows), rows.where("event_id % 3 = 0")).select("vehicle_id", "observation_count", "latest_event", "camera_id")


@query("WITH {ve}, h AS (SELECT camera_id, max(event_id) AS e FROM ve WHERE camera_id <> 'cam-6' GROUP BY 1) SELECT (SELECT count(*) FROM ve) AS total, (SELECT count(*) FROM ve WHERE direction = 'ENTER') AS entries, (SELECT count(*) FROM ve WHERE direction = 'EXIT') AS exits, (SELECT count(*) FROM ve WHERE coalesce(plate_final, plate) IS NULL) AS no_plate, count(*) FILTER (e % 2 = 0) AS online, count(*) FILTER (e % 2 <> 0) AS offline, sum(e % 100)::BIGINT AS dropped_frames, sum(e % 7)::BIGINT AS reconnects FROM h")
def console_dashboard(spark, sf_dir):
    """Totals beside the cameras' health; a camera without a report is neither on nor off line."""
    rows = fx.events(spark, sf_dir)
    reports = rows.where("camera_id <> 'cam-6'").selectExpr("camera_id", "event_id AS updated_at", "CASE WHEN event_id % 2 = 0 THEN 'ONLINE' ELSE 'OFFLINE' END AS status", "event_id % 100 AS dropped_frames", "event_id % 7 AS reconnects")
    return events.dashboard(rows, state.latest_health(reports))


@query("WITH {ve} SELECT id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f') AS occurred_at FROM (SELECT id, min(occurred_at) AS occurred_at FROM (SELECT 'k' || (event_id // 3) AS id, occurred_at FROM ve) GROUP BY 1) e ORDER BY e.occurred_at DESC, id DESC LIMIT 100")
def replayed_ids(spark, sf_dir):
    """U8: a replay without repeats, within a bounded history."""
    rows = fx.events(spark, sf_dir).select(F.concat(F.lit("k"), F.floor(F.col("event_id") / 3).cast("string")).alias("id"), "occurred_at")
    return state.recent_ids(rows, "id", "occurred_at", 100).select("id", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("occurred_at"))


@query("WITH {ve} SELECT vehicle_id FROM ve WHERE vehicle_id IS NOT NULL AND plate IS NOT NULL AND plate_confidence IS NOT NULL AND substr(plate, 3, 1) = 'B' GROUP BY 1")
def identities_by_plate(spark, sf_dir):
    """P10: identities that have a plate among their signals."""
    found = identity.rebuild(fx.events(spark, sf_dir).where("vehicle_id IS NOT NULL"))
    wanted = fx.events(spark, sf_dir).where("plate IS NOT NULL AND substr(plate, 3, 1) = 'B'").select("plate").distinct()
    return identity.having_plates(found, wanted).select("vehicle_id")


@query("SELECT doc_id, CASE WHEN (n_chars % 100) / 100.0 < 0.28 THEN 'NIGHT' ELSE 'DAY' END AS lighting FROM documents")
def image_lighting(spark, sf_dir):
    """P25."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", annotations.lighting(F.col("n_chars") % 100 / 100).alias("lighting"))


@query("SELECT l_orderkey AS image, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'car' ELSE 'plate' END AS class_name FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND l_linenumber % 3 <> 0 AND l_discount < 0.08")
def usable_boxes(spark, sf_dir):
    """Rows of known labels that are no group, depiction or inside view."""
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS image", "l_linenumber AS line", "l_returnflag AS LabelName", "l_linestatus <> 'F' AS IsGroupOf", "l_linenumber % 3 = 0 AS IsDepiction", "l_discount >= 0.08 AS IsInside")
    return files.usable_boxes(rows, {"A": "car", "R": "plate"}).select("image", "line", "class_name")


@query("SELECT lang AS class_name, count(*) AS annotations FROM documents WHERE lang NOT IN ('de', 'fr') GROUP BY 1")
def unknown_classes(spark, sf_dir):
    """Annotations of classes that no category has."""
    rows = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("class_name"))
    return datasets.unknown_classes(rows, spark.createDataFrame([("de",), ("fr",)], "name string")).groupBy("class_name").agg(F.count("*").alias("annotations"))


@query("SELECT lang, count(*) AS samples, count(group_id) AS grouped FROM (SELECT lang, source AS group_id FROM documents UNION ALL SELECT 'page', NULL FROM pages) GROUP BY 1")
def united_sources(spark, sf_dir):
    """Several corpora as one, by column name."""
    one = fx.table(spark, sf_dir, "documents").select("lang", F.col("source").alias("group_id"))
    both = datasets.union_sources(one, fx.table(spark, sf_dir, "pages").select(F.lit("page").alias("lang")))
    return both.groupBy("lang").agg(F.count("*").alias("samples"), F.count("group_id").alias("grouped"))


def _observed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _tracks(fx.events(spark, sf_dir))
    read = plates.add_normalized(rows.where("plate IS NOT NULL"), "raw", "p", True)
    return rows, read.select("track_id", F.col("event_id").alias("frame_id"), "raw", "p.compact", "p.normalized", "p.partial", F.greatest(F.lit(0.05), "plate_confidence").alias("ocr_confidence"), F.lit(0.9).alias("quality_score"), F.col("vehicle_confidence").cast("double").alias("detection_confidence"))


_EVENT_NAME = "unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(track_id || '|' || event_type || '|' || strftime(last_seen, '%Y-%m-%dT%H:%M:%S.%fZ'))"


@query(vote_sql(_TRACK) + ", k AS (SELECT " + _TRACK + " AS track_id, camera_id, max(occurred_at) AS last_seen, count(*) AS frames, count(plate) AS plates FROM ve GROUP BY 1, 2), sides AS (SELECT " + _TRACK + " AS track_id, event_id, (event_id % 7)::DOUBLE - 3 AS side, row_number() OVER (PARTITION BY " + _TRACK + " ORDER BY event_id) AS r FROM ve), "
       "turns AS (SELECT *, last_value(CASE WHEN side <> 0 OR r = 1 THEN side END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM sides), "
       "ways AS (SELECT track_id, coalesce(arg_min(CASE WHEN prev > 0 THEN 'ENTER' ELSE 'EXIT' END, event_id) FILTER ((prev > 0 AND side <= 0) OR (prev < 0 AND side >= 0)), 'UNKNOWN') AS direction FROM turns GROUP BY 1), "
       "e AS (SELECT *, CASE direction WHEN 'ENTER' THEN 'VEHICLE_ENTER' WHEN 'EXIT' THEN 'VEHICLE_EXIT' ELSE 'VEHICLE_DETECTED' END AS event_type FROM k JOIN ways USING (track_id) LEFT JOIN voted USING (track_id)), h AS (SELECT *, sha1(" + _EVENT_NAME + ") AS x FROM e) "
       "SELECT track_id, camera_id, direction, event_type, CASE WHEN normalized IS NULL THEN CASE WHEN plates = 0 THEN 'NO_PLATE' ELSE 'UNREADABLE' END WHEN partial THEN 'NEEDS_REVIEW' WHEN confidence >= 0.85 THEN 'CONFIRMED' WHEN confidence >= 0.75 THEN 'NEEDS_REVIEW' ELSE 'LOW_CONFIDENCE' END AS status, normalized AS plate, frames, plates AS plate_detections, 'evt_' || substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', (('0x' || substr(x, 17, 1))::INT % 4) + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS id FROM h")
def finalized_events(spark, sf_dir):
    """ST6: the event of each track: direction, type, vote, status and id in one composition."""
    rows, read = _observed(spark, sf_dir)
    tracks = rows.groupBy("track_id", "camera_id").agg(F.max("occurred_at").alias("last_seen"), F.max("vehicle_confidence").cast("double").alias("vehicle_confidence"), F.max_by("vehicle_type", "event_id").alias("vehicle_type"), F.count("*").alias("frames"), F.count("plate").alias("plate_detections"))
    points = rows.selectExpr("track_id", "event_id AS frame_id", "0D AS x", "CAST(event_id % 7 AS DOUBLE) - 3 AS y")
    found = voting.finalize(tracks, points, read, ((0.0, 0.0), (1.0, 0.0)))
    return found.withColumn("plate", F.col("plate.normalized")).select("track_id", "camera_id", "direction", "event_type", "status", "plate", "frames", "plate_detections", "id")


@query("SELECT count(*) AS lines, sum(('0x' || substr(sha256(text), 1, 15))::BIGINT)::HUGEINT::VARCHAR AS digest FROM documents")
def annotation_digest(spark, sf_dir):
    """The digest of a file's lines, which a manifest keeps."""
    return files.digest_of_lines(fx.table(spark, sf_dir, "documents").select(F.col("text").alias("value")))


@query("WITH {ve} SELECT camera_id AS track_id, arg_max(event_id, (round(s), -event_id)) AS frame_id, max(round(s)) AS score FROM (SELECT *, 100 * greatest(0.0, least(1.0, (vehicle_confidence * 0.5 + least(1.0, value / 600) * 0.3 + (user_id % 10) / 10.0 * 0.2) / 1.0)) AS s FROM ve) GROUP BY 1")
def weighted_frames(spark, sf_dir):
    """The best frame of each track by the weighted mean of its scores."""
    rows = fx.events(spark, sf_dir)
    score = annotations.weighted_score([(F.col("vehicle_confidence").cast("double"), 0.5), (F.least(F.lit(1.0), F.col("value") / 600), 0.3), (F.col("user_id") % 10 / 10, 0.2)])
    return voting.best_frame(rows.select(F.col("camera_id").alias("track_id"), F.col("event_id").alias("frame_id"), F.round(score * 100).alias("score")))


def _event_documents(spark, sf_dir) -> DataFrame:
    e = fx.events(spark, sf_dir)
    plate = F.struct(F.col("plate").alias("normalized"), F.col("plate_confidence").alias("confidence"))
    return e.select(F.col("id").alias("_id"), F.lit(1).alias("schemaVersion"), F.struct(F.col("camera_id").alias("id")).alias("camera"), F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string")).alias("trackId"), F.col("vehicle_id").alias("vehicleId"), F.col("event_type").alias("eventType"), "direction", "status", plate.alias("plate"), F.col("occurred_at").cast("timestamp").alias("occurredAt"))


@query("WITH {ve} SELECT camera_id, event_type, count(*) AS events, count(plate) AS plates FROM ve GROUP BY 1, 2")
def event_log(spark, sf_dir):
    """S3: events appended to a log in two writes, read again and flattened."""
    path, documents = new_path(spark, "log"), _event_documents(spark, sf_dir)
    for direction in ("ENTER", "other"):
        files.write_event_log(documents.where((F.col("direction") == "ENTER") == F.lit(direction == "ENTER")), path)
    return files.flatten_events(files.read_event_log(spark, path)).groupBy("camera_id", "event_type").agg(F.count("*").alias("events"), F.count("plate").alias("plates"))


@query("WITH {ve}, t AS (SELECT id, camera_id, 't' || (user_id % 40) AS track_id, event_type, occurred_at FROM ve) SELECT id, camera_id, track_id, event_type FROM t QUALIFY row_number() OVER (PARTITION BY camera_id, track_id, event_type ORDER BY date_trunc('milliseconds', occurred_at), id) = 1")
def stored_events(spark, sf_dir):
    """S6, S7, S22, ST7, ST8: what the worker stores of a stream of messages, a tenth of them twice and one broken."""
    from platehouse.streaming import worker

    folder, messages = new_path(spark, "worker"), files.encode_envelope(_event_documents(spark, sf_dir))
    messages = messages.union(messages.where(F.crc32(F.col("value").cast("binary")) % 10 == 0)).union(spark.createDataFrame([("broken",)], "value string"))
    messages.write.text(f"{folder}/in")
    worker.start(spark.readStream.schema("value string").text(f"{folder}/in"), f"{folder}/store", f"{folder}/rejects", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/store").select("id", "camera_id", "track_id", "event_type")


_CENTRE = "round(l_discount * 8, 6)::DOUBLE AS cx, round(l_tax * 10, 6)::DOUBLE AS cy, round(l_quantity / 100, 6)::DOUBLE AS w, round(l_quantity / 50, 6)::DOUBLE AS h"


@query("SELECT id, class_id, round(greatest(0.0, cx - w / 2) * 200, 6) AS x, round(greatest(0.0, cy - h / 2) * 100, 6) AS y, round((least(1.0, cx + w / 2) - greatest(0.0, cx - w / 2)) * 200, 6) AS width, round((least(1.0, cy + h / 2) - greatest(0.0, cy - h / 2)) * 100, 6) AS height FROM (SELECT " + fx.TRUTHS["id"] + " AS id, l_linenumber AS class_id, " + _CENTRE + " FROM lineitem)")
def box_labels(spark, sf_dir):
    """Label lines of centre boxes as boxes in pixels."""
    numbers = [F.round(c, 6).cast("double").cast("string") for c in (F.col("l_discount") * 8, F.col("l_tax") * 10, F.col("l_quantity") / 100, F.col("l_quantity") / 50)]
    rows = fx.table(spark, sf_dir, "lineitem").withColumn("id", F.expr(fx.TRUTHS["id"]))
    lines = rows.select(F.col("id").cast("string").alias("source"), F.lit(1).alias("line"), F.concat_ws(" ", F.col("l_linenumber").cast("string"), *numbers).alias("value"))
    boxes = files.parse_yolo_boxes(lines, F.lit(200.0), F.lit(100.0))
    return boxes.select(F.col("source").cast("long").alias("id"), "class_id", *[F.round(F.col("bbox")[i], 6).alias(n) for i, n in enumerate(("x", "y", "width", "height"))])


@query("SELECT " + fx.TRUTHS["id"] + " AS id, CASE WHEN l_orderkey % 10 = 0 THEN 'UNKNOWN_IMAGE' WHEN l_linenumber > 5 THEN 'UNKNOWN_CATEGORY' ELSE 'INVALID_BOX' END AS problem FROM lineitem WHERE l_orderkey % 10 = 0 OR l_linenumber > 5 OR l_quantity <= 5")
def annotation_problems(spark, sf_dir):
    """Annotations of a COCO file without an image or category, or with a box that is none."""
    lines = fx.table(spark, sf_dir, "lineitem").selectExpr(fx.TRUTHS["id"] + " AS id", "l_orderkey AS image_id", "CAST(l_linenumber AS BIGINT) AS category_id", "array(1D, 1D, CAST(l_quantity - 5 AS DOUBLE), 2D) AS bbox")
    images = fx.table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"))
    return files.broken_references(lines, images, spark.range(1, 6))


@query("SELECT split FROM (VALUES ('de'), ('en'), ('it'), ('xx')) v(split) WHERE split NOT IN (SELECT lang FROM documents)")
def missing_splits(spark, sf_dir):
    """Required splits that have no sample."""
    return datasets.missing_splits(fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("split")), ["de", "en", "it", "xx"])
