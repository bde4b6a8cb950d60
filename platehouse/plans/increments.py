"""Registered queries of stored partial states, tracking, digests, logs that are rewritten, reviews and track streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platehouse.functions import plates
from platehouse.functions.grouping import parts_for
from platehouse.functions.scratch import new_path
from platehouse.operators import annotations, datasets, evaluation, identity, quality, reid, tracking
from platehouse.plans import fixtures as fx
from platehouse.plans.catalog import _PLATE_SQL
from platehouse.plans.evaluations import _COMMON, _matched, _matches, _truths
from platehouse.plans.records import _event_documents
from platehouse.plans.registry import query
from platehouse.sources import eventlog, files
from platehouse.streaming import tracks

_COUNTS = "count(*) AS events, count(plate) AS readable, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (status = 'NO_PLATE') AS no_plate, count(*) FILTER (status = 'UNREADABLE') AS unreadable, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (corrected) AS corrected"


@query("WITH {ve}, s AS (SELECT camera_id, " + _COUNTS + ", round(sum(plate_confidence::DECIMAL(20,9))::DOUBLE / count(plate_confidence), 9) AS average_confidence FROM ve GROUP BY 1) SELECT *, readable / events AS success_rate, (no_plate + unreadable) / events AS unknown_rate, CASE WHEN reviewed = 0 THEN 0 ELSE corrected / reviewed END AS correction_rate, (SELECT count(*) FROM ve) > 5000 AS truncated FROM s")
def quality_increments(spark, sf_dir):
    """A4: partial states of three increments, one stored twice, merged by camera."""
    path, rows = new_path(spark, "quality"), fx.events(spark, sf_dir)
    for number in (0, 1, 2, 1):
        quality.add_increment(rows.where(F.col("event_id") % 3 == number), path, number)
    found = quality.merged(quality.read_states(spark, path), ["camera_id"], 5000)
    return found.withColumn("average_confidence", F.round("average_confidence", 9))


_TRACKED = "CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 99 END"


@query("WITH d AS (SELECT l_orderkey AS frame_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + fx.TRUTHS["id"] + ") - 1 AS i, (l_partkey % 40)::DOUBLE * 9 + l_quantity / 2 AS x, (l_suppkey % 10)::DOUBLE * 9 AS y FROM lineitem WHERE l_linenumber <> 4), t AS (SELECT l_orderkey AS frame_id, " + fx.TRUTHS["id"] + " AS track_id, CASE WHEN l_linenumber % 3 = 0 THEN 1 WHEN l_linenumber % 3 = 1 THEN 99 END AS named, (l_partkey % 37)::DOUBLE * 9 AS x, (l_suppkey % 7)::DOUBLE * 9 AS y FROM lineitem), "
       "m AS (SELECT t.frame_id, t.track_id, arg_min(d.i, ((t.x - d.x) * (t.x - d.x) + (t.y - d.y) * (t.y - d.y), d.i)) AS nearest, max(CASE WHEN d.i = t.named THEN d.i END) AS named FROM t LEFT JOIN d USING (frame_id) GROUP BY 1, 2) SELECT frame_id, track_id, coalesce(named, nearest) AS detection_index, CASE WHEN named IS NOT NULL THEN 'INDEX' WHEN nearest IS NOT NULL THEN 'NEAREST' END AS by FROM m")
def tracker_resolution(spark, sf_dir):
    """Each track's detection, by the index that the tracker names or else the nearest centre."""
    from pyspark.sql import Window

    lines = fx.table(spark, sf_dir, "lineitem").withColumn("id", F.expr(fx.TRUTHS["id"]))
    place = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("id")) - 1).cast("long")
    found = lines.where("l_linenumber <> 4").select(F.col("l_orderkey").alias("frame_id"), place.alias("detection_index"), F.expr("array(CAST(l_partkey % 40 AS DOUBLE) * 9, CAST(l_suppkey % 10 AS DOUBLE) * 9 - 1, l_quantity, 2D)").alias("bbox"))
    boxes = lines.select(F.col("l_orderkey").alias("frame_id"), F.col("id").alias("track_id"), F.expr(f"CAST({_TRACKED} AS BIGINT)").alias("index"), F.expr("array(CAST(l_partkey % 37 AS DOUBLE) * 9 - 1, CAST(l_suppkey % 7 AS DOUBLE) * 9 - 1, 2D, 2D)").alias("bbox"))
    return tracking.resolve(boxes, found)


@query("SELECT source, count(*) AS lines, sum(('0x' || substr(sha256(doc_id::VARCHAR || ':' || coalesce(text, '')), 1, 15))::BIGINT)::HUGEINT::VARCHAR AS digest FROM documents GROUP BY 1")
def ordered_digests(spark, sf_dir):
    """Of each file its lines' digest, in which the order counts."""
    return files.ordered_digest(fx.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("line"), F.col("text").alias("value")), ["source"])


@query("SELECT lang, octet_length(encode(t))::BIGINT AS length, sha256(t) AS sha256 FROM (SELECT lang, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY 1)")
def file_inventory(spark, sf_dir):
    """The files of a folder by size and content digest."""
    path = new_path(spark, "inventory")
    rows = fx.table(spark, sf_dir, "documents").select("lang", "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    n = parts_for(spark, rows.count(), 10_000)  # a language is many parts, each a range of documents
    rows.repartitionByRange(n, "lang", "doc_id").sortWithinPartitions("lang", "doc_id").select("lang", "value").write.partitionBy("lang").text(path)
    return files.inventory(spark, path, F.regexp_extract("path", "lang=([^/]+)/", 1)).select(F.col("path").alias("lang"), "length", "sha256")


@query("WITH {ve} SELECT camera_id, CASE WHEN event_id % 10 = 0 THEN 'CONFIRMED' ELSE status END AS status, count(*) AS events, count(*) FILTER (event_id % 10 = 0) AS reviewed, 1 AS parts FROM ve GROUP BY 1, 2")
def event_log_updates(spark, sf_dir):
    """S3: events, some of them updated twice and out of order, and a log that reads the same once compacted."""
    path, rows = new_path(spark, "log"), _event_documents(spark, sf_dir).withColumn("_n", F.substring("_id", 5, 8).cast("int"))
    review = lambda n: F.col("plate").withField("review", F.struct(F.lit("X").alias("normalized"), F.lit(n).alias("revision")))
    some = rows.where("_n % 10 = 0")
    eventlog.add(rows.drop("_n"), path)
    eventlog.add(some.withColumn("plate", review(2)).withColumn("status", F.lit("CONFIRMED")).drop("_n"), path)
    eventlog.add(some.withColumn("plate", review(1)).withColumn("status", F.lit("NEEDS_REVIEW")).drop("_n"), path)
    eventlog.compact(spark, path)
    now = eventlog.read(spark, path)
    return now.groupBy(F.col("camera.id").alias("camera_id"), "status").agg(F.count("*").alias("events"), F.count_if(F.col("plate.review.revision") == 2).alias("reviewed")).withColumn("parts", F.lit(len(eventlog.parts(path))))


@query(_matches((0.5,)) + "SELECT truths, covered, covered / truths AS full_bbox_coverage FROM (SELECT count(*) AS truths FROM t), (SELECT count(*) FILTER (" + _COMMON.format(a="p", b="t") + " / (t.w * t.h) >= 0.95) AS covered FROM m JOIN p ON p.id = m.id JOIN t ON t.id = m.truth)")
def detector_coverage(spark, sf_dir):
    """Truths that their match covers almost whole."""
    return evaluation.full_coverage(_matched(spark, sf_dir), _truths(spark, sf_dir), fx.boxes(spark, sf_dir, fx.PREDICTED))


_VOTERS = "(l_linenumber % 2)::DOUBLE * 100 + (l_suppkey % 3)::DOUBLE / 10"


@query("SELECT l_orderkey AS image_id, min(l_linenumber)::BIGINT AS id, count(*) AS votes, round(median(" + _VOTERS + "), 6) AS x, round(median((l_partkey % 2)::DOUBLE / 10), 6) AS y, 10.0::DOUBLE AS w, 6.0::DOUBLE AS h FROM lineitem GROUP BY l_orderkey, l_linenumber % 2, l_returnflag")
def annotation_consensus(spark, sf_dir):
    """Several annotators' boxes as one each, by layout and overlap."""
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS image_id", "CAST(l_linenumber AS BIGINT) AS id", "l_returnflag AS layout", "CAST(l_linenumber % 2 AS DOUBLE) * 100 + CAST(l_suppkey % 3 AS DOUBLE) / 10 AS x", "CAST(l_partkey % 2 AS DOUBLE) / 10 AS y")
    corner = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    found = annotations.consensus(rows.select("image_id", "id", "layout", F.array(F.col("x"), F.col("y"), F.lit(10.0), F.lit(6.0)).alias("bbox"), F.array(corner(0.0, 0.0), corner(10.0, 0.0), corner(10.0, 6.0), corner(0.0, 6.0)).alias("polygon")))
    return found.select("image_id", "id", F.col("votes").cast("long").alias("votes"), *[F.round(F.col("bbox")[i], 6).alias(n) for i, n in enumerate("xywh")])


@query("WITH q AS (SELECT vec_id AS query_id, vec_id % 3 AS model, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings WHERE vec_id % 100 < 3), s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(a, list_transform(embedding, lambda x: x::DOUBLE)) AS score FROM q JOIN embeddings ON vec_id <> query_id AND vec_id % 3 = model) SELECT query_id, id, round(score, 6) AS score, n - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS n FROM s WHERE score >= 0.1) WHERE n <= 5")
def vector_search_by_model(spark, sf_dir):
    """Vectors of three models, each compared with its own alone; the stated queries against all rows."""
    v = fx.table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "concat('m:', CAST(vec_id % 3 AS STRING)) AS model", "embedding AS values")
    return reid.nearest(v.where("id % 100 < 3"), v, 0.1, 5).withColumn("score", F.round("score", 6))


@query("SELECT l_orderkey AS image, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'car' ELSE 'plate' END AS class_name FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND l_linenumber % 3 <> 0 AND l_discount < 0.08")
def csv_boxes(spark, sf_dir):
    """Boxes written to CSV files with a header and read by their stated schema."""
    path = new_path(spark, "boxes")
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS image", "l_linenumber AS line", "l_returnflag AS LabelName", "CAST(l_linestatus <> 'F' AS INT) AS IsGroupOf", "CAST(l_linenumber % 3 = 0 AS INT) AS IsDepiction", "CAST(l_discount >= 0.08 AS INT) AS IsInside")
    rows.write.option("header", True).csv(path)
    read = files.read_csv(spark, path, "image LONG, line INT, LabelName STRING, IsGroupOf INT, IsDepiction INT, IsInside INT")
    return files.usable_boxes(read, {"A": "car", "R": "plate"}).select("image", "line", "class_name")


_FORM = "CASE WHEN compact IS NOT NULL THEN substr(compact, 1, 2 + series) || '-' || CASE WHEN length(compact) - 2 - series = 5 THEN substr(compact, 3 + series, 3) || '.' || substr(compact, 6 + series) ELSE substr(compact, 3 + series) END END"


@query("WITH RECURSIVE {ve}, " + _PLATE_SQL + ", f AS (SELECT id, " + _FORM + " AS text FROM w), e AS (SELECT id, plate IS NOT NULL AS seen, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS revision, CASE WHEN event_id % 4 = 0 THEN 'OLD' END AS final, event_id FROM ve WHERE event_id % 5 <> 0), "
       "k AS (SELECT v.id AS event_id, v.event_id * 4 + i AS seq, f.text, CASE WHEN i = 3 THEN i - 2 ELSE i END AS expected FROM ve v JOIN f USING (id), range(4) r(i) WHERE v.event_id % 2 = 0), q AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq) AS n FROM k), "
       "y AS (SELECT DISTINCT q.event_id, 0::BIGINT AS n, NULL::VARCHAR AS outcome, e.revision, e.final, e.seen, e.id IS NOT NULL AS known FROM q LEFT JOIN e ON e.id = q.event_id), "
       "z AS (SELECT * FROM y UNION ALL SELECT event_id, n, outcome, CASE WHEN outcome = 'CHANGED' THEN revision + 1 ELSE revision END, CASE WHEN outcome = 'CHANGED' THEN text ELSE final END, seen, known FROM (SELECT z.event_id, q.n, z.revision, z.final, z.seen, z.known, q.text, CASE WHEN q.text IS NULL THEN 'INVALID_PLATE' WHEN NOT z.known THEN 'NO_EVENT' WHEN NOT z.seen THEN 'NO_PLATE' WHEN q.expected = z.revision THEN 'CHANGED' WHEN q.expected + 1 = z.revision AND z.final IS NOT DISTINCT FROM q.text THEN 'UNCHANGED' ELSE 'CONFLICT' END AS outcome FROM z JOIN q ON q.event_id = z.event_id AND q.n = z.n + 1)) "
       "SELECT q.event_id, q.seq, z.outcome, z.revision, z.final AS plate_final FROM z JOIN q USING (event_id, n)")
def review_commands(spark, sf_dir):
    """ST16, ST15: reviews whose text is normalized and whose revision must hold, retries included."""
    rows = fx.events(spark, sf_dir)
    now = rows.where("event_id % 5 <> 0").selectExpr("id", "plate", "CASE WHEN event_id % 4 = 0 THEN 1 END AS review_revision", "CASE WHEN event_id % 4 = 0 THEN 'OLD' END AS plate_final")
    commands = rows.where("event_id % 2 = 0").select("id", "event_id", "raw", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).selectExpr("id AS event_id", "event_id * 4 + i AS seq", "raw AS text", "CASE WHEN i = 3 THEN i - 2 ELSE i END AS expected_revision")
    return datasets.review_commands(now, commands)


def _identities(rows: DataFrame) -> DataFrame:
    number = F.substring("vehicle_id", 5, 9).cast("int")
    return rows.select("vehicle_id").distinct().select("vehicle_id", F.when(number % 11 == 0, "MERGED").otherwise("ACTIVE").alias("status"), (number % 3 + 1).alias("revision"))


@query("WITH {ve}, p AS (SELECT vehicle_id, user_id AS u, count(*) AS n, count(DISTINCT plate) FILTER (plate_confidence IS NOT NULL) AS plates, max(occurred_at) AS last FROM ve WHERE vehicle_id IS NOT NULL GROUP BY 1, 2), i AS (SELECT *, CASE WHEN u % 11 = 0 THEN 'MERGED' ELSE 'ACTIVE' END AS status, u % 3 + 1 AS revision FROM p), "
       "r AS (SELECT printf('r%06d', a) AS review_id, 'veh-' || a AS source, 'veh-' || (a + 1) AS target, a % 3 + 1 AS sr, CASE WHEN a % 5 = 0 THEN 9 ELSE (a + 1) % 3 + 1 END AS tr FROM (SELECT DISTINCT user_id AS a FROM ve WHERE user_id % 4 < 2)), "
       "j AS (SELECT r.*, CASE WHEN s.u IS NULL OR t.u IS NULL THEN 'NOT_FOUND' WHEN s.status <> 'ACTIVE' OR t.status <> 'ACTIVE' THEN 'NOT_ACTIVE' WHEN s.revision <> sr OR t.revision <> tr THEN 'REVISION' WHEN s.n > 1000 OR t.n > 1000 THEN 'TOO_LARGE' END AS why FROM r LEFT JOIN i s ON s.vehicle_id = source LEFT JOIN i t ON t.vehicle_id = target), "
       "g AS (SELECT review_id, unnest([source, target]) AS v FROM j WHERE why IS NULL), f AS (SELECT v, min(review_id) AS first FROM g GROUP BY 1), o AS (SELECT j.*, coalesce(why, CASE WHEN EXISTS (SELECT 1 FROM g JOIN f USING (v) WHERE g.review_id = j.review_id AND first <> j.review_id) THEN 'REVISION' ELSE 'APPLIED' END) AS outcome FROM j) "
       "SELECT i.vehicle_id, CASE WHEN a.source IS NOT NULL THEN 'MERGED' ELSE i.status END AS status, (i.revision + (a.source IS NOT NULL OR b.target IS NOT NULL)::INT)::INT AS revision, CASE WHEN b.target IS NOT NULL THEN i.n + s.n END AS observation_count, x.outcome AS asked FROM i LEFT JOIN o a ON a.source = i.vehicle_id AND a.outcome = 'APPLIED' LEFT JOIN o b ON b.target = i.vehicle_id AND b.outcome = 'APPLIED' LEFT JOIN i s ON s.vehicle_id = b.source LEFT JOIN o x ON x.source = i.vehicle_id")
def identity_merges(spark, sf_dir):
    """ST17: merges under revisions and a bound, with the identities that they rebuild."""
    rows = fx.events(spark, sf_dir)
    prints = rows.where("vehicle_id IS NOT NULL")
    a = F.col("user_id")
    reviews = rows.where("user_id % 4 < 2").select("user_id").distinct().select(F.format_string("r%06d", a).alias("review_id"), F.concat(F.lit("veh-"), a.cast("string")).alias("source"), F.concat(F.lit("veh-"), (a + 1).cast("string")).alias("target"), (a % 3 + 1).alias("source_revision"), F.when(a % 5 == 0, 9).otherwise((a + 1) % 3 + 1).alias("target_revision"))
    outcomes, _, now = identity.apply_merges(_identities(prints), prints, reviews)
    return now.join(outcomes.select(F.col("source").alias("vehicle_id"), F.col("outcome").alias("asked")), "vehicle_id", "left").select("vehicle_id", "status", F.col("revision").cast("int").alias("revision"), "observation_count", "asked")


_SIGHTED = "SELECT camera_id, event_id // 4000 AS epoch, (event_id // 16) * 0.7::DOUBLE AS t, 't' || (user_id % 5) AS track, event_id % 29 = 0 AS crossed, event_id % 5000 >= 4992 AS final FROM ve"


@query("WITH RECURSIVE {ve}, a AS (" + _SIGHTED + "), ticks AS (SELECT camera_id, epoch, t, bool_or(final) AS final FROM a GROUP BY ALL), segs AS (SELECT *, coalesce(sum(final::INT) OVER (PARTITION BY camera_id, epoch ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM ticks), "
       "s AS (SELECT camera_id, epoch, seg, t, track, bool_or(crossed) AS crossed FROM a JOIN segs USING (camera_id, epoch, t) GROUP BY ALL), b AS (SELECT s.*, min(g.t) AS out FROM s LEFT JOIN segs g ON g.camera_id = s.camera_id AND g.epoch = s.epoch AND g.seg = s.seg AND g.t > s.t AND g.t < s.t + 9 AND g.t - s.t >= 2.0 GROUP BY ALL), "
       "n AS (SELECT *, row_number() OVER w AS r, lead(t) OVER w AS nxt FROM b WINDOW w AS (PARTITION BY camera_id, epoch, seg, track ORDER BY t)), "
       "w AS (SELECT camera_id, epoch, seg, track, r, t, out, nxt, t AS first, 1::BIGINT AS n, crossed AS gone, crossed AS ends FROM n WHERE r = 1 UNION ALL "
       "SELECT n.camera_id, n.epoch, n.seg, n.track, n.r, n.t, n.out, n.nxt, CASE WHEN k.fresh THEN n.t ELSE w.first END, CASE WHEN k.fresh THEN 1 WHEN w.gone THEN w.n ELSE w.n + 1 END, CASE WHEN k.fresh OR NOT w.gone THEN n.crossed ELSE true END, n.crossed AND (k.fresh OR NOT w.gone) "
       "FROM w JOIN n ON n.camera_id = w.camera_id AND n.epoch = w.epoch AND n.seg = w.seg AND n.track = w.track AND n.r = w.r + 1, LATERAL (SELECT CASE WHEN w.gone THEN n.t - w.t >= 2.0 ELSE coalesce(w.out < n.t, false) END AS fresh) k), "
       "f AS (SELECT camera_id, epoch, seg, bool_or(final) AS final FROM segs GROUP BY ALL), l AS (SELECT camera_id, max(epoch) AS newest FROM a GROUP BY 1) "
       "SELECT camera_id, epoch, track AS track_id, round(first, 6) AS first_seen, round(t, 6) AS last_seen, n AS observations, cause FROM (SELECT w.*, CASE WHEN ends THEN 'CROSSING' WHEN gone THEN NULL WHEN out IS NOT NULL AND (nxt IS NULL OR out < nxt) THEN 'TIMEOUT' WHEN nxt IS NOT NULL THEN NULL WHEN f.final THEN 'END' WHEN l.newest > epoch THEN 'EPOCH' END AS cause FROM w JOIN f USING (camera_id, epoch, seg) JOIN l USING (camera_id)) WHERE cause IS NOT NULL")
def track_stream(spark, sf_dir):
    """ST2 to ST5: tracks as a stream of ticks, closed by time, crossing, a new epoch or an end, late sightings dropped."""
    path = new_path(spark, "ticks")
    rows = fx.events(spark, sf_dir).selectExpr("camera_id", "event_id div 4000 AS epoch", "(event_id div 16) * 0.7D AS at", "concat('t', CAST(user_id % 5 AS STRING)) AS track_id", "event_id % 29 = 0 AS crossed", "event_id % 5000 >= 4992 AS final")
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    tracks.start(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    found = spark.read.schema(tracks.SESSIONS).parquet(f"{path}/out")
    return found.withColumns({c: F.round(c, 6) for c in ("first_seen", "last_seen")})
