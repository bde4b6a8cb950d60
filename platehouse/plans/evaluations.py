"""Registered queries of detector evaluation. Their SQL repeats greedy matching as a recursion over ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platehouse.operators import evaluation
from platehouse.plans import fixtures as fx
from platehouse.plans.registry import query

_ID = fx.TRUTHS["id"]
_BOXES = (
    f"t AS (SELECT {_ID} AS id, l_orderkey AS image, l_linenumber % 2 AS class, (l_partkey % 40)::DOUBLE AS x, (l_suppkey % 10)::DOUBLE AS y, 10.0::DOUBLE + l_quantity AS w, 8.0::DOUBLE + l_linenumber AS h FROM lineitem), "
    f"p AS (SELECT {_ID} AS id, l_orderkey AS image, l_linenumber % 2 AS class, (l_partkey % 40)::DOUBLE + 40 * l_discount AS x, (l_suppkey % 10)::DOUBLE + l_tax AS y, 10.0::DOUBLE + l_quantity AS w, 8.0::DOUBLE + l_linenumber AS h, round(l_extendedprice / 110000.0, 6) AS score FROM lineitem), "
)
_COMMON = "greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
_SIZES = "{a}.w * {a}.h + {b}.w * {b}.h"


def _iou(a: str, b: str) -> str:
    common, sizes = _COMMON.format(a=a, b=b), _SIZES.format(a=a, b=b)
    return f"({common}) / ({sizes} - ({common}))"


def _matches(thresholds: tuple[float, ...]) -> str:
    """m(threshold, id, image, class, score, truth): predictions by rank, each with the best truth that is still free."""
    values = ", ".join(f"({x}::DOUBLE)" for x in thresholds)
    return (
        "WITH RECURSIVE " + _BOXES + f"th(threshold) AS (VALUES {values}), "
        "r AS (SELECT threshold, image, class, id, score, row_number() OVER (PARTITION BY threshold, image, class ORDER BY score DESC, id) AS r FROM p, th), "
        "i AS (SELECT p.id, t.id AS truth, " + _iou("p", "t") + " AS iou FROM p JOIN t USING (image, class)), "
        "g AS (SELECT DISTINCT threshold, image, class, 0::BIGINT AS r, []::BIGINT[] AS taken, NULL::BIGINT AS id, NULL::DOUBLE AS score, NULL::BIGINT AS truth FROM r UNION ALL "
        "SELECT threshold, image, class, r, CASE WHEN truth IS NULL THEN taken ELSE list_append(taken, truth) END, id, score, truth FROM ("
        "SELECT r.threshold, r.image, r.class, r.r, any_value(g.taken) AS taken, r.id, r.score, arg_max(i.truth, (i.iou, i.truth)) FILTER (i.iou >= r.threshold AND NOT list_contains(g.taken, i.truth)) AS truth "
        "FROM g JOIN r ON r.threshold = g.threshold AND r.image = g.image AND r.class = g.class AND r.r = g.r + 1 LEFT JOIN i ON i.id = r.id GROUP BY ALL)), "
        "m AS (SELECT threshold, id, image, class, score, truth FROM g WHERE r > 0) "
    )


def _truths(spark, sf_dir) -> DataFrame:
    return fx.boxes(spark, sf_dir, fx.TRUTHS)


def _matched(spark, sf_dir, thresholds=(0.5,)) -> DataFrame:
    return evaluation.match(_truths(spark, sf_dir), fx.boxes(spark, sf_dir, fx.PREDICTED), thresholds)


@query(_matches((0.5,)) + "SELECT id AS prediction_id, truth AS truth_id FROM m")
def detector_pairs(spark, sf_dir):
    """Greedy one-to-one matches."""
    return _matched(spark, sf_dir).select("prediction_id", "truth_id")


@query(_matches((0.5,)) + "SELECT 0.5::DOUBLE AS threshold, class AS category_id, hits AS true_positives, n - hits AS false_positives, truths, hits / n AS precision, hits / truths AS recall FROM (SELECT class, count(truth) AS hits, count(*) AS n FROM m GROUP BY 1) JOIN (SELECT class, count(*) AS truths FROM t GROUP BY 1) USING (class)")
def detector_matches(spark, sf_dir):
    """Precision and recall by class."""
    return evaluation.precision_recall(_matched(spark, sf_dir), _truths(spark, sf_dir), ["category_id"])


_AP = (
    _matches(evaluation.IOU_THRESHOLDS) + ", c AS (SELECT threshold, class, sum((truth IS NOT NULL)::INT) OVER w AS tp, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY threshold, class ORDER BY score DESC, id)), "
    "b AS (SELECT *, max(tp / n) OVER (PARTITION BY threshold, class ORDER BY n DESC) AS best FROM c), f AS (SELECT threshold, class, tp, arg_min(best, n) AS best FROM b GROUP BY 1, 2, 3), first AS (SELECT threshold, class, arg_min(best, n) AS best FROM b GROUP BY 1, 2), "
    "k AS (SELECT class, count(*) AS truths FROM t GROUP BY 1), q AS (SELECT threshold, class, s, ceil(s * truths / 100 - 1e-9)::BIGINT AS tp FROM k, th, range(101) x(s)), "
    "ap AS (SELECT threshold, class, sum(CASE WHEN q.tp = 0 THEN first.best ELSE coalesce(f.best, 0) END) / 101 AS ap FROM q LEFT JOIN f USING (threshold, class, tp) LEFT JOIN first USING (threshold, class) GROUP BY 1, 2) "
)


def _precision(spark, sf_dir) -> DataFrame:
    return evaluation.average_precision(_truths(spark, sf_dir), fx.boxes(spark, sf_dir, fx.PREDICTED))


@query(_AP + "SELECT threshold, class AS category_id, round(coalesce(ap, 0), 7) AS average_precision FROM ap")
def detector_average_precision(spark, sf_dir):
    """A17, W3."""
    return _precision(spark, sf_dir).withColumn("average_precision", F.round("average_precision", 7))


@query(_AP + "SELECT round(avg(coalesce(ap, 0)) FILTER (threshold = 0.5), 7) AS map50, round(avg(coalesce(ap, 0)), 7) AS map50_95 FROM ap")
def detector_mean_precision(spark, sf_dir):
    """A18."""
    found = evaluation.mean_average_precision(_precision(spark, sf_dir))
    return found.withColumns({c: F.round(c, 7) for c in ("map50", "map50_95")})


_SLICE = "LEFT JOIN orders ON o_orderkey = t.image LEFT JOIN (SELECT DISTINCT truth FROM m WHERE truth IS NOT NULL) f ON f.truth = t.id"


def _images(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS lighting", "concat('g', CAST(o_custkey % 50 AS STRING)) AS group_id")


@query(_matches((0.5,)) + "SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority ELSE 'UNKNOWN' END AS slice, count(*) AS truths, count(f.truth) AS found, round(count(f.truth) / count(*), 9) AS recall FROM t " + _SLICE + " GROUP BY 1")
def detector_slices(spark, sf_dir):
    """A19, J10."""
    found = evaluation.recall_by(_matched(spark, sf_dir), _truths(spark, sf_dir), _images(spark, sf_dir), F.coalesce("lighting", F.lit("UNKNOWN")))
    return found.withColumn("recall", F.round("recall", 9))


@query(_matches((0.5,)) + "SELECT count(DISTINCT g) AS groups, count(DISTINCT g) FILTER (truth IS NOT NULL) AS found, count(DISTINCT g) FILTER (truth IS NOT NULL) / count(DISTINCT g) AS group_recall FROM (SELECT 'g' || (o_custkey % 50) AS g, f.truth FROM t " + _SLICE + ")")
def detector_group_recall(spark, sf_dir):
    """A20."""
    return evaluation.group_recall(_matched(spark, sf_dir), _truths(spark, sf_dir), _images(spark, sf_dir))


@query("WITH RECURSIVE " + _BOXES + "r AS (SELECT id, image, class, score, x, y, (x + w) - x AS w, (y + h) - y AS h, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS r FROM p), i AS (SELECT a.image, a.r, b.r AS better FROM r a JOIN r b ON a.image = b.image AND a.class = b.class AND b.r < a.r AND " + _iou("a", "b") + " > 0.5), "
       "g AS (SELECT DISTINCT image, 0::BIGINT AS r, []::BIGINT[] AS kept FROM r UNION ALL SELECT image, r, CASE WHEN worse THEN kept ELSE list_append(kept, r) END FROM (SELECT r.image, r.r, any_value(g.kept) AS kept, coalesce(bool_or(list_contains(g.kept, i.better)), false) AS worse FROM g JOIN r ON r.image = g.image AND r.r = g.r + 1 LEFT JOIN i ON i.image = r.image AND i.r = r.r GROUP BY r.image, r.r)) "
       "SELECT r.id, r.image AS image_id, r.score FROM r JOIN g ON g.image = r.image AND g.r = r.r AND list_contains(g.kept, r.r)")
def suppressed_boxes(spark, sf_dir):
    """T12."""
    b = fx.boxes(spark, sf_dir, fx.PREDICTED)
    corners = b.select("id", "image_id", "category_id", F.array(F.col("bbox")[0], F.col("bbox")[1], F.col("bbox")[0] + F.col("bbox")[2], F.col("bbox")[1] + F.col("bbox")[3]).alias("bbox"), "score")
    return evaluation.suppress(corners, 0.5).select("id", "image_id", "score")


@query("WITH RECURSIVE " + _BOXES + "k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY id) AS r FROM t), i AS (SELECT a.image, a.r, p.id AS found, " + _iou("p", "a") + " AS iou FROM k a JOIN p ON p.image = a.image), "
       "g AS (SELECT DISTINCT image, 0::BIGINT AS r, []::BIGINT[] AS taken, NULL::BIGINT AS track, NULL::BIGINT AS found FROM k UNION ALL SELECT image, r, CASE WHEN found IS NULL THEN taken ELSE list_append(taken, found) END, track, found FROM (SELECT k.image, k.r, any_value(g.taken) AS taken, k.id AS track, arg_max(i.found, (i.iou, -i.found)) FILTER (i.iou > 0 AND NOT list_contains(g.taken, i.found)) AS found FROM g JOIN k ON k.image = g.image AND k.r = g.r + 1 LEFT JOIN i ON i.image = k.image AND i.r = k.r GROUP BY k.image, k.r, k.id)) "
       "SELECT image AS frame_id, track AS track_id, found AS detection_id FROM g WHERE r > 0")
def associated_tracks(spark, sf_dir):
    """Each track takes its best free detection."""
    tracks = _truths(spark, sf_dir).selectExpr("image_id AS frame_id", "id AS track_id", "bbox")
    found = fx.boxes(spark, sf_dir, fx.PREDICTED).selectExpr("image_id AS frame_id", "id AS detection_id", "bbox")
    return evaluation.associate(tracks, found)
