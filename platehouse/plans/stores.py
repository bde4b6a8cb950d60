"""Registered queries of sources and sinks with a commit: the outbox and COCO documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from platehouse.functions.scratch import new_path
from platehouse.plans import fixtures as fx
from platehouse.plans.records import _detector_samples
from platehouse.plans.registry import query
from platehouse.sources import cocosink, files, outbox


@query("WITH {ve} SELECT row_number() OVER (ORDER BY (direction <> 'ENTER')::INT, occurred_at, id) - 1 AS sequence, camera_id AS key, id, event_type FROM ve")
def outbox_replay(spark, sf_dir):
    """Events staged in two writes and replayed in the order of their sequence numbers, each record checked."""
    path, rows = new_path(spark, "outbox"), fx.events(spark, sf_dir)
    for enters in (True, False):
        some = rows.where((F.col("direction") == "ENTER") == F.lit(enters))
        outbox.stage(some.select(F.col("camera_id").alias("key"), F.to_json(F.struct("id", "event_type")).alias("payload"), "occurred_at", "id"), ["occurred_at", "id"], path)
    return outbox.replay(spark, path).select("sequence", "key", F.from_json("payload", "id STRING, event_type STRING").alias("e")).select("sequence", "key", "e.*")


_SPLIT = "CASE WHEN s < 0.8 THEN 'train' WHEN s < 0.9 THEN 'val' ELSE 'test' END"


@query("WITH d AS (SELECT *, " + _SPLIT + " AS split FROM (SELECT *, (('0x' || substr(sha256('7:' || source), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0 AS s FROM documents)) SELECT split, count(*) AS images, sum(n_chars % 3)::BIGINT AS annotations, count(DISTINCT doc_id) AS samples, sum(CASE WHEN n_chars % 3 > 0 THEN 1 ELSE 0 END)::BIGINT AS annotated, sum((n_chars % 3) * 6)::DOUBLE AS area, 0 AS problems FROM d GROUP BY 1")
def coco_documents(spark, sf_dir):
    """One committed COCO document for each split, read again and checked against its manifest."""
    path, classes = new_path(spark, "coco"), ["de", "en", "es", "fr"]
    cocosink.export(_detector_samples(spark, sf_dir), classes, path)
    problems = cocosink.verify(spark, path).count()
    found = None
    for split in [r["split"] for r in cocosink.manifest(spark, path).select("split").collect()]:  # train, val and test
        images, _, boxes = files.read_coco(spark, f"{path}/annotations/{split}.json")
        some = boxes.agg(F.count("*").alias("annotations"), F.countDistinct("image_id").alias("annotated"), F.coalesce(F.sum(F.col("bbox")[2] * F.col("bbox")[3]), F.lit(0.0)).alias("area"))
        some = images.agg(F.count("*").alias("images"), F.countDistinct("file_name").alias("samples")).crossJoin(some).select(F.lit(split).alias("split"), "images", "annotations", "samples", "annotated", "area", F.lit(problems).alias("problems"))  # one row each
        found = some if found is None else found.union(some)
    return found
