"""Tracker output resolved to detections: by the index that it names, else by the nearest centre, in crowded frames on grids of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platehouse.functions.scratch import staged

#: Each grid's cells are so many times as wide as those of the one before.
WIDER = 4.0
#: A frame of more detections goes by grids.
CROWD = 256
# Fixed value: marks the tracks of such a frame.
CROWDED = "CROWDED"


def _centre(box: Column) -> tuple[Column, Column]:
    return box[0] + box[2] / 2, box[1] + box[3] / 2


def _away(dx: Column, dy: Column) -> Column:
    """The distance squared of a track's centre."""
    return (F.col("_x") - dx) * (F.col("_x") - dx) + (F.col("_y") - dy) * (F.col("_y") - dy)


def _nearest(tracks: DataFrame, detections: DataFrame, size: float) -> DataFrame:
    """(frame_id, track_id, _best (distance squared, index)) among the detections in the 3 x 3 cells about each track."""
    cell = lambda c: F.floor(F.col(c) / size)
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), dx -> transform(sequence(-1, 1), dy -> struct(dx AS dx, dy AS dy))))")).alias("_d")
    near = tracks.select("*", around).withColumns({"_cx": cell("_x") + F.col("_d.dx"), "_cy": cell("_y") + F.col("_d.dy")}).drop("_d")
    there = detections.select("frame_id", cell("_dx").alias("_cx"), cell("_dy").alias("_cy"), "_dx", "_dy", "detection_index")
    met = near.join(there, ["frame_id", "_cx", "_cy"])
    return met.groupBy("frame_id", "track_id").agg(F.min(F.struct(_away(F.col("_dx"), F.col("_dy")).alias("away"), F.col("detection_index").alias("index"))).alias("_best"))


def resolve(tracks: DataFrame, detections: DataFrame, cell: float = 16.0, crowd: int = CROWD) -> DataFrame:
    """(frame_id, track_id, detection_index, by) for every track: by INDEX where the tracker names a detection of the frame,
    else NEAREST; null where the frame has none.

    tracks: frame_id, track_id, index, bbox [x, y, w, h]; detections: frame_id, detection_index, bbox. Of equally near ones
    the lower index counts; a box without a number for a centre is near nothing. Each side is dealt by frame once: a
    frame's detections stand beside each of its tracks. Frames of more than `crowd` detections go by grids of cells.
    """
    x, y = _centre(F.col("bbox"))
    found = detections.select("frame_id", "detection_index", x.alias("_dx"), y.alias("_dy"))
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy("detection_index"))
    few = found.withColumn("_i", place).where(F.col("_i") <= crowd + 1)
    frames = few.groupBy("frame_id").agg(F.collect_list(F.struct("_dx", "_dy", "detection_index")).alias("_all"))
    given = tracks.select("frame_id", "track_id", "index", x.alias("_x"), y.alias("_y")).join(frames, "frame_id", "left")
    best = F.array_min(F.filter(F.transform("_all", lambda d: F.struct(_away(d["_dx"], d["_dy"]).alias("away"), d["detection_index"].alias("index"))), lambda d: d["away"].isNotNull() & ~F.isnan(d["away"])))
    crowded, named = F.size("_all") > crowd, F.array_contains("_all.detection_index", F.col("index"))
    by = F.when(crowded, CROWDED).when(named, "INDEX").when(best.isNotNull(), "NEAREST")
    index = F.when(crowded | named, F.col("index")).otherwise(best["index"]).cast("long")
    met = staged(given.select("frame_id", "track_id", index.alias("detection_index"), by.alias("by"), *[F.when(crowded, F.col(c)).alias(c) for c in ("_x", "_y")]), "tracks")
    out, rest = met.where(F.coalesce(F.col("by") != CROWDED, F.lit(True))).drop("_x", "_y"), met.where(F.col("by") == CROWDED)
    if rest.isEmpty():
        return out
    return out.unionByName(_by_grids(rest.withColumnRenamed("detection_index", "index").drop("by"), found.join(rest.select("frame_id").distinct(), "frame_id", "left_semi"), cell))


def _by_grids(tracks: DataFrame, found: DataFrame, cell: float) -> DataFrame:
    """resolve for frames of many detections: tracks (frame_id, track_id, index, _x, _y), found (frame_id, detection_index, _dx, _dy).

    A track meets only the detections in its own and the adjoining cells of a grid; a nearest one that is no farther than a
    cell is wide is the nearest of all. The others go on to a wider grid, each round with fewer tracks, until all have
    settled; so a frame with very many boxes is no table of pairs.
    """
    found = staged(found, "found")
    given = tracks.join(found.select("frame_id", F.col("detection_index").alias("index"), F.lit(True).alias("_named")).distinct(), ["frame_id", "index"], "left")
    given = staged(given.select("frame_id", "track_id", F.when(F.col("_named"), F.col("index")).alias("index"), "_x", "_y"), "tracks")
    number = lambda *names: F.expr(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in names))
    placed = found.where(number("_dx", "_dy"))
    parts = [given.where("index IS NOT NULL").select("frame_id", "track_id", F.col("index").alias("detection_index"), F.lit("INDEX").alias("by"))]
    nameless = given.where("index IS NULL")
    open_ = nameless.where(number("_x", "_y")).join(placed.select("frame_id").distinct(), "frame_id", "left_semi").select("frame_id", "track_id", "_x", "_y")
    none = nameless.where(~number("_x", "_y")).unionByName(nameless.where(number("_x", "_y")).join(placed.select("frame_id").distinct(), "frame_id", "left_anti"))
    parts.append(none.select("frame_id", "track_id", F.lit(None).cast("long").alias("detection_index"), F.lit(None).cast("string").alias("by")))
    size = cell
    while not open_.isEmpty():
        met = staged(open_.join(_nearest(open_, placed, size), ["frame_id", "track_id"], "left"), "near")
        sure = F.coalesce(F.col("_best.away") <= size * size, F.lit(False))
        parts.append(met.where(sure).select("frame_id", "track_id", F.col("_best.index").cast("long").alias("detection_index"), F.lit("NEAREST").alias("by")))
        open_, size = met.where(~sure).drop("_best"), size * WIDER
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
