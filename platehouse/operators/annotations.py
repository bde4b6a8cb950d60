"""Detector annotations: crops, quality, suggestions, consensus, sampling of frames and registry filters."""

from __future__ import annotations

from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platehouse.functions.grouping import map_groups, parts_for

#: Brightness and aspect ranges of readable plates, the brightness below which an image is night.
BRIGHTNESS, ASPECT, NIGHT_BELOW, SINGLE_LINE_FROM = (45.0, 220.0), (1.5, 3.2, 6.5), 0.28, 2.5
SAME_BOX = 0.85


def expanded_crop(box: Column, width: int, height: int, two_line: Column, across: float, down: float, extra_top: float) -> Column:
    """A plate's box (struct of corners) clipped to the image and padded; null where nothing is left of it."""
    fit = lambda v, most: F.greatest(F.lit(0), F.least(v, F.lit(most)))
    x1, y1, x2, y2 = fit(box["x1"], width), fit(box["y1"], height), fit(box["x2"], width), fit(box["y2"], height)
    side, end = F.ceil((x2 - x1) * across), F.ceil((y2 - y1) * down)
    top = F.when(two_line, F.ceil((y2 - y1) * extra_top)).otherwise(0)
    grown = F.struct(F.greatest(F.lit(0), x1 - side).cast("int").alias("x1"), F.greatest(F.lit(0), y1 - end - top).cast("int").alias("y1"), F.least(F.lit(width), x2 + side).cast("int").alias("x2"), F.least(F.lit(height), y2 + end).cast("int").alias("y2"))
    return F.when((x2 > x1) & (y2 > y1), grown)


def plate_quality(rows: DataFrame, weights: dict[str, float], target: tuple[int, int], least: tuple[int, int], minimum: float) -> DataFrame:
    """Scores of plate crops from their statistics: sharpness, brightness (mean), contrast, width, height, detector.

    Adds total and eligible. Brightness falls off from the middle of its range, shape from the ideal aspect ratio.
    """
    low, high = BRIGHTNESS
    narrow, ideal, wide = ASPECT
    ratio = F.col("width") / F.greatest("height", F.lit(1))
    parts = {
        "sharpness": F.least(F.col("sharpness"), F.lit(1.0)), "brightness": F.greatest(F.lit(0.0), 1 - F.abs(F.col("brightness") - (low + high) / 2) / ((high - low) / 2)), "contrast": F.least(F.col("contrast"), F.lit(1.0)),
        "resolution": F.least(F.col("width") / target[0], F.col("height") / target[1], F.lit(1.0)),
        "angle": F.when((ratio <= narrow) | (ratio >= wide), 0.0).when(ratio <= ideal, (ratio - narrow) / (ideal - narrow)).otherwise((wide - ratio) / (wide - ideal)), "detector": F.col("detector"),
    }
    total = sum((parts[k] * w for k, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    scored = rows.withColumn("total", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return scored.withColumn("eligible", (F.col("width") >= least[0]) & (F.col("height") >= least[1]) & (F.col("total") >= minimum))


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of scores within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((c * w for c, w in parts), F.lit(0.0)) / sum(w for _, w in parts)))


def lighting(brightness: Column) -> Column:
    return F.when(brightness < NIGHT_BELOW, "NIGHT").otherwise("DAY")


def suggestions(detections: DataFrame, most: int) -> DataFrame:
    """The `most` surest detections of each image (bbox [x, y, w, h]) with rounded confidence and supposed layout."""
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "id")
    top = detections.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    layout = F.when(F.col("bbox")[2] / F.col("bbox")[3] >= SINGLE_LINE_FROM, "SINGLE_LINE").otherwise("TWO_LINE")
    return top.select("image_id", "id", "place", F.bround("score", 6).alias("confidence"), layout.alias("layout"))


def _overlap(a: list[float], b: list[float]) -> float:
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    common = max(0.0, w) * max(0.0, h)
    union = a[2] * a[3] + b[2] * b[3] - common
    return common / union if union > 0 else 0.0


def consensus(candidates: DataFrame) -> DataFrame:
    """Several sources' annotations of an image as one each: image_id, id, bbox, votes.

    A candidate (image_id, id, layout, bbox, polygon [[x, y], ...]) joins the first cluster whose head has its layout and
    overlaps by 0.85. Where all polygons of a cluster have as many corners, the medians of the corners count.
    """

    def merge(key, rows: dict) -> list[tuple]:
        clusters: list[list[int]] = []
        for i, (layout, box) in enumerate(zip(rows["layout"], rows["bbox"], strict=True)):
            home = next((c for c in clusters if rows["layout"][c[0]] == layout and _overlap(rows["bbox"][c[0]], box) >= SAME_BOX), None)
            if home is None:
                clusters.append([i])
            else:
                home.append(i)
        out = []
        for c in clusters:
            shapes = [rows["polygon"][i] for i in c]
            box = [float(x) for x in rows["bbox"][c[0]]]
            if len(shapes[0]) and all(len(s) == len(shapes[0]) for s in shapes):
                xs, ys = ([median(s[k][axis] for s in shapes) for k in range(len(shapes[0]))] for axis in (0, 1))
                box = [min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)]
            out.append((key[0], rows["id"][c[0]], box, len(c)))
        return out

    return map_groups(candidates, ["image_id"], ["id"], merge, "image_id long, id long, bbox array<double>, votes int")


def sampled_frames(frames: DataFrame, source_fps: float, limit_fps: float) -> DataFrame:
    """Frames (video_id, frame_id from 0) that a rate limit lets through.

    A frame passes if its time plus half a frame has reached the next sampling time, which then moves on by one period. With
    S the periods that a frame's time has reached and i its place, so many have passed up to it: i + 1 + the least of zero
    and all S - i so far. A running minimum therefore says which frames pass, also after gaps.
    """
    period = 1.0 / min(limit_fps, source_fps)
    ordered = Window.partitionBy("video_id").orderBy("frame_id")
    place = F.row_number().over(ordered) - 1
    reached = F.floor((F.col("frame_id") + 0.5) / source_fps / period + 1e-9)
    rows = frames.select("video_id", "frame_id", place.alias("_i"), (reached - place).alias("_ahead"))
    passed = F.col("_i") + 1 + F.least(F.lit(0), F.min("_ahead").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_passed", passed)
    rows = rows.withColumn("_before", F.coalesce(F.lag("_passed").over(ordered), F.lit(0)))
    return rows.where("_passed > _before").select("video_id", "frame_id")


def seek_samples(videos: DataFrame, interval: float) -> DataFrame:
    """(video_id, frame_index, offset_seconds) of seeks at 0, interval, ... within each video (video_id, fps, frame_count).

    A seek lands on the first frame at or after its offset; one that does not get beyond the frame before it is left out.
    Frames grow with seeks, so each seek looks at the one before it and no seek is shuffled; videos are dealt first, by
    VIDEOS_EACH. Only the seeks of an id that stands for several videos are grouped, of equals the earliest.
    """
    n = parts_for(videos.sparkSession, videos.count(), VIDEOS_EACH)
    facts = F.struct("fps", "frame_count")
    usable = videos.where("frame_count > 0 AND fps > 0").select("video_id", "fps", "frame_count")
    spans = usable.repartition(n, "video_id").groupBy("video_id").agg(F.min(facts).alias("_low"), F.max(facts).alias("_high"))
    shared = spans.where("_low <> _high").select(F.col("video_id").alias("_id"))
    several = usable.join(shared, F.col("video_id").eqNullSafe(F.col("_id")), "left_semi").distinct().repartition(n)

    def landed(rows: DataFrame) -> DataFrame:
        steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("frame_count") / F.col("fps") / interval).cast("int") - 1, F.lit(0)))
        frame = lambda k: F.ceil(F.round(k * interval * F.col("fps"), 6)).cast("long")
        seeks = rows.select("video_id", "fps", "frame_count", F.explode(steps).alias("_k")).withColumn("frame_index", frame(F.col("_k")))
        inside = (F.col("frame_index") < F.col("frame_count")) & (F.col("_k") * interval * F.col("fps") < F.col("frame_count"))
        first = (F.col("_k") == 0) | (F.col("frame_index") > frame(F.col("_k") - 1))
        return seeks.where(inside & first).select("video_id", "frame_index", (F.col("_k") * interval).alias("offset_seconds"))

    return landed(spans.where("_low = _high").select("video_id", "_low.*")).union(landed(several).groupBy("video_id", "frame_index").agg(F.min("offset_seconds").alias("offset_seconds")))


#: Videos whose seeks one part makes.
VIDEOS_EACH = 20_000


def same_boxes(boxes: Column, suggestions: Column, tolerance: float = 0.01) -> Column:
    """Are arrays of [x, y, width, height] as many and, place by place, within the tolerance? False without suggestions."""
    near = F.zip_with(boxes, suggestions, lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok))
    return F.coalesce((F.size(suggestions) > 0) & (F.size(boxes) == F.size(suggestions)) & F.forall(near, lambda ok: ok), F.lit(False))


def review_queue(items: DataFrame, status: str | None, reason: str | None, limit: int, cursor: str | None = None) -> DataFrame:
    """A page of review items in order of review_id, and one more; the cursor holds only for the filters it was made with."""
    from platehouse.operators.events import decode_bound, matching

    rows = items.where(matching({"status": status, "reason": reason}))
    if cursor is not None:
        rows = rows.where(F.col("review_id") > decode_bound(cursor, {"status": status, "reason": reason}))
    return rows.orderBy("review_id").limit(limit + 1)


def sample_page(samples: DataFrame, source_id: str, digest: str, kind: str | None, light: str | None, limit: int, cursor: str | None = None) -> DataFrame:
    """A page of a source's samples in order of sample_id, and one more; a cursor fails once the source's digest has changed."""
    from platehouse.operators.events import decode_bound

    bound = {"source": source_id, "digest": digest, "kind": kind, "lighting": light}
    rows = registry_samples(samples, kind, light)
    if cursor is not None:
        rows = rows.where(F.col("sample_id") > decode_bound(cursor, bound))
    return rows.orderBy("sample_id").limit(limit + 1)


def registry_samples(samples: DataFrame, kind: str | None = None, light: str | None = None) -> DataFrame:
    """Samples by kind (POSITIVE with annotations, NEGATIVE without) and lighting, which is UNKNOWN where blank."""
    known = F.coalesce(F.when(F.trim("lighting") != "", F.upper(F.trim("lighting"))), F.lit("UNKNOWN"))
    out = samples.withColumn("lighting", known)
    if kind is not None:
        out = out.where((F.col("annotation_count") > 0) == (kind == "POSITIVE"))
    return out if light is None else out.where(F.col("lighting") == light.strip().upper())
