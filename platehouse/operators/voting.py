"""Temporal plate voting and other per-track aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platehouse.functions import plates
from platehouse.functions.folding import Machine, fold
from platehouse.functions.grouping import map_groups
from platehouse.functions.scratch import staged

#: Weights of a cluster's score, distance within a cluster, support needed.
WEIGHTS = {"frequency": 0.25, "ocr": 0.30, "quality": 0.20, "detection": 0.15, "consensus": 0.10}
MOST_EDITS, LEAST_OBSERVATIONS = 2, 2
MOST_OBSERVATIONS = 64


def reliability():
    """Cube root of the three confidences' product."""
    return F.pow(F.col("ocr_confidence") * F.col("quality_score") * F.col("detection_confidence"), F.lit(1 / 3))


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def _cluster_numbers(texts: list[str]) -> list[int]:
    """Single-link clusters: the number of each text's first neighbour in reach."""
    number = list(range(len(texts)))
    distinct = list(dict.fromkeys(texts))
    near = {(a, b) for i, a in enumerate(distinct) for b in distinct[i:] if _distance(a, b) <= MOST_EDITS}
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            if ((a, texts[j]) in near or (texts[j], a) in near) and number[i] != number[j]:
                low, high = sorted((number[i], number[j]))
                number = [low if n == high else n for n in number]
    return number


def cluster(observations: DataFrame) -> DataFrame:
    """Observations with `cluster`: those of a track that a chain of readings at most two edits apart connects.

    Rows without text are left out; partial readings too, where the track has a full one. A track has at most 64 rows
    (the newest count), which bounds what a task holds; everything after this is plain aggregation.
    """
    useful = observations.where("compact <> '' AND normalized <> ''")
    full = F.max(F.when(~F.col("partial"), 1).otherwise(0)).over(Window.partitionBy("track_id"))
    newest = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("frame_id")))
    useful = useful.withColumn("_full", full).where("_full = 0 OR NOT partial").withColumn("_n", newest).where(F.col("_n") <= MOST_OBSERVATIONS).drop("_full", "_n")

    names = useful.columns

    def number(key, track: dict) -> list[tuple]:
        return list(zip(*[track[c] for c in names], _cluster_numbers(track["compact"]), strict=True))

    return map_groups(useful, ["track_id"], ["frame_id"], number, ", ".join(f"`{n}` {k}" for n, k in useful.dtypes) + ", `cluster` int")


def consensus(clustered: DataFrame) -> DataFrame:
    """(track_id, cluster, consensus, agreement): each position's heaviest character among texts of the usual length.

    The usual length is the most frequent, of equals the longer; of equal characters the one seen first wins.
    """
    by = ["track_id", "cluster"]
    usual = clustered.groupBy(*by, F.length("compact").alias("_len")).agg(F.count("*").alias("_n")).groupBy(*by).agg(F.max_by("_len", F.struct("_n", "_len")).alias("_len"))
    letters = clustered.join(usual, by).where(F.length("compact") == F.col("_len")).select(*by, "frame_id", reliability().alias("w"), F.posexplode(F.split("compact", "")).alias("at", "letter"))
    votes = letters.groupBy(*by, "at", "letter").agg(F.sum("w").alias("w"), F.min("frame_id").alias("first"))
    best = votes.groupBy(*by, "at").agg(F.max_by("letter", F.struct(F.round("w", 12), -F.col("first"))).alias("letter"), (F.max("w") / F.sum("w")).alias("share"))
    return best.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "").alias("consensus"), F.avg(F.coalesce("share", F.lit(0.0))).alias("agreement"))


def vote(observations: DataFrame) -> DataFrame:
    """One plate for each track (track_id, raw, compact, normalized, confidence, observations, partial).

    Columns of observations: track_id, frame_id, raw, compact, normalized, partial, ocr_confidence, quality_score,
    detection_confidence. The best cluster by score and size gives the consensus, which is normalized again; where that
    fails, its most reliable reading is. Tracks without a valid plate have no row.
    """
    c, by = cluster(observations), ["track_id", "cluster"]
    total = F.sum("n").over(Window.partitionBy("track_id"))
    sums = c.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ocr_confidence").alias("ocr"), F.avg("quality_score").alias("quality"), F.avg("detection_confidence").alias("detection"), F.max_by("compact", F.struct(reliability(), -F.col("frame_id"))).alias("fallback"))
    scored = sums.join(consensus(c), by).withColumn("frequency", F.col("n") / total)
    score = sum((F.col(k if k != "consensus" else "agreement") * w for k, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    scored = scored.withColumn("score", score)
    best = scored.groupBy("track_id").agg(F.max_by(F.struct("cluster", "n", "score", "agreement", "consensus", "fallback"), F.struct(F.round("score", 12), "n", -F.col("cluster"))).alias("b")).select("track_id", "b.*")
    best = plates.add_normalized(plates.add_normalized(best, "consensus", "_c", True), "fallback", "_f", True)
    best = best.withColumn("_p", F.when(F.col("_c.valid"), F.col("_c")).otherwise(F.col("_f"))).where("_p.valid")
    support = 1 - F.exp(-F.col("n") / max(LEAST_OBSERVATIONS, 1))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(0.999), F.col("score") + (1 - F.col("score")) * 0.15 * support * F.col("agreement")))
    best = best.withColumn("confidence", confidence)
    nearest = F.struct(F.levenshtein("compact", F.col("_p.compact")), -reliability(), "frame_id")
    raws = c.join(best.select("track_id", "cluster", "_p"), by).groupBy("track_id").agg(F.min_by("raw", nearest).alias("raw"))
    return best.join(raws, "track_id").select("track_id", "raw", F.col("_p.compact").alias("compact"), F.col("_p.normalized").alias("normalized"), "confidence", F.col("n").alias("observations"), F.col("_p.partial").alias("partial"))


def vehicle_type(frames: DataFrame) -> DataFrame:
    """Type of the highest summed confidence for each track, of equals the first seen; mean confidence over frames."""
    sums = frames.groupBy("track_id", "vehicle_type").agg(F.sum("confidence").alias("_s"), F.min("frame_id").alias("_first"), F.count("*").alias("_n"))
    return sums.groupBy("track_id").agg(F.max_by("vehicle_type", F.struct(F.round("_s", 12), -F.col("_first"))).alias("vehicle_type"), (F.sum("_s") / F.sum("_n")).alias("confidence"))


def best_frame(frames: DataFrame, score: str = "score") -> DataFrame:
    """The frame of the highest score for each track; of equals the earliest."""
    return frames.groupBy("track_id").agg(F.max_by("frame_id", F.struct(score, -F.col("frame_id"))).alias("frame_id"), F.max(score).alias(score))


def stable_at(observations: DataFrame, least: float, needed: int) -> DataFrame:
    """The frame at which a full reading has been seen `needed` times with enough confidence, for tracks where it has."""
    seen = observations.where(~F.col("partial") & (F.col("ocr_confidence") >= least)).withColumn("_n", F.count("*").over(Window.partitionBy("track_id", "normalized").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where(F.col("_n") >= needed).groupBy("track_id").agg(F.min("frame_id").alias("frame_id"), F.min_by("normalized", "frame_id").alias("normalized"))


def accepted_readings(attempts: DataFrame, keys: list[str], least: float, enough: float | None = None, allow_partial: bool = False) -> DataFrame:
    """The best reading of each crop: keys, variant, text, confidence, normalized, compact, partial.

    attempts: keys, variant (order of preparation), text, confidence. Readings that are sure enough and valid plates
    count, in order of variant up to the first of confidence `enough`; the best confidence wins, of equals the first.
    """
    good = plates.add_normalized(attempts.where(F.col("confidence") >= least), "text", "_p", allow_partial).where("_p.valid")
    if enough is not None:
        before = Window.partitionBy(*keys).orderBy("variant").rowsBetween(Window.unboundedPreceding, -1)
        good = good.withColumn("_done", F.max((F.col("confidence") >= enough).cast("int")).over(before)).where("coalesce(_done, 0) = 0")
    row = F.struct("variant", "text", "confidence", F.col("_p.normalized").alias("normalized"), F.col("_p.compact").alias("compact"), F.col("_p.partial").alias("partial"))
    return good.groupBy(*keys).agg(F.max_by(row, F.struct("confidence", -F.col("variant"))).alias("_r")).select(*keys, "_r.*")


def due_frames(frames: DataFrame, interval: int, stable: DataFrame | None = None) -> DataFrame:
    """(track_id, frame_id) of the frames on which a reading is tried: the first, then the first `interval` frames or more on.

    frames: track_id, frame_id, seen (frames of the track so far) for each frame that shows a plate. After a track's
    stable frame (track_id, frame_id as stable_at returns) none is tried. Only the last try of a track is held.
    """
    rows = frames.select("track_id", "frame_id", "seen")
    if stable is not None:
        rows = rows.join(stable.select("track_id", F.col("frame_id").alias("_stable")), "track_id", "left").where("_stable IS NULL OR frame_id <= _stable").drop("_stable")

    def step(last: tuple, row: tuple):
        track, frame, seen = row
        due = last[0] is None or seen - last[0] >= interval
        return (seen,) if due else last, (track, frame) if due else None

    return fold(rows, ["track_id"], ["frame_id"], Machine((None,), step, "track_id string, frame_id long"))


def finalize(tracks: DataFrame, points: DataFrame, observations: DataFrame, line, positive_to_negative: str = "ENTER") -> DataFrame:
    """The event of each finished track: direction, type, voted plate, status, media key and an id that a rerun gives again.

    tracks: track_id, camera_id, last_seen, vehicle_type, vehicle_confidence, frames, plate_detections; points and
    observations as crossing and vote take them. A track without points has direction UNKNOWN, without a plate none.
    """
    from platehouse.functions import ids, scalars

    seen = observations.groupBy("track_id").agg(F.count("*").alias("plate_observations"))
    voted = vote(observations).select("track_id", F.struct("raw", "normalized", "confidence", "observations", "partial").alias("plate"))
    rows = tracks.join(crossing(points, line, positive_to_negative), "track_id", "left").join(voted, "track_id", "left").join(seen, "track_id", "left")
    direction = F.coalesce("direction", F.lit("UNKNOWN"))
    rows = rows.withColumns({"direction": direction, "event_type": scalars.type_of(direction)})
    rows = rows.withColumn("id", F.concat(F.lit("evt_"), ids.uuid5(F.concat_ws("|", "track_id", "event_type", scalars.iso(F.col("last_seen"))))))
    status = scalars.status_of(F.col("plate").isNull(), F.coalesce("plate_detections", F.lit(0)), F.coalesce("plate.partial", F.lit(False)), F.col("plate.confidence"))
    return rows.select("id", "track_id", "camera_id", "event_type", F.col("last_seen").alias("occurred_at"), "direction", status.alias("status"), "vehicle_type", scalars.clamp(F.col("vehicle_confidence"), 0.0, 1.0).alias("vehicle_confidence"), "plate",
                       scalars.media_key(F.col("last_seen"), F.col("camera_id"), F.col("id"), "snapshot").alias("snapshot_key"), "frames", "plate_detections", F.coalesce("plate_observations", F.lit(0)).alias("plate_observations"))


def crossing(points: DataFrame, line, positive_to_negative: str = "ENTER", fallback: str = "UNKNOWN") -> DataFrame:
    """(track_id, direction): the first crossing of a directed line, seen against the last side that was not on the line."""
    from platehouse.functions.geometry import signed_side

    opposite = "EXIT" if positive_to_negative == "ENTER" else "ENTER"
    order = Window.partitionBy("track_id").orderBy("frame_id")
    sides = points.withColumn("_side", signed_side(F.col("x"), F.col("y"), line)).withColumn("_n", F.row_number().over(order))
    before = F.last(F.when((F.col("_side") != 0) | (F.col("_n") == 1), F.col("_side")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    turned = sides.withColumn("_before", before).withColumn("_turn", F.when((F.col("_before") > 0) & (F.col("_side") <= 0), positive_to_negative).when((F.col("_before") < 0) & (F.col("_side") >= 0), opposite))
    first = F.min_by("_turn", F.when(F.col("_turn").isNotNull(), F.col("frame_id")))
    return turned.groupBy("track_id").agg(F.coalesce(first, F.lit(fallback)).alias("direction"))


def sessions(observations: DataFrame, ticks: DataFrame, gap_seconds: float = 2.0) -> DataFrame:
    """Observations with `session`: a track closes when a tick of its camera and epoch comes gap_seconds after its last row.

    Ticks (camera_id, epoch, at) are all frames and heartbeats. The tick just before a row decides: if it came that long
    after the previous row, the track had been closed. All times are put in one order and dealt into ranges of it, so a
    camera of very many ticks is many windows; the last tick so far is a running maximum, carried from range to range, and
    no pairs are made.
    """
    by = ["camera_id", "epoch"]
    both = observations.select(*by, "track_id", F.col("at"), F.lit(1).alias("_kind")).unionByName(ticks.select(*by, F.lit(None).cast("string").alias("track_id"), "at", F.lit(0).alias("_kind")))
    # ticks strictly before a row: number the distinct times, take the previous one's latest tick
    times = both.groupBy(*by, "at").agg(F.max(F.when(F.col("_kind") == 0, F.col("at"))).alias("_tick"))
    n_ranges = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = staged(times.repartitionByRange(n_ranges, *by, "at").withColumn("_part", F.spark_partition_id()), "times")
    ahead = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = times.groupBy(*by, "_part").agg(F.max("_tick").alias("_most")).withColumn("_carried", F.max("_most").over(ahead(by, "_part"))).drop("_most")  # a row for each camera, epoch and range that they share
    inside = times.withColumn("_in", F.max("_tick").over(ahead([*by, "_part"], "at")))
    earlier = inside.join(carried, [*by, "_part"]).select(*by, "at", F.greatest("_in", "_carried").alias("_before"))
    track = Window.partitionBy(*by, "track_id").orderBy("at")
    rows = observations.join(earlier, [*by, "at"], "left").withColumn("_last", F.lag("at").over(track))
    late = F.timestamp_diff("MICROSECOND", F.col("_last"), F.col("_before")) >= int(gap_seconds * 1_000_000)
    opened = F.when(F.col("_last").isNull() | F.coalesce(late, F.lit(False)), 1).otherwise(0)
    return rows.withColumn("session", F.sum(opened).over(track.rowsBetween(Window.unboundedPreceding, 0))).drop("_before", "_last")
