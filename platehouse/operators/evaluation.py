"""Evaluation of readers and detectors: accuracy, calibration, greedy matching, average precision, suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platehouse.functions.geometry import overlap
from platehouse.functions.grouping import map_arrays, parts_for
from platehouse.functions.scalars import ratio
from platehouse.functions.scratch import staged

IOU_THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def ocr_metrics(records: DataFrame, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """samples, exact_accuracy, character_accuracy and expected_calibration_error of (label, predicted, confidence)."""
    by = by or []
    hit = (F.col("predicted") == F.col("label")).cast("int")
    r = records.withColumn("_hit", hit).withColumn("_bin", F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)))
    cells = r.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.sum("_hit").alias("_hits"), F.sum("confidence").alias("_conf"), F.sum(F.levenshtein("predicted", "label")).alias("_edits"), F.sum(F.greatest(F.length("predicted"), F.length("label"), F.lit(1))).alias("_chars"))
    gap = F.sum(F.abs(F.col("_hits") - F.col("_conf"))) / F.sum("_n")
    return cells.groupBy(*by).agg(F.sum("_n").alias("samples"), (F.sum("_hits") / F.sum("_n")).alias("exact_accuracy"), F.greatest(F.lit(0.0), 1 - F.sum("_edits") / F.sum("_chars")).alias("character_accuracy"), gap.alias("expected_calibration_error"))


def gate(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, in order; a check that is null does not fail."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))


def _ious(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """IoU of a box [x, y, w, h] with others."""
    low, high = np.maximum(box[:2], boxes[:, :2]), np.minimum(box[:2] + box[2:], boxes[:, :2] + boxes[:, 2:])
    common = np.clip(high - low, 0, None).prod(axis=1)
    union = box[2] * box[3] + boxes[:, 2] * boxes[:, 3] - common
    return np.divide(common, union, out=np.zeros(len(boxes)), where=union > 0)


#: Pairs of a prediction and a truth that are compared at once.
MOST_PAIRS = 2_000_000


def _near(n_truths: np.ndarray, n_predictions: np.ndarray, truths: np.ndarray, predictions: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prediction, truth, IoU) of the pairs within groups that overlap by `least`; pairs are made MOST_PAIRS at a time."""
    each = np.repeat(n_truths, n_predictions)
    first = np.repeat(np.cumsum(n_truths) - n_truths, n_predictions)
    upto = np.cumsum(each)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    start = 0
    while start < len(each):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + MOST_PAIRS, "right")))
        n = each[start:end]
        p = np.repeat(np.arange(start, end), n)
        t = np.repeat(first[start:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        one, other = predictions[p], truths[t]
        low, high = np.maximum(one[:, :2], other[:, :2]), np.minimum(one[:, :2] + one[:, 2:], other[:, :2] + other[:, 2:])
        common = np.clip(high - low, 0, None).prod(axis=1)
        union = one[:, 2] * one[:, 3] + other[:, 2] * other[:, 3] - common
        iou = np.divide(common, union, out=np.zeros(len(p)), where=union > 0)
        near = iou >= least
        out.append((p[near], t[near], iou[near]))
        start = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _greedy(n_truths: np.ndarray, n_predictions: np.ndarray, truths: np.ndarray, predictions: np.ndarray, thresholds: tuple[float, ...], later: bool = True) -> np.ndarray:
    """For each prediction and threshold the number of the truth that it takes, or -1. Boxes lie group by group, predictions
    in the order in which they choose. Of equals the later truth counts, or the earlier. Round by round, the next prediction
    of every group chooses, all at once; a group of more than MOST_PAIRS pairs is walked through by itself."""
    taken = np.full((len(predictions), len(thresholds)), -1, np.int64)
    large = n_truths * n_predictions > MOST_PAIRS
    if large.any():
        first_t, first_p = (np.cumsum(n) - n for n in (n_truths, n_predictions))
        for g in np.flatnonzero(large):
            t, p = slice(first_t[g], first_t[g] + n_truths[g]), slice(first_p[g], first_p[g] + n_predictions[g])
            found = _walk(truths[t], predictions[p], thresholds, later)
            taken[p] = np.where(found < 0, -1, found + t.start)
    p, t, iou = _near(np.where(large, 0, n_truths), n_predictions, truths[~np.repeat(large, n_truths)], predictions, min(thresholds))
    if large.any():
        t = np.flatnonzero(~np.repeat(large, n_truths))[t]
    order = np.lexsort((-t if later else t, -iou, p))  # each prediction's best pair first
    p, t, iou = p[order], t[order], iou[order]
    turn = (np.arange(len(predictions)) - np.repeat(np.cumsum(n_predictions) - n_predictions, n_predictions))[p]
    by_turn = np.argsort(turn, kind="stable")
    ends = np.cumsum(np.bincount(turn)) if len(turn) else np.zeros(0, np.int64)
    p, t, iou = p[by_turn], t[by_turn], iou[by_turn]
    for k, threshold in enumerate(thresholds):
        free = np.ones(len(truths), bool)
        start = 0
        for end in ends:
            rows = np.flatnonzero((iou[start:end] >= threshold) & free[t[start:end]]) + start
            first = rows[np.flatnonzero(np.diff(p[rows], prepend=-1))]  # the best that is left for each
            taken[p[first], k] = t[first]
            free[t[first]] = False
            start = end
    return taken


def _walk(truths: np.ndarray, predictions: np.ndarray, thresholds: tuple[float, ...], later: bool) -> np.ndarray:
    """The same for one group, a prediction at a time, so that no more than its pairs are held."""
    taken, free = np.full((len(predictions), len(thresholds)), -1, np.int64), np.ones((len(truths), len(thresholds)), bool)
    for i, box in enumerate(predictions):
        iou = np.nan_to_num(_ious(box, truths), nan=-1.0)
        for k, threshold in enumerate(thresholds):
            left = np.where(free[:, k] & (iou >= threshold), iou, -1.0)
            best = len(left) - 1 - int(np.argmax(left[::-1])) if later else int(np.argmax(left))
            if left[best] >= 0:
                taken[i, k], free[best, k] = best, False
    return taken


def _sides(box: Column) -> list[Column]:
    """The four numbers of a box as columns."""
    return [box[i].cast("double").alias(f"_b{i}") for i in range(4)]


def _boxes(rows: pa.Table) -> np.ndarray:
    return np.column_stack([rows[f"_b{i}"].to_numpy() for i in range(4)])


def match_all(truths: DataFrame, predictions: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(prediction_id, image_id, category_id, score, truth_ids): one-to-one matches, highest score first, for each threshold.

    truths: id, image_id, category_id, bbox [x, y, w, h]; predictions also score. A prediction takes the best free truth
    of its image and category from the threshold on; of equals the later. Spark deals and sorts images; a task takes them
    by the batch, as columns of numbers, and holds the image at a batch's end until the next.
    """
    by = ["image_id", "category_id"]

    def matched(group: np.ndarray, rows: pa.Table) -> pa.Table:
        is_truth = rows["score"].is_null().to_numpy()
        boxes = _boxes(rows)
        counts = [np.bincount(group[some], minlength=group[-1] + 1) for some in (is_truth, ~is_truth)]
        taken = _greedy(*counts, boxes[is_truth], boxes[~is_truth], thresholds).ravel()
        out, ids = rows.filter(pa.array(~is_truth)), rows["id"].filter(pa.array(is_truth)).combine_chunks()
        found = ids.take(pa.array(taken, mask=taken < 0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(taken) + 1, len(thresholds), dtype=np.int32)), found)
        return out.select(["id", *by, "score"]).rename_columns(["prediction_id", *by, "score"]).append_column("truth_ids", lists)

    # truths have no score and come first, in order of id
    longs = [F.col(c).cast("long").alias(c) for c in ("id", *by)]
    sides = lambda rows, score: rows.select(*longs, *_sides(F.col("bbox")), score.cast("double").alias("score"))
    both = sides(truths, F.lit(None)).unionByName(sides(predictions.where("score IS NOT NULL"), F.col("score")))
    return map_arrays(both, by, [F.desc_nulls_first("score"), "id"], matched, "prediction_id long, image_id long, category_id long, score double, truth_ids array<long>")


def match(truths: DataFrame, predictions: DataFrame, thresholds: tuple[float, ...] = (0.5,)) -> DataFrame:
    """The matches of match_all with a row for each threshold: threshold, prediction_id, image_id, category_id, score, truth_id."""
    found = match_all(truths, predictions, thresholds)
    each = F.inline(F.arrays_zip(F.array(*[F.lit(t) for t in thresholds]).alias("threshold"), F.col("truth_ids").alias("truth_id")))
    return found.select(each.alias("threshold", "truth_id"), "prediction_id", "image_id", "category_id", "score").select("threshold", "prediction_id", "image_id", "category_id", "score", "truth_id")


def precision_recall(matches: DataFrame, truths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """True and false positives, precision and recall, in total or by class."""
    by = by or []
    found = matches.groupBy("threshold", *by).agg(F.count("truth_id").alias("true_positives"), F.count_if(F.col("truth_id").isNull()).alias("false_positives"))
    there = truths.groupBy(*by).agg(F.count("*").alias("truths"))
    out = found.join(there, by, "left") if by else found.crossJoin(there)  # one row without classes
    out = out.fillna(0, ["truths"])
    return out.withColumn("precision", ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives"))).withColumn("recall", ratio(F.col("true_positives"), F.col("truths")))


def average_precision(truths: DataFrame, predictions: DataFrame, thresholds: tuple[float, ...] = IOU_THRESHOLDS) -> DataFrame:
    """(threshold, category_id, average_precision): mean over recalls 0, .01 ... 1 of the best precision from there on.

    The order of predictions is the same for every threshold, so one row of each carries the hits at all thresholds.
    Predictions are dealt into ranges of score once, so that a class of a third of all rows is many windows: each range
    adds the counts of those before it, and the best precision of those behind it. Each step of recall is reached first
    by one prediction, so the 101 recalls are sums over predictions instead of a join: best precision from a prediction
    on, times the number of recalls that it is the first to reach.
    """
    spark, by = truths.sparkSession, ["category_id", "_part"]
    at = range(len(thresholds))
    there = truths.groupBy("category_id").agg(F.count("*").alias("_truths"))
    mask = sum((F.when(F.col("truth_ids")[i].isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i in at), F.lit(0))
    # staged before it is dealt by score, since borders are found by a look at all rows
    hits = staged(match_all(truths, predictions, thresholds).select("category_id", "score", "prediction_id", mask.alias("_mask")), "matched")
    n = parts_for(spark, hits.count(), RANGE)
    hits = staged(hits.repartitionByRange(n, F.desc("score"), "prediction_id").withColumn("_part", F.spark_partition_id()), "hits")
    # one row for each range and class
    sums = staged(hits.groupBy(*by).agg(F.count("*").alias("_rows"), *[F.sum(F.getbit("_mask", F.lit(i)).cast("int")).alias(f"_hits{i}") for i in at]), "sums")
    earlier = Window.partitionBy("category_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("double")
    ahead = sums.join(there, "category_id").select(*by, F.array(F.col("_truths").cast("double"), over("_rows"), *[over(f"_hits{i}") for i in at]).alias("_ahead"))

    def walked(facts: DataFrame, function) -> DataFrame:
        """function(facts, hits by threshold) -> numbers by threshold, for each range's part of each class."""
        row = facts.select(*by, F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("prediction_id"), F.lit(None).cast("int").alias("_mask"), "_facts")
        rows = hits.select(*by, F.lit(1).alias("_kind"), "score", "prediction_id", "_mask", F.lit(None).cast("array<double>").alias("_facts"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            known = None

            def done() -> pa.RecordBatch:
                masks = np.concatenate(held) if held else np.zeros(0, np.int64)
                found = function(np.array(known["_facts"]), (masks[:, None] >> np.arange(len(thresholds))) & 1)
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array([known["category_id"]], pa.int64()), pa.array([known["_part"]], pa.int32()), pa.array([list(found)], pa.list_(pa.float64()))], ["category_id", "_part", "_found"])

            for batch in batches:
                kinds, parts, masks = (batch[c].fill_null(0).to_numpy() for c in ("_kind", "_part", "_mask"))
                classes, without = batch["category_id"].fill_null(0).to_numpy(), batch["category_id"].is_null().to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(kinds == 0)
                for i, j in zip(np.append(0, starts), np.append(starts, len(kinds)), strict=True):
                    if i < j and kinds[i] == 0:
                        if known is not None:
                            yield done()
                        known, i = batch.slice(i, 1).to_pylist()[0], i + 1
                    if known is not None and i < j:  # rows of a class without truths have no facts
                        own = (classes[i:j] == known["category_id"]) & ~without[i:j] & (parts[i:j] == known["_part"])
                        held.append(masks[i:j][own].astype(np.int64))
            if known is not None:
                yield done()

        dealt = row.unionByName(rows).repartitionById(n, F.col("_part")).sortWithinPartitions("_part", "category_id", "_kind", F.desc("score"), "prediction_id")
        return dealt.select("category_id", "_part", "_kind", "_mask", "_facts").mapInArrow(run, "category_id long, _part int, _found array<double>")

    def precision(facts: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rank = facts[1] + 1 + np.arange(len(hit))
        true = facts[2 : 2 + len(thresholds)] + np.cumsum(hit, axis=0)
        return rank, true, true / rank[:, None]

    def shares(facts: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Best precision from each prediction on, times the recalls that it is the first to reach, over 101."""
        rank, true, now = precision(facts, hit)
        best = np.maximum(np.maximum.accumulate(now[::-1], axis=0)[::-1], facts[2 + len(thresholds) :])
        reached = lambda tp: np.where(tp > 0, np.floor(100 * tp / facts[0] + 1e-9) + 1, 1)
        steps = reached(true) - np.where(rank[:, None] == 1, 0, reached(true - hit))
        return (best * steps).sum(axis=0) / 101

    most = staged(walked(ahead.withColumnRenamed("_ahead", "_facts"), lambda facts, hit: precision(facts, hit)[2].max(axis=0, initial=0.0)), "precision")
    later = Window.partitionBy("category_id").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    behind = most.select(*by, F.array(*[F.coalesce(F.max(F.col("_found")[i]).over(later), F.lit(0.0)) for i in at]).alias("_later"))
    found = walked(ahead.join(behind, by).select(*by, F.concat("_ahead", "_later").alias("_facts")), shares)
    found = found.groupBy("category_id").agg(F.array(*[F.sum(F.col("_found")[i]) for i in at]).alias("_ap"))
    every = there.join(found, "category_id", "left").select("category_id", F.inline(F.arrays_zip(F.array(*[F.lit(t) for t in thresholds]), F.coalesce("_ap", F.array(*[F.lit(0.0) for _ in at])))).alias("threshold", "average_precision"))
    return every.select("threshold", "category_id", "average_precision")


#: Predictions of one range of score; a task holds numbers for each of them and each threshold.
RANGE = 250_000


def mean_average_precision(aps: DataFrame) -> DataFrame:
    """map50 and map50_95 over classes with truths."""
    return aps.agg(F.avg(F.when(F.col("threshold") == 0.5, F.col("average_precision"))).alias("map50"), F.avg("average_precision").alias("map50_95"))


def recall_by(matches: DataFrame, truths: DataFrame, images: DataFrame, attribute: Column) -> DataFrame:
    """Recall of truths in slices of their images' attribute."""
    found = matches.where("truth_id IS NOT NULL").select(F.col("truth_id").alias("id")).distinct().withColumn("_found", F.lit(1))
    sliced = truths.join(images.select(F.col("id").alias("image_id"), attribute.alias("slice")), "image_id", "left").join(found, "id", "left")
    return sliced.groupBy("slice").agg(F.count("*").alias("truths"), F.count("_found").alias("found"), ratio(F.count("_found"), F.count("*")).alias("recall"))


def group_recall(matches: DataFrame, truths: DataFrame, images: DataFrame) -> DataFrame:
    """Groups with a match over groups with a truth."""
    found = matches.where("truth_id IS NOT NULL").select(F.col("truth_id").alias("id")).distinct()
    grouped = truths.join(images.select(F.col("id").alias("image_id"), "group_id"), "image_id")
    hit = grouped.join(found, "id", "left_semi").agg(F.countDistinct("group_id").alias("found"))
    return grouped.agg(F.countDistinct("group_id").alias("groups")).crossJoin(hit).withColumn("group_recall", ratio(F.col("found"), F.col("groups")))  # one row each


def full_coverage(matches: DataFrame, truths: DataFrame, predictions: DataFrame, least: float = 0.95) -> DataFrame:
    """(truths, covered, full_bbox_coverage): truths of whose area their own match covers `least` or more, over all truths.

    matches: prediction_id, truth_id at one threshold. A truth without an area is covered by nothing.
    """
    side = lambda rows, key, name: rows.select(F.col("id").alias(key), F.col("bbox").alias(name))
    both = matches.where("truth_id IS NOT NULL").select("prediction_id", "truth_id").join(side(predictions, "prediction_id", "_p"), "prediction_id").join(side(truths, "truth_id", "_t"), "truth_id")
    span = lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3])
    area = F.col("_t")[2] * F.col("_t")[3]
    share = overlap(*span(F.col("_p")), *span(F.col("_t"))) / F.when(area > 0, area)
    found = both.agg(F.count_if(share >= least).alias("covered"))
    return truths.agg(F.count("*").alias("truths")).crossJoin(found).withColumn("full_bbox_coverage", ratio(F.col("covered"), F.col("truths")))  # one row each


def suppress(boxes: DataFrame, threshold: float, class_agnostic: bool = False) -> DataFrame:
    """Boxes (id, image_id, category_id, bbox corners, score) that survive: a better one of its class overlaps none more."""
    names, more = boxes.columns, float(np.nextafter(threshold, np.inf))

    def keep(group: np.ndarray, rows: pa.Table) -> pa.Table:
        corners = _boxes(rows)
        xywh = np.concatenate((corners[:, :2], np.clip(corners[:, 2:] - corners[:, :2], 0, None)), axis=1)
        kind = np.zeros(len(xywh), np.int64) if class_agnostic else rows["category_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        alive, n = np.ones(len(xywh), bool), np.bincount(group)
        first, large = np.cumsum(n) - n, n * n > MOST_PAIRS
        for g in np.flatnonzero(large):  # an image of very many boxes is walked through by itself
            end = first[g] + n[g]
            for i in range(first[g], end):
                if alive[i]:
                    alive[i + 1 : end] &= ~((_ious(xywh[i], xywh[i + 1 : end]) > threshold) & (kind[i + 1 : end] == kind[i]))
        some = np.flatnonzero(~large[group])
        worse, better, _ = _near(n[~large], n[~large], xywh[some], xywh[some], more)
        worse, better = some[worse], some[better]
        pairs = (better < worse) & (kind[better] == kind[worse])
        worse, better = worse[pairs], better[pairs]
        turn = better - first[group[better]]
        order = np.argsort(turn, kind="stable")
        worse, better, start = worse[order], better[order], 0
        for end in np.cumsum(np.bincount(turn)) if len(turn) else ():  # round by round, the next box of every image
            alive[worse[start:end][alive[better[start:end]]]] = False
            start = end
        return rows.filter(pa.array(alive)).select(names)

    sides = boxes.select("*", *_sides(F.col("bbox")))
    return map_arrays(sides, ["image_id"], [F.desc("score"), "id"], keep, ", ".join(f"`{n}` {k}" for n, k in boxes.dtypes))


def associate(tracks: DataFrame, detections: DataFrame) -> DataFrame:
    """(frame_id, track_id, detection_id): each track takes its best overlapping detection, each detection used once."""

    def take(group: np.ndarray, rows: pa.Table) -> pa.Table:
        boxes, found = _boxes(rows), rows["track_id"].is_null().to_numpy()  # detections come first
        counts = [np.bincount(group[some], minlength=group[-1] + 1) for some in (found, ~found)]
        taken = _greedy(*counts, boxes[found], boxes[~found], (float(np.nextafter(0, 1)),), later=False)[:, 0]
        ids, out = rows["detection_id"].filter(pa.array(found)).combine_chunks(), rows.filter(pa.array(~found)).select(["frame_id", "track_id"])
        return out.append_column("detection_id", ids.take(pa.array(taken, mask=taken < 0)))

    side = lambda rows, track, detection: rows.select(F.col("frame_id").cast("long").alias("frame_id"), track.cast("long").alias("track_id"), detection.cast("long").alias("detection_id"), *_sides(F.col("bbox")))
    both = side(tracks, F.col("track_id"), F.lit(None)).unionByName(side(detections, F.lit(None), F.col("detection_id")))
    return map_arrays(both, ["frame_id"], [F.asc_nulls_first("track_id"), "detection_id"], take, "frame_id long, track_id long, detection_id long")
