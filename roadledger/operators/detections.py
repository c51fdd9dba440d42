"""Operators over the boxes of a frame: splitting, contradictions, attribution, image summaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadledger.config import Config
from roadledger.functions import geometry, plates

FRAME = ("video_id", "frame_idx")


def video_class(label: Column) -> Column:
    """In videos everything but three labels counts as a worn helmet."""
    return F.when(label.isin("Plate", "WithoutHelmet", "TripleRiding"), label).otherwise("WithHelmet")


def confident(dets: DataFrame, least: float) -> DataFrame:
    return dets.where(F.col("conf") >= least)


def capped(frames: DataFrame, most: int | None) -> DataFrame:
    """Frames up to a number; none or 0 means all."""
    return frames.where(F.col("frame_idx") <= most) if most else frames


def uncontradicted(without: DataFrame, helmets: DataFrame, threshold: float = Config.contradiction_iou) -> DataFrame:
    """Boxes without a helmet that no helmet box of their frame overlaps by more than threshold.

    A left anti join on the frame with the overlap as further condition; only the boxes of one
    frame meet.
    """
    other = helmets.select(*(F.col(c).alias(f"h_{c}") for c in (*FRAME, *geometry.SIDES)))
    same = [without[c] == other[f"h_{c}"] for c in FRAME]
    return without.join(other, [*same, geometry.overlap(geometry.box(), geometry.box("h_")) > threshold], "left_anti")


def nearest(boxes: DataFrame, targets: DataFrame, target_id: str) -> DataFrame:
    """Each box with the target of its frame whose centre is nearest; ties to the smaller id; none: dropped."""
    other = targets.select(*(F.col(c).alias(f"t_{c}") for c in (*FRAME, *geometry.SIDES)), F.col(target_id).alias("near_id"))
    mid = lambda p: (geometry.centre(F.col(p + "x1"), F.col(p + "x2")), geometry.centre(F.col(p + "y1"), F.col(p + "y2")))
    pairs = boxes.join(other, [boxes[c] == other[f"t_{c}"] for c in FRAME]).withColumn("distance", geometry.distance(*mid(""), *mid("t_")))
    order = Window.partitionBy(*FRAME, "det_id").orderBy("distance", "near_id")
    return pairs.withColumn("place", F.row_number().over(order)).where("place = 1").select(*boxes.columns, "near_id", "distance")


KINDS = ("Plate", "WithHelmet", "WithoutHelmet", "TripleRiding")
#: Pairs of boxes that are compared at a time.
PAIRS = 500_000


def attributed(dets: DataFrame, targets: DataFrame, target_id: str, *more: str, threshold: float = Config.contradiction_iou) -> DataFrame:
    """(frame, det_id, label, near_id, distance, *more): uncontradicted boxes without a helmet and triple riders, with their nearest target.

    What uncontradicted and nearest do one after the other, in a single shuffle of boxes and targets by
    frame; the boxes of whole frames are compared as Arrow batches. more: columns of the target that
    come along.
    """
    label = video_class(F.col("label"))
    number = F.coalesce(*(F.when(label == k, n) for n, k in enumerate(KINDS)))
    whole = [F.col(c) for c in (*FRAME, *geometry.SIDES)]
    of = {f.name: f.dataType for f in targets.schema}
    boxes = dets.where(label != "Plate").select(*whole, number.alias("kind"), F.col("det_id").alias("id"), *(F.lit(None).cast(of[c]).alias(c) for c in more))
    rows = boxes.unionByName(targets.select(*whole, F.lit(0).alias("kind"), F.col(target_id).alias("id"), *more))
    known = rows.where(F.col("video_id").isNotNull() & F.col("frame_idx").isNotNull())
    ordered = known.repartition(*FRAME).sortWithinPartitions("frame_idx", "video_id")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{c} {types[c]}" for c in FRAME), f"det_id {types['id']}, kind int, near_id {types['id']}, distance double", *(f"{c} {types[c]}" for c in more)])
    near = ordered.mapInArrow(lambda batches: (out for batch in _whole_frames(batches) for out in _attribute(batch, threshold, more)), schema)
    name = F.when(F.col("kind") == 2, KINDS[2]).otherwise(KINDS[3])
    return near.select(*FRAME, "det_id", name.alias("label"), "near_id", "distance", *more)


def _frame_starts(batch: pa.RecordBatch) -> np.ndarray:
    keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in FRAME]
    return np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))


def _whole_frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut only between frames."""
    tail: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if tail is not None:
            batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        cut = int(_frame_starts(batch)[-1])
        tail = batch.slice(cut)
        if cut:
            yield batch.slice(0, cut)
    if tail is not None:
        yield tail


def _pairs(mine: np.ndarray, other: np.ndarray, frame: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of mine and of other of the same frame, all of a row of mine together."""
    begin, end = np.searchsorted(frame[other], frame[mine]), np.searchsorted(frame[other], frame[mine], "right")
    count = end - begin
    total = np.cumsum(count)
    at = 0
    while at < len(mine):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = count[at:to]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(mine[at:to], n), other[np.repeat(begin[at:to], n) + inside]
        at = to


def _attribute(batch: pa.RecordBatch, threshold: float, more: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The attributed boxes of whole frames. An unknown overlap contradicts nothing, an unknown distance is the least."""
    starts = _frame_starts(batch)
    frame = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
    kind = batch.column("kind").to_numpy(zero_copy_only=False)
    x1, y1, x2, y2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in geometry.SIDES)
    number = batch.column("id").to_numpy(zero_copy_only=False)
    target, helmet, bare = (np.flatnonzero(kind == k) for k in range(3))
    counted = kind >= 2
    area = (x2 - x1) * (y2 - y1)
    for a, b in _pairs(bare, helmet, frame):
        shared = np.maximum(0, np.minimum(x2[a], x2[b]) - np.maximum(x1[a], x1[b])) * np.maximum(0, np.minimum(y2[a], y2[b]) - np.maximum(y1[a], y1[b]))
        with np.errstate(divide="ignore", invalid="ignore"):
            over = np.where(shared == 0, 0.0, shared / (area[a] + area[b] - shared)) > threshold
        counted[a[over]] = False
    mx, my = (x1 + x2) / 2.0, (y1 + y2) / 2.0
    for a, b in _pairs(np.flatnonzero(counted), target, frame):
        if not len(a):
            continue
        far = np.sqrt((mx[a] - mx[b]) * (mx[a] - mx[b]) + (my[a] - my[b]) * (my[a] - my[b]))
        order = np.lexsort((number[b], np.where(np.isnan(far), -1.0, far), a))
        first = order[np.append(True, np.diff(a[order]) > 0)]
        box, near = pa.array(a[first]), pa.array(b[first])
        columns = [*(batch.column(c).take(box) for c in FRAME), batch.column("id").take(box), batch.column("kind").take(box), batch.column("id").take(near), pa.array(far[first], from_pandas=True), *(batch.column(c).take(near) for c in more)]
        yield pa.RecordBatch.from_arrays(columns, [*FRAME, "det_id", "kind", "near_id", "distance", *more])


def image_plates(dets: DataFrame) -> DataFrame:
    """The text of each image's last plate box, even if that is empty."""
    last = dets.where("label = 'Plate'").groupBy(*FRAME).agg(F.max_by("ocr_texts", "det_id").alias("texts"))
    return last.select(*FRAME, plates.joined_text(F.col("texts")).alias("plate"))


def image_summary(dets: DataFrame, images: DataFrame, config: Config = Config()) -> DataFrame:
    """For each image: plate, violations in fixed order, number of detections. Labels must match exactly.

    An image's boxes meet in one row, so the detections are shuffled once.
    """
    sure = confident(dets, config.image_confidence)
    is_a = lambda k: F.col("label") == k
    boxes = lambda k: F.collect_list(F.when(is_a(k), F.struct(*geometry.SIDES)))
    texts = F.max_by("ocr_texts", F.when(is_a("Plate"), F.col("det_id")))
    counts = sure.groupBy(*FRAME).agg(boxes("WithoutHelmet").alias("without"), boxes("WithHelmet").alias("helmets"), F.bool_or(is_a("TripleRiding")).alias("triple"), F.count("*").alias("n_detections"), texts.alias("texts"))
    sides = lambda b: tuple(b[c] for c in geometry.SIDES)
    touches = lambda b: F.exists("helmets", lambda h: F.coalesce(geometry.overlap(sides(b), sides(h)) > config.contradiction_iou, F.lit(False)))
    whole = counts.select(*FRAME, F.exists("without", lambda b: ~touches(b)).alias("no_helmet"), "triple", "n_detections", plates.joined_text(F.col("texts")).alias("plate"))
    joined = images.select(*FRAME).join(whole, [*FRAME], "left")
    kinds = F.array(F.when(F.col("no_helmet"), "no_helmet"), F.when(F.col("triple"), "triple_riding"))
    return joined.select(*FRAME, "plate", F.filter(kinds, lambda v: v.isNotNull()).alias("violations"), F.coalesce("n_detections", F.lit(0).cast("bigint")).alias("n_detections"))


def first_sure_text(candidates: DataFrame, least: float = Config.ocr_confidence) -> DataFrame:
    """The first OCR candidate of each plate box above a confidence, if any. candidates: pos, text, prob."""
    sure = F.min_by("text", "pos").alias("text")
    return candidates.where(F.col("prob") > least).groupBy(*FRAME, "det_id").agg(sure)


def class_names(dets: DataFrame, classes: DataFrame) -> DataFrame:
    """Class numbers to labels; numbers without one are dropped. The dimension is of fixed size."""
    return dets.join(F.broadcast(classes), "class_id").withColumnRenamed("name", "label")


def image_fines(summary: DataFrame) -> DataFrame:
    """One row a violation of the images whose plate could be read."""
    return summary.where(plates.readable(F.col("plate")).isNotNull()).select(*FRAME, "plate", F.explode("violations").alias("violation"))
