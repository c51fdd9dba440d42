"""The flagship: violations of a video, from detections to fines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger import storage
from roadledger.config import Config
from roadledger.functions import names, plates
from roadledger.operators import confirm, detections, ledger, tracking
from roadledger.sources import ledger as ledger_table

SIDES = ("x1", "y1", "x2", "y2")


def tracks(dets: DataFrame, config: Config = Config(), text: Column | None = None) -> DataFrame:
    """Plate boxes with track_id and the plate's text: the joined OCR fragments, or another column."""
    text = plates.joined_text(F.col("ocr_texts")) if text is None else text
    boxes = dets.where("label = 'Plate'").select("video_id", "frame_idx", "det_id", *SIDES, text.alias("plate"))
    return tracking.track(boxes, config)


def overspeeds(tracked: DataFrame, config: Config = Config()) -> DataFrame:
    """Sightings of tracks that are too fast; none without a calibration."""
    if not config.calibrated():
        return tracked.where(F.lit(False)).withColumn("speed_kmh", F.lit(0).cast("bigint"))
    return confirm.speeds(tracked, "track_id", config).where(F.col("speed_kmh") > config.speed_limit)


def sightings(dets: DataFrame, tracked: DataFrame, config: Config = Config()) -> DataFrame:
    """(video_id, frame_idx, track_id, violation), one row for each box that counts."""
    kinds = []
    if config.calibrated():
        kinds.append(("overspeed", overspeeds(tracked, config)))
    near = detections.attributed(dets, tracked, "track_id", threshold=config.contradiction_iou)
    name = F.when(F.col("label") == "WithoutHelmet", "no_helmet").otherwise("triple_riding")
    seen = near.select("video_id", "frame_idx", F.col("near_id").alias("track_id"), name.alias("violation"))
    return seen.unionByName(confirm.united(*kinds)) if kinds else seen


def violations(dets: DataFrame, amounts: DataFrame, config: Config = Config(), tracked: DataFrame | None = None) -> DataFrame:
    """(video_id, frame_idx, track_id, violation, plate, amount, image_path): each confirmed violation once."""
    dets = detections.capped(dets, config.max_frames)
    tracked = storage.written(tracks(dets, config), "tracks") if tracked is None else tracked
    streak = confirm.streaks(sightings(dets, tracked, config), "track_id", "violation").where(F.col("streak") >= config.streak)
    texts = tracked.select("video_id", "frame_idx", "track_id", "plate")
    first = confirm.first_reports(streak.join(texts, ["video_id", "frame_idx", "track_id"]), "track_id", "violation")
    path = names.evidence_path(*(F.col(c) for c in ("plate", "violation", "video_id", "frame_idx", "track_id")))
    return ledger.with_amount(first, amounts, config.default_amount).select("video_id", "frame_idx", "track_id", "violation", "plate", "amount", path.alias("image_path"))


def record(found: DataFrame, path: str, amounts: DataFrame, now=None) -> None:
    """Record violations, of a video or of images, in the ledger at path: one fine each."""
    ledger_table.record(found.select("plate", "violation", "image_path"), path, amounts, now)


def summary(dets: DataFrame, frames: DataFrame, amounts: DataFrame, config: Config = Config()) -> DataFrame:
    """For each video: frames, plates still tracked at its end, violations and their amounts."""
    frames, dets = detections.capped(frames, config.max_frames), detections.capped(dets, config.max_frames)
    tracked = storage.written(tracks(dets, config), "tracks")
    ends = tracking.still_tracked(tracked, frames, config)
    found = violations(dets, amounts, config, tracked).groupBy("video_id").agg(F.count("*").alias("violations"), F.sum("amount").alias("amount"))
    return ends.join(found, "video_id", "left").na.fill(0, ["violations", "amount"])
