"""Tunables of the violation engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults are those of the behaviour that the engine reproduces."""

    contradiction_iou: float = 0.1  # a larger overlap of helmet and no helmet is a contradiction
    match_distance: float = 80.0  # pixels that a plate may move between sightings
    missed_frames: int = 10  # frames that a track outlives without a sighting
    streak: int = 5  # sightings in a row that confirm a violation
    speed_limit: int = 40  # km/h, exceeded strictly
    pixels_per_metre: float | None = None  # without calibration there are no speeds
    fps: float = 25.0
    max_width: int = 1280
    image_confidence: float = 0.25
    ocr_confidence: float = 0.4
    max_frames: int | None = None
    default_amount: int = 300

    def calibrated(self) -> bool:
        return bool(self.pixels_per_metre)
