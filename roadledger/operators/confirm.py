"""From sightings of violations to reports: speed, streaks and first qualifying frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadledger.config import Config
from roadledger.functions import geometry, speed


def speeds(sightings: DataFrame, key: str, config: Config) -> DataFrame:
    """sightings with speed_kmh against the previous one of the same key, however long ago."""
    order = Window.partitionBy("video_id", key).orderBy("frame_idx")
    x = geometry.centre_floor(F.col("x1"), F.col("x2"))
    moved = sightings.withColumn("cx", x).withColumns({"last_cx": F.lag("cx").over(order), "last_frame": F.lag("frame_idx").over(order)})
    kmh = speed.kmh(F.col("cx"), F.col("last_cx"), F.col("frame_idx"), F.col("last_frame"), config.pixels_per_metre or 1.0, config.fps)
    return moved.withColumn("speed_kmh", kmh).drop("cx", "last_cx", "last_frame")


def streaks(sightings: DataFrame, *key: str) -> DataFrame:
    """Running count of sightings over frames in a row, for (video_id, *key).

    Every box counts, so two boxes in a frame add two; a frame without one begins anew. One shuffle
    serves the count and the windows.
    """
    by_frame = sightings.repartition("video_id", *key).groupBy("video_id", *key, "frame_idx").agg(F.count("*").alias("seen"))
    order = Window.partitionBy("video_id", *key).orderBy("frame_idx")
    islands = by_frame.withColumn("island", F.col("frame_idx") - F.row_number().over(order))
    inside = Window.partitionBy("video_id", *key, "island").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("streak", F.sum("seen").over(inside)).drop("island")


def first_reports(confirmed: DataFrame, *key: str) -> DataFrame:
    """The earliest row with a readable plate of each (video_id, *key); unreadable ones only defer it."""
    order = Window.partitionBy("video_id", *key).orderBy("frame_idx")
    return confirmed.where("plate <> ''").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def united(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """Sightings (video_id, frame_idx, track_id) of several violations in one table."""
    own = [df.select("video_id", "frame_idx", "track_id", F.lit(name).alias("violation")) for name, df in kinds]
    return reduce(DataFrame.unionByName, own)
