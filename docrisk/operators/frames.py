"""Video frames: sampling and agreement of what they show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.functions.values import non_empty, squeeze
from docrisk.operators.statement import field_conflicts


def sample_frames(
    frames: DataFrame,
    key: str = "doc_id",
    per_second: int = dims.FRAMES_PER_SECOND,
    max_frames: int = dims.MAX_FRAMES,
) -> DataFrame:
    """The first frame of every half second, the earliest eight of them, ranked in frame order.

    The slots are found by partial aggregation and the ranking limit is applied before its
    shuffle, so a very long video costs no more than its slots.
    """
    rest = [c for c in frames.columns if c not in (key, "ts")]
    slots = (
        frames.withColumn("_slot", F.floor(F.col("ts") * per_second))
        .groupBy(key, "_slot")
        .agg(F.min(F.struct("ts", *rest)).alias("_f"))
        .select(key, "_f.*")
    )
    order = Window.partitionBy(key).orderBy("ts", *rest)
    return slots.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_frames)


def frame_conflicts(readings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Listed items whose reading changes between the frames of a video."""
    value = non_empty(squeeze(F.col("value")))
    listed = readings.filter(F.col("field").isin(dims.FRAME_FIELDS))
    return field_conflicts(listed.withColumn("value", value), key)
