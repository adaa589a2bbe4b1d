"""Frames as tables: pixels derived from events, test patterns and ramps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.functions.num import clamp
from lumenforge.functions.transfer import PEAK_NITS

WIDTH, HEIGHT = 20, 10


def pixels_from_events(spark: SparkSession, sf_dir: str, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Mastering pixels (linear nits) of small frames, taken from the dense event ids; only four columns are read."""
    n = width * height
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    at = F.col("event_id") % n
    return e.select(
        F.expr(f"event_id div {n}").alias("frame_index"), at.alias("pixel_idx"),
        ((at % width) / float(width)).alias("nx"), (F.floor(at / width) / float(height)).alias("ny"),
        (F.col("value") * 20).alias("r"), (F.col("value") * (1 + F.col("user_id") % 7)).alias("g"), (F.col("value") * (1 + F.col("event_id") % 5)).alias("b"),
    )


def grey_ramp(spark: SparkSession, width: int = 16, height: int = 4, frames: int = 1, peak: float = 1000.0) -> DataFrame:
    """A horizontal ramp from 0 to ``peak`` nits."""
    i = F.col("id") % (width * height)
    v = (i % width) / float(max(width - 1, 1)) * peak
    return spark.range(frames * width * height).select(F.expr(f"id div {width * height}").alias("frame_index"), i.alias("pixel_idx"), v.alias("r"), v.alias("g"), v.alias("b"))


def conformance_pattern(spark: SparkSession, seed: int, width: int = 64, height: int = 64) -> DataFrame:
    """Ramps along both axes with a ripple; its peak is 1200 + 75 x seed nits."""
    i = F.col("id")
    x, y = (i % width) / float(max(width - 1, 1)), F.floor(i / width) / float(max(height - 1, 1))
    ripple = clamp(F.sin((x * 17 + y * 13) * float(seed + 1)) * 0.5 + 0.5)
    peak = 1200.0 + 75.0 * seed
    level = lambda base, add: clamp(base * peak + ripple * add, 0.0, PEAK_NITS)
    return spark.range(width * height).select(
        F.lit(0).cast("long").alias("frame_index"), i.alias("pixel_idx"),
        level(x, 120.0).alias("r"), level(y, 90.0).alias("g"), level(x * 0.6 + y * 0.4, 60.0).alias("b"),
    )
