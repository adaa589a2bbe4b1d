"""The gain controller against pumping, and segments at keyframes.

The recurrence is not linear, so it is folded frame by frame within a stream: in batch by one pass over each stream's
frames in order, on a stream of frames by keyed state (`lumenforge.streaming.gain`). Both use `Gain`. Streams run in
parallel; pixels never enter the fold, only one row a frame.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Gain:
    """State of a stream's controller: last gain, last output luma, and a window of input lumas."""

    window: int = 12
    last: float = 1.0
    last_luma: float | None = None
    history: deque = field(default_factory=deque)

    def step(self, requested: float, luma: float, strength: float, max_delta: float) -> float:
        damp = min(max(1 - min(max(strength, 0), 1) * 0.85, 0.05), 1)
        d, p = max(max_delta, 0.0005), self.last
        g = min(max(min(max(p + (requested - p) * damp, p - d), p + d), 0.35), 1)
        if self.window > 0 and len(self.history) >= 2:
            mean = sum(self.history) / len(self.history)
            sd = math.sqrt(sum((x - mean) ** 2 for x in self.history) / len(self.history))
            if sd < 0.015:
                g = p + (g - p) * (1 - 0.5 * (1 - sd / 0.015))
        elif self.last_luma is not None and abs(luma - self.last_luma) < 0.015 and abs(requested - p) > d:
            g = p + (g - p) * 0.5
        self.last, self.last_luma = g, luma * g
        if self.window > 0:
            self.history.append(luma)
            while len(self.history) > self.window:
                self.history.popleft()
        return g


def requested_gain(frame_ms: float, budget_ms: float, strength: float) -> float:
    """1 within the frame-time budget, less the further beyond it."""
    overload = min(max(frame_ms / max(budget_ms, 0.1), 0.5), 3.0)
    return 1.0 if overload <= 1 else min(max(1 - 0.35 * strength * (overload - 1), 0.45), 1.0)


@dataclass(frozen=True)
class Controller:
    """Gaming and temporal limits; the tighter delta and the greater strength hold."""

    budget_ms: float = 8.3
    gaming_strength: float = 0.8
    gaming_delta: float = 0.05
    temporal_strength: float = 0.65
    temporal_delta: float = 0.08
    window: int = 12

    def apply(self, state: Gain, frame_ms: float | None, luma: float | None, locked: bool = False) -> float:
        """The frame's gain; frames that are locked, untimed or empty pass at 1 and leave no trace."""
        if locked or frame_ms is None or luma is None or math.isnan(frame_ms) or math.isnan(luma):
            return 1.0
        strength = max(self.gaming_strength, self.temporal_strength)
        return state.step(requested_gain(frame_ms, self.budget_ms, strength), luma, strength, min(self.gaming_delta, self.temporal_delta))


def stabilise(frames: DataFrame, controller: Controller = Controller()) -> DataFrame:  # noqa: B008
    """(stream_id, frame_index, gain) of frames (stream_id, frame_index, frame_time_ms, luma, locked), in order.

    A stream's frames arrive sorted and are folded batch by batch; only the controller's state is held.
    """
    cols = ["stream_id", "frame_index", "frame_time_ms", "luma", "locked"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, Gain(controller.window)
        for b in batches:
            out = []
            for s, t, y, k in zip(b.stream_id, b.frame_time_ms, b.luma, b.locked, strict=True):
                if s != at:
                    at, state = s, Gain(controller.window)
                out.append(controller.apply(state, t, y, bool(k)))
            yield pd.DataFrame({"stream_id": b.stream_id, "frame_index": b.frame_index, "gain": out})

    return frames.select(*cols).repartition("stream_id").sortWithinPartitions("stream_id", "frame_index").mapInPandas(fold, "stream_id string, frame_index long, gain double")


def keyframe_segments(packets: DataFrame, by: str = "stream_id") -> DataFrame:
    """Adds ``segment``: a new one starts at every keyframe but a stream's first packet."""
    order = Window.partitionBy(by).orderBy("frame_index")
    starts = (F.col("is_keyframe") & (F.row_number().over(order) > 1)).cast("int")
    return packets.withColumn("_starts", starts).withColumn("segment", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_starts")


def encode_order(packets: DataFrame, by: str = "stream_id") -> DataFrame:
    """Packets in the order that an encoder with state needs, with their ``position`` and ``failure``: the first of a frame
    index that is null or negative, one that comes twice, and a gap before it; null where it may be coded.

    ``arrival`` (any order) tells which of two packets came first; one that comes after a later frame is late.
    """
    order = Window.partitionBy(by).orderBy("frame_index", "arrival")
    came = Window.partitionBy(by).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    df = packets.withColumn("_before", F.lag("frame_index").over(order)).withColumn("_most", F.max("frame_index").over(came))
    failure = (
        F.when(F.col("frame_index").isNull() | (F.col("frame_index") < 0), "frame index is missing")
        .when(F.col("frame_index") == F.col("_before"), "frame index comes twice")
        .when(F.col("_most") > F.col("frame_index"), "frame comes after a later one")
        .when(F.col("frame_index") != F.coalesce(F.col("_before") + 1, F.lit(0)), "frames are missing before this one")
    )
    return df.withColumn("position", (F.row_number().over(order) - 1).cast("long")).withColumn("failure", failure).drop("_before", "_most")


def frame_duration(fps: float) -> int:
    """Ticks of a 90 kHz clock, at least one."""
    if not math.isfinite(fps) or fps <= 0:
        raise ValueError("frame rate must be positive")
    return max(1, min(int(math.floor(90_000 / fps + 0.5)), 2**32 - 1))


def samples_per_chunk(chunks: DataFrame, table: DataFrame) -> DataFrame:
    """As-of lookup: each chunk takes the last entry (first_chunk, samples) that does not start after it.

    Entries and chunks are ordered together by one window a track; nothing is multiplied.
    """
    rows = chunks.select("track", "chunk", F.lit(None).cast("int").alias("samples"), F.lit(1).alias("_k")).union(table.select("track", F.col("first_chunk").alias("chunk"), "samples", F.lit(0).alias("_k")))
    order = Window.partitionBy("track").orderBy("chunk", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("samples", F.last("samples", ignorenulls=True).over(order)).where("_k = 1").drop("_k")
