"""Tone mapping: by policy, by region, to SDR with dither."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.functions import color
from lumenforge.functions.curve import Curve, DisplayLayer, Grid, ambient_boost
from lumenforge.functions.num import clamp, finite, snap
from lumenforge.functions.transfer import PEAK_NITS, pq_decode, pq_encode, srgb_encode
from lumenforge.operators.pixels import gamut_map_709, rgb


@dataclass(frozen=True)
class Target:
    """A display's luminance range; bad limits fall back to 0 and 1,000 nits."""

    min_nits: float = 0.0005
    max_nits: float = 1000.0

    def range(self) -> tuple[float, float]:
        low = self.min_nits if math.isfinite(self.min_nits) and self.min_nits >= 0 else 0.0
        high = self.max_nits if math.isfinite(self.max_nits) and self.max_nits > 0 else 1000.0
        return (0.0 if low >= high else low), high


@dataclass(frozen=True)
class Policy:
    """What applies to a stream besides its curve; the creator's lock switches all of it off."""

    grid: Grid | None = None
    layer: DisplayLayer | None = None
    lux: tuple[tuple[float, ...], tuple[float, ...]] | None = None
    ambient_lux: float | Column | None = None
    model: str | None = None
    locked: bool = False
    deterministic: bool = True


def _staged(df: DataFrame, step) -> DataFrame:
    """One projection that applies ``step`` to the working value of each channel: steps refer to columns, so that an
    expression never holds copies of the ones before it."""
    return df.withColumns({f"_{c}": step(F.col(f"_{c}")) for c in "rgb"})


def _normalised(signal: DataFrame, reference_nits: float) -> DataFrame:
    """Working values: light over the reference display's peak, channels that are not finite as 0."""
    start = signal.withColumns({f"_{c}": pq_decode(F.when(finite(c), F.col(c)).otherwise(0.0)) for c in "rgb"})
    return _staged(start, lambda v: clamp(v * (PEAK_NITS / max(reference_nits, 1.0))))


def _displayed(df: DataFrame, target: Target) -> DataFrame:
    """Working values to the target display's range, as PQ, in place of the channels."""
    low, high = target.range()
    return _staged(df, lambda v: clamp(v * high, low, high)).withColumns({c: pq_encode(F.col(f"_{c}") / PEAK_NITS) for c in "rgb"}).drop("_r", "_g", "_b")


def tone_map(signal: DataFrame, curve: Curve, reference_nits: float = 1000.0, target: Target = Target(), policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """A PQ signal (with nx, ny for grids) through the curve, then grid, display model and ambient light, then to a
    display's range. Channels that are not finite come out as 0."""
    df = _staged(_normalised(signal, reference_nits), curve.evaluate)
    if not policy.locked:
        if policy.grid:
            gain, offset = policy.grid.sample("nx", "ny")
            df = _staged(df.withColumns({"_gain": gain, "_offset": offset}), lambda v: clamp(v * F.col("_gain") + F.col("_offset"))).drop("_gain", "_offset")
        if policy.layer:
            df = _staged(df, lambda v: policy.layer.adapt(v, policy.model))
        if policy.lux and policy.ambient_lux is not None:
            df = _staged(df.withColumn("_boost", ambient_boost(policy.ambient_lux, *policy.lux)), lambda v: clamp(v * F.col("_boost"))).drop("_boost")
    if policy.deterministic:
        df = _staged(df, snap)
    return _displayed(df, target)


def apply_gain(mapped: DataFrame, gains: DataFrame, by: tuple[str, ...] = ("frame_index",), deterministic: bool = True) -> DataFrame:
    """Tone-mapped pixels times their frame's gain; frames without one stay as they are.

    ``gains`` has one row a frame. Pixels stay where they are as long as the frames fit a broadcast, which Spark decides
    by size; they are never multiplied.
    """
    df = mapped.join(gains.select(*by, F.col("gain").alias("_gain")), list(by), "left")
    scaled = {c: clamp(F.col(c) * F.col("_gain")) for c in "rgb"}
    return df.withColumns({c: F.when(F.col("_gain").isNull(), F.col(c)).otherwise(snap(x) if deterministic else x) for c, x in scaled.items()}).drop("_gain")


def tone_map_stateful(signal: DataFrame, times: DataFrame, curve: Curve, controller, by: str = "stream_id", reference_nits: float = 1000.0, target: Target = Target(), policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """`tone_map`, then the gain controller over each stream's frames in order, and its gains on the pixels.

    ``times`` (by, frame_index, frame_time_ms, locked) has one row a frame; frames that are locked or untimed pass the
    controller unseen. The luma that it sees is that of the tone-mapped pixels.
    """
    from lumenforge.operators.temporal import stabilise

    mapped = tone_map(signal, curve, reference_nits, target, policy)
    luma = mapped.groupBy(by, "frame_index").agg(F.avg(color.luma(rgb())).alias("luma"))
    frames = luma.join(times, [by, "frame_index"]).withColumn("locked", F.coalesce("locked", F.lit(False)) | F.lit(policy.locked))
    gains = stabilise(frames.withColumnRenamed(by, "stream_id"), controller).withColumnRenamed("stream_id", by)
    passing = gains.join(frames.where("not locked and frame_time_ms is not null").select(by, "frame_index"), [by, "frame_index"], "left_semi")
    return apply_gain(mapped, passing, (by, "frame_index"), policy.deterministic)


def tone_map_regions(signal: DataFrame, curves: dict[int, Curve], default: Curve, reference_nits: float = 1000.0, target: Target = Target()) -> DataFrame:  # noqa: B008
    """Pixels with a ``region_id`` use that region's curve, all others the frame's; no policy applies on this path."""

    def pick(v: Column) -> Column:
        out = default.evaluate(v)
        for region, curve in curves.items():
            out = F.when(F.col("region_id") == region, curve.evaluate(v)).otherwise(out)
        return out

    return _displayed(_staged(_normalised(signal, reference_nits), pick), target)


# SplitMix64.
GOLDEN, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _scramble(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * MIX_A
    z = (z ^ (z >> np.uint64(27))) * MIX_B
    return z ^ (z >> np.uint64(31))


def splitmix_dither(index: np.ndarray) -> np.ndarray:
    """Three triangular samples in (-1, 1) for each pixel index: differences of uniform SplitMix64 draws."""
    start = _scramble(np.asarray(index).astype(np.uint64) * GOLDEN)
    steps = start[None, :] + np.arange(1, 7, dtype=np.uint64)[:, None] * GOLDEN
    uniform = (_scramble(steps) >> np.uint64(11)) / float(1 << 53)
    return uniform[::2] - uniform[1::2]


def to_sdr(signal: DataFrame, curve: Curve, hint_nits: float = 1000.0) -> DataFrame:
    """8-bit sRGB for a 100-nit display: luminance through the curve, gamut mapping, dither by pixel index.

    Only the dither, whose 64-bit products wrap, runs in Python, on Arrow batches of one column.
    """
    linear = signal.withColumns({c: pq_decode(c) for c in "rgb"}).withColumn("_y", color.luma(rgb()))
    scaled = linear.withColumn("_x", clamp(F.col("_y") * (PEAK_NITS / max(hint_nits, 100.0)))).withColumn("_m", curve.evaluate("_x")).drop("_x")
    scale = F.when(F.col("_y") > 1e-7, F.col("_m") / F.col("_y")).otherwise(0.0)
    mapped = gamut_map_709(scaled.withColumn("_s", scale).withColumns({c: F.col(c) * F.col("_s") for c in "rgb"})).drop("_y", "_m", "_s")

    @F.pandas_udf("r double, g double, b double")
    def noise(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(dict(zip("rgb", splitmix_dither(part.to_numpy(np.int64)), strict=True)))

    dithered = mapped.withColumn("_t", noise("pixel_idx"))
    return dithered.withColumns({c: clamp(F.floor(clamp(srgb_encode(c)) * 255 + F.col(f"_t.{c}") * 0.5 + 0.5), 0.0, 255.0).cast("int") for c in "rgb"}).drop("_t")
