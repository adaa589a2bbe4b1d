"""Per-pixel operators and per-frame statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.functions import color
from lumenforge.functions.color import Rgb
from lumenforge.functions.num import as_float32, clamp, finite, quantize, snap
from lumenforge.functions.transfer import PEAK_NITS, pq_decode, pq_encode, srgb_decode


def rgb(prefix: str = "") -> Rgb:
    return F.col(f"{prefix}r"), F.col(f"{prefix}g"), F.col(f"{prefix}b")


def luminance_stats(pixels: DataFrame, by: str = "frame_index") -> DataFrame:
    """Peak and average luminance of each frame, negative luminance as 0. Partial sums meet in one shuffle of frames."""
    y = F.greatest(color.luma(rgb()), F.lit(0.0))
    return pixels.groupBy(by).agg(F.max(y).alias("peak_nits"), F.avg(y).alias("average_nits"), F.count(F.lit(1)).alias("n_pixels"))


def mean_signal(signal: DataFrame, by: str = "frame_index") -> DataFrame:
    """Mean of all channels of each frame's signal, unweighted, as inspection reports it."""
    return signal.groupBy(by).agg(F.avg((F.col("r") + F.col("g") + F.col("b")) / 3).alias("mean_signal"))


def with_metadata(packets: DataFrame, frames: DataFrame, by: str = "frame_index") -> DataFrame:
    """Packets with the metadata of their frame; packets without any stay."""
    return packets.join(frames, by, "left")


def first_bad_pixel(pixels: DataFrame, by: str = "frame_index") -> DataFrame:
    """The first pixel of each frame with a channel that is not finite, and that channel (r before g before b)."""
    bad = F.when(~finite("r"), "r").when(~finite("g"), "g").when(~finite("b"), "b")
    found = pixels.withColumn("channel", bad).where("channel is not null")
    return found.groupBy(by).agg(F.min(F.struct("pixel_idx", "channel")).alias("first")).select(by, "first.*")


def transcode(pixels: DataFrame, deterministic: bool = True) -> DataFrame:
    """Mastering nits to delivery PQ through single precision; ``deterministic`` snaps the signal to 16 bits."""

    def one(c: str) -> Column:
        signal = as_float32(pq_encode(as_float32(clamp(F.col(c) / PEAK_NITS))))
        return as_float32(snap(signal)) if deterministic else signal

    return pixels.withColumns({c: one(c) for c in "rgb"})


def hdr10_codes(signal: DataFrame) -> DataFrame:
    """10-bit codes of a PQ signal, without tone mapping."""
    return signal.withColumns({c: quantize(c, 1023) for c in "rgb"})


def ycbcr12_round_trip(signal: DataFrame) -> DataFrame:
    """The lossy step of a 12-bit luma and chroma codec: quantise and come back."""
    coded = signal.select("*", *(c.alias(n) for c, n in zip(color.ycbcr12(rgb()), ("y12", "cb12", "cr12"), strict=True)))
    back = color.from_ycbcr12(F.col("y12"), F.col("cb12"), F.col("cr12"))
    return coded.withColumns(dict(zip("rgb", back, strict=True)))


def subsample_420(planes: DataFrame, width: int, by: str = "frame_index") -> DataFrame:
    """Rounded integer means of 2 x 2 blocks of chroma codes (cb12, cr12); dimensions must be even."""
    if width % 2:
        raise ValueError("4:2:0 needs an even width")
    y = F.floor(F.col("pixel_idx") / width)
    mean = lambda c: F.expr(f"(sum({c}) + 2) div 4").cast("int").alias(c)
    return planes.groupBy(by, F.expr(f"(pixel_idx % {width}) div 2").alias("cx"), F.floor(y / 2).alias("cy")).agg(mean("cb12"), mean("cr12"))


def upsample_420(planes: DataFrame, chroma: DataFrame, width: int, by: str = "frame_index") -> DataFrame:
    """Nearest chroma for every pixel of the luma plane."""
    at = planes.withColumns({"cx": F.expr(f"(pixel_idx % {width}) div 2"), "cy": F.floor(F.floor(F.col("pixel_idx") / width) / 2)})
    return at.drop("cb12", "cr12").join(chroma, [by, "cx", "cy"]).drop("cx", "cy")


def desaturate(c: Rgb, y: Column) -> Rgb:
    """Blend toward the grey of the same luminance, just as far as all channels fit into 0 to 1."""
    low, high = F.least(*c), F.greatest(*c)
    up = F.when(low < 0, F.when(y - low > 1e-12, -low / (y - low)).otherwise(1.0)).otherwise(0.0)
    down = F.when(high > 1, F.when(high - y > 1e-12, (high - 1) / (high - y)).otherwise(1.0)).otherwise(0.0)
    t = F.least(F.greatest(up, down), F.lit(1.0))
    return tuple(F.when(t <= 0, v).otherwise(clamp(y + (1 - t) * (v - y))) for v in c)


def gamut_map_709(linear: DataFrame) -> DataFrame:
    """Linear BT.2020 to BT.709 in gamut; luminance keeps the BT.2100 weights."""
    to709 = linear.withColumns(dict(zip(("r7", "g7", "b7"), color.rec2020_to_rec709(rgb()), strict=True)))
    seven = (F.col("r7"), F.col("g7"), F.col("b7"))
    mapped = to709.withColumn("y7", color.luma(seven))
    return mapped.withColumns(dict(zip("rgb", desaturate(seven, F.col("y7")), strict=True))).drop("r7", "g7", "b7", "y7")


def inverse_tone_map(sdr: DataFrame, recovery: float = 0.3, contrast: float = 0.15, saturation: float = 0.1) -> DataFrame:
    """8-bit sRGB codes to a PQ signal: saturation, highlight and midtone boosts, 1,000 nits for white."""
    linear = sdr.withColumns({c: srgb_decode(F.col(c) / 255.0) for c in "rgb"}).withColumn("_y", color.luma(rgb()))
    y = F.col("_y")
    boost = (1 + recovery * F.pow(y, F.lit(1.5))) * (1 + contrast * 4 * y * (1 - y))
    return linear.withColumns({c: pq_encode(F.greatest(((F.col(c) - y) * (1 + 0.2 * saturation) + y) * boost, F.lit(0.0)) * (1000 / PEAK_NITS)) for c in "rgb"}).drop("_y")


def hint_of(frame: str = "inverse_tone_mapping_hint", v2: str = "open_dynamic_v2") -> Column:
    """The reconstruction hint in force: the frame's, else the v2 payload's, else the default."""
    default = F.struct(F.lit(0.3).cast("float").alias("highlight_recovery_strength"), F.lit(0.15).cast("float").alias("midtone_contrast_boost"), F.lit(0.1).cast("float").alias("saturation_compensation"))
    return F.coalesce(F.col(frame), F.col(f"{v2}.inverse_tone_mapping_hint"), default)


def linear_light(signal: DataFrame) -> DataFrame:
    return signal.withColumns({c: pq_decode(c) for c in "rgb"})
