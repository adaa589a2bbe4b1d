"""ACES rendering: AP0 and AP1 conversions as columns, RRT and output transforms as vectorised functions on Arrow batches.

The output transforms chain splines in the log domain; as column expressions each would be expanded many times over, so
whole batches of pixels go through NumPy instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenforge.functions.color import Rgb, matrix
from lumenforge.functions.transfer import C1, C2, C3, M1, M2, PEAK_NITS, pq_decode

# ACES matrices, spline coefficients and constants.
AP0_TO_REC2020 = ((1.4904095, -0.2661709, -0.2242386), (-0.0801675, 1.1821671, -0.1019996), (0.0032276, -0.0347765, 1.0315488))
REC2020_TO_AP0 = ((0.6790856, 0.1577009, 0.1632135), (0.0460020, 0.8590547, 0.0949433), (-0.0005739, 0.0284678, 0.9721062))
AP1_TO_REC2020 = ((1.0258247, -0.0200532, -0.0057716), (-0.0022344, 1.0045865, -0.0023521), (-0.0050134, -0.0252901, 1.0303034))
REC2020_TO_AP1 = ((0.9748950, 0.0195991, 0.0055059), (0.0021796, 0.9955355, 0.0022850), (0.0047972, 0.0245320, 0.9706707))
AP0_TO_AP1 = ((1.4514393161, -0.2365107469, -0.2149285693), (-0.0765537734, 1.1762296998, -0.0996759264), (0.0083161484, -0.0060324498, 0.9977163014))
AP1_TO_AP0 = ((0.6954522414, 0.1406786965, 0.1638690622), (0.0447945634, 0.8596711185, 0.0955343182), (-0.0055258826, 0.0040252103, 1.0015006723))
AP1_TO_XYZ = ((0.6624541811, 0.1340042065, 0.1561876870), (0.2722287168, 0.6740817658, 0.0536895174), (-0.0055746495, 0.0040607335, 1.0103391003))
XYZ_TO_AP1 = ((1.6410233797, -0.3248032942, -0.2364246952), (-0.6636628587, 1.6153315917, 0.0167563477), (0.0117218943, -0.0082844420, 0.9883948585))
D60_TO_D65 = ((0.9872240087, -0.0061132286, 0.0159532883), (-0.0075983718, 1.0018614847, 0.0053300358), (0.0030725771, -0.0050959615, 1.0816806031))
XYZ_TO_709 = ((3.2409699, -1.5373832, -0.4986108), (-0.9692436, 1.8759675, 0.0415551), (0.0556301, -0.2039770, 1.0569715))
XYZ_TO_2020 = ((1.7166511880, -0.3556707838, -0.2533662814), (-0.6666843518, 1.6164812366, 0.0157685458), (0.0176398574, -0.0427706133, 0.9421031212))
R2020_TO_XYZ = ((0.6369580, 0.1446169, 0.1688810), (0.2627002, 0.6779981, 0.0593017), (0.0, 0.0280727, 1.0609851))
AP1_Y = (0.2722287168, 0.6740817658, 0.0536895174)
RRT_LOW = (-4.0, -4.0, -3.1573765773, -0.4852499958, 1.8477324706, 1.8477324706)
RRT_HIGH = (-0.7185482425, 2.0810307172, 3.6681241237, 4.0, 4.0, 4.0)
ODT_LOW = (-1.6989700043, -1.6989700043, -1.4779, -1.2291, -0.8648, -0.4480, 0.00518, 0.4511080334, 0.9113744414, 0.9113744414)
ODT_HIGH = (0.5154386965, 0.8470437783, 1.1358, 1.3802, 1.5197, 1.5985, 1.6467, 1.6746091357, 1.6878733390, 1.6878733390)
HALF_MIN, HALF_MAX, MID_GREY = 6.103515625e-5, 65_504.0, 0.18


def rec2020_to_ap0(rgb: Rgb) -> Rgb:
    return matrix(REC2020_TO_AP0, rgb)


def ap0_to_rec2020(rgb: Rgb) -> Rgb:
    return matrix(AP0_TO_REC2020, rgb)


def rec2020_to_ap1(rgb: Rgb) -> Rgb:
    return matrix(REC2020_TO_AP1, rgb)


def ap1_to_rec2020(rgb: Rgb) -> Rgb:
    return matrix(AP1_TO_REC2020, rgb)


def _times(m, rgb: np.ndarray) -> np.ndarray:
    return np.asarray(m) @ rgb


def _saturate(amount: float) -> np.ndarray:
    return (1 - amount) * np.tile(AP1_Y, (3, 1)) + amount * np.eye(3)


class Spline:
    """Two quadratic B-splines in the log10 domain that meet at a mid point, straight lines beyond the ends."""

    def __init__(self, low, high, points, slopes=(0.0, 0.0)):
        self.low, self.high, self.slopes = np.array(low), np.array(high), slopes
        (self.x0, self.y0), (self.x1, _), (self.x2, self.y2) = ((math.log10(x), math.log10(y)) for x, y in points)

    @staticmethod
    def _side(c: np.ndarray, t: np.ndarray) -> np.ndarray:
        n = len(c) - 3
        i = np.clip(np.floor(t).astype(int), 0, n)
        t = t - i
        a, b, d = c[i], c[i + 1], c[i + 2]
        return t * t * (a / 2 - b + d / 2) + t * (b - a) + (a + b) / 2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        v = np.log10(np.maximum(x, HALF_MIN))
        n = len(self.low) - 3
        lower = self._side(self.low, n * (v - self.x0) / (self.x1 - self.x0))
        upper = self._side(self.high, n * (v - self.x1) / (self.x2 - self.x1))
        line = [s * (v - x) + y for s, x, y in ((self.slopes[0], self.x0, self.y0), (self.slopes[1], self.x2, self.y2))]
        return 10 ** np.select([v <= self.x0, v < self.x1, v < self.x2], [line[0], lower, upper], line[1])

    def inverse(self, y: float) -> float:
        """x of a value between the ends, by the segment whose knots hold it."""
        v = math.log10(max(y, 1e-10))
        if v <= self.y0:
            return 10**self.x0
        if v >= self.y2:
            return 10**self.x2
        mid = (self.low[3] + self.low[4]) / 2
        c, base, end = (self.low, self.x0, self.x1) if v <= mid else (self.high, self.x1, self.x2)
        knots = [(c[k] + c[k + 1]) / 2 for k in range(4)]
        i = 0 if v <= knots[1] else 1 if v <= knots[2] else 2
        a, b, d = c[i] / 2 - c[i + 1] + c[i + 2] / 2, c[i + 1] - c[i], (c[i] + c[i + 1]) / 2 - v
        t = 2 * d / (-math.sqrt(max(b * b - 4 * a * d, 0.0)) - b)
        return 10 ** (base + (t + i) * (end - base) / 3)


RRT = Spline(RRT_LOW, RRT_HIGH, ((MID_GREY / 32_768, 1e-4), (MID_GREY, 4.8), (MID_GREY * 262_144, 1e4)))
ODT_48 = Spline(ODT_LOW, ODT_HIGH, tuple((float(RRT(np.array([MID_GREY * 2.0**s]))[0]), y) for s, y in ((-6.5, 0.02), (0.0, 4.8), (6.5, 48.0))), (0.0, 0.04))


def hdr_spline(peak: float, shift: float = 0.0) -> Spline:
    """The single-stage tone scale for a peak luminance, mid grey at 4.8 nits, shifted by stops."""
    between = lambda x, a, b: a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0])
    dark = MID_GREY * 2.0 ** between(math.log10(1e-4), (math.log10(1e-4), -15.0), (math.log10(0.02), -6.5))
    bright = MID_GREY * 2.0 ** between(math.log10(peak), (math.log10(48.0), 6.5), (4.0, 18.0))
    points = ((dark, 1e-4, 0.0), (MID_GREY, 4.8, 1.55), (bright, peak, 0.0))

    def coefficients(p, q, share: float) -> list[float]:
        (x0, y0, s0), (x1, y1, s1) = ((math.log10(x), math.log10(y), s) for x, y, s in (p, q))
        half = (x1 - x0) / 6
        c = [y0 - s0 * half, y0 + s0 * half, y0 + share * (y1 - y0), y1 - s1 * half, y1 + s1 * half]
        return [*c, c[-1]]

    low = coefficients(points[0], points[1], between(math.log2(dark / MID_GREY), (-15.0, 0.18), (-6.5, 0.35)))
    high = coefficients(points[1], points[2], between(math.log2(bright / MID_GREY), (6.5, 0.89), (18.0, 0.90)))
    return Spline(low, high, tuple((2.0 ** (math.log2(x) - shift), y) for x, y, _ in points))


def sweeteners(ap0: np.ndarray) -> np.ndarray:
    """Glow, red modifier and global desaturation ahead of the tone scale; AP0 in, AP1 out."""
    r, g, b = ap0
    high, low = ap0.max(0), ap0.min(0)
    saturation = (np.maximum(high, 1e-10) - np.maximum(low, 1e-10)) / np.maximum(high, 1e-2)
    chroma = np.sqrt(np.maximum(b * (b - g) + g * (g - r) + r * (r - b), 0))
    yc = (r + g + b + 1.75 * chroma) / 3
    x = (saturation - 0.4) / 0.2
    t = np.maximum(1 - np.abs(x / 2), 0)
    gain = 0.05 * (1 + np.sign(x) * (1 - t * t)) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        glow = np.select([yc <= 2 / 3 * 0.08, yc >= 2 * 0.08], [gain, 0 * gain], gain * (0.08 / yc - 0.5))
    aces = ap0 * (1 + glow)
    r, g, b = aces
    hue = np.degrees(np.arctan2(math.sqrt(3) * (g - b), 2 * r - g - b))  # in (-180, 180], centred on red
    k = (hue + 67.5) * 4 / 135
    i = np.floor(k)
    t = k - i
    basis = np.select([i == 0, i == 1, i == 2, i == 3], [t**3 / 6, (-3 * t**3 + 3 * t * t + 3 * t + 1) / 6, (3 * t**3 - 6 * t * t + 4) / 6, (1 - t) ** 3 / 6], 0.0)
    weight = np.where((hue > -67.5) & (hue < 67.5) & ~((r == g) & (g == b)), basis * 1.5, 0.0)
    aces = np.stack([r + weight * saturation * (0.03 - r) * 0.18, g, b])
    return _times(_saturate(0.96), np.clip(_times(AP0_TO_AP1, np.maximum(aces, 0)), 0, HALF_MAX))


def rrt(ap0: np.ndarray) -> np.ndarray:
    return _times(AP1_TO_AP0, RRT(sweeteners(ap0)))


def odt_rec709(oces: np.ndarray) -> np.ndarray:
    """100-nit BT.709 in a dim surround, full-range code values."""
    black = 0.02
    linear = (ODT_48(_times(AP0_TO_AP1, oces)) - black) / (48.0 - black)
    x, y, z = _times(AP1_TO_XYZ, linear)
    s = np.maximum(x + y + z, 1e-10)
    cx, cy, y = x / s, y / s, np.maximum(y, 0) ** 0.9811
    d = np.maximum(cy, 1e-10)
    linear = _times(_saturate(0.93), _times(XYZ_TO_AP1, np.stack([cx * y / d, y, (1 - cx - cy) * y / d])))
    out = np.clip(_times(XYZ_TO_709, _times(D60_TO_D65, _times(AP1_TO_XYZ, linear))), 0, 1)
    return out ** (1 / 2.4)


def output_rec2020_pq(ap0: np.ndarray, peak: float) -> np.ndarray:
    """BT.2020 PQ for a peak luminance, mid grey at 15 nits; the RRT is included."""
    stops = math.log2(hdr_spline(peak).inverse(15.0)) - math.log2(MID_GREY)
    linear = (hdr_spline(peak, stops)(sweeteners(ap0)) - 1e-4) / (peak - 1e-4)
    xyz = _times(R2020_TO_XYZ, np.clip(_times(XYZ_TO_2020, _times(AP1_TO_XYZ, linear)), 0, 1))
    out = np.maximum(_times(XYZ_TO_2020, _times(D60_TO_D65, xyz)), 0) * peak / 10_000
    y = np.clip(out, 0, 1) ** M1
    return ((C1 + C2 * y) / (1 + C3 * y)) ** M2


def delivery_nits(signal: DataFrame) -> DataFrame:
    """A PQ signal (r, g, b) as nits, which is what `render` takes."""
    return signal.withColumns({c: pq_decode(c) * PEAK_NITS for c in "rgb"})


TARGETS = {
    "ap0": lambda v: v,
    "rec709_100nit": lambda v: odt_rec709(rrt(v)),
    "rec2020_1000nit": lambda v: output_rec2020_pq(v, 1000.0),
    "rec2020_4000nit": lambda v: output_rec2020_pq(v, 4000.0),
}


def render(nits: DataFrame, target: str, reference_white: float = 203.0) -> DataFrame:
    """Mastering nits (r, g, b) to AP0 relative to a reference white, and through an output transform."""
    if target not in TARGETS:
        raise ValueError(f"unknown target {target}")
    if not (math.isfinite(reference_white) and reference_white > 0):
        raise ValueError("reference white must be positive")
    scaled = tuple(F.col(c) / reference_white for c in "rgb")
    ap0 = nits.withColumns(dict(zip("rgb", rec2020_to_ap0(scaled), strict=True)))
    if target == "ap0":
        return ap0

    @F.pandas_udf("r double, g double, b double")
    def transform(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(dict(zip("rgb", TARGETS[target](np.stack([p.to_numpy(float) for p in part])), strict=True)))

    done = ap0.withColumn("_o", transform("r", "g", "b"))
    return done.withColumns({c: F.col(f"_o.{c}") for c in "rgb"}).drop("_o")
