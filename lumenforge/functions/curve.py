"""Tone curves, local grids, ambient policies and display adaptation.

Curves, grids and policies are metadata: a few numbers on the driver. What can be worked out once (tangents, slopes)
is; rows only see arithmetic on literals, which stays in generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenforge.functions.num import Num, clamp, col, lerp, let

# The default curve, limits, and display model biases.
DEFAULT_ANCHORS = ((0.0, 0.0), (0.25, 0.22), (0.5, 0.48), (0.75, 0.74), (1.0, 1.0))
MAX_ANCHORS = 32
MODEL_BIAS = {"oled": 0.04, "lcd": -0.03, "mini_led": 0.01, "projector": -0.06}


def anchor_problem(anchors) -> str | None:
    """The first rule that a curve's anchors break."""
    if not 2 <= len(anchors) <= MAX_ANCHORS:
        return "curve needs 2 to 32 anchors"
    if not all(math.isfinite(v) and 0 <= v <= 1 for a in anchors for v in a):
        return "curve anchors must be finite and in [0, 1]"
    if anchors[0][0] != 0 or anchors[-1][0] != 1:
        return "curve must start at input 0 and end at input 1"
    if any(b[0] <= a[0] for a, b in zip(anchors, anchors[1:], strict=False)):
        return "curve inputs must increase strictly"
    return None


@dataclass(frozen=True)
class Curve:
    """A curve through anchors: ``linear``, or ``bezier``, which means a monotone cubic Hermite curve (Fritsch-Carlson)."""

    kind: str = "bezier"
    anchors: tuple[tuple[float, float], ...] = DEFAULT_ANCHORS

    def tangents(self) -> list[float]:
        points = self.anchors[:MAX_ANCHORS]
        chords = [(b[1] - a[1]) / (b[0] - a[0]) if b[0] > a[0] else 0.0 for a, b in zip(points, points[1:], strict=False)]
        m = [chords[0], *((a + b) / 2 for a, b in zip(chords, chords[1:], strict=False)), chords[-1]]
        for k, d in enumerate(chords):
            if abs(d) < 1e-12:
                m[k] = m[k + 1] = 0.0
                continue
            r = math.hypot(m[k] / d, m[k + 1] / d)
            if r * r > 9:
                m[k], m[k + 1] = m[k] * 3 / r, m[k + 1] * 3 / r
        return m

    def evaluate(self, x: Num | str) -> Column:
        """The curve at a value, which is best a plain column: it is used once for each segment."""
        points = self.anchors[:MAX_ANCHORS]
        if len(points) < 2:
            return clamp(x)
        return let(clamp(x), self._at)

    def value(self, x: float) -> float:
        """The curve at a number, on the driver."""
        points, x = self.anchors[:MAX_ANCHORS], min(max(x, 0.0), 1.0)
        if len(points) < 2:
            return x
        i = next((k for k in range(len(points) - 2) if x <= points[k + 1][0]), len(points) - 2)
        (x0, y0), (x1, y1) = points[i], points[i + 1]
        h, m = max(x1 - x0, 1e-12), self.tangents()
        t = (x - x0) / h
        if self.kind == "linear" or len(points) == 2:
            return min(max(y0 + t * (y1 - y0), 0.0), 1.0)
        y = y0 * (1 - t) ** 2 * (1 + 2 * t) + y1 * t * t * (3 - 2 * t) + h * (m[i] * t * (1 - t) ** 2 - m[i + 1] * t * t * (1 - t))
        return min(max(y, 0.0), 1.0)

    def table(self, size: int) -> list[float]:
        """Its values at i / (size - 1), for `table_lookup`."""
        if size < 2:
            raise ValueError("a table needs two entries")
        return [self.value(i / (size - 1)) for i in range(size)]

    def _at(self, x: Column) -> Column:
        points = self.anchors[:MAX_ANCHORS]
        if self.kind == "linear" or len(points) == 2:
            return clamp(self._pieces(x, lambda i: points[i][1] + (x - points[i][0]) * ((points[i + 1][1] - points[i][1]) / max(points[i + 1][0] - points[i][0], 1e-12))))
        m = self.tangents()

        def hermite(i: int) -> Column:
            (x0, y0), (x1, y1) = points[i], points[i + 1]
            h = x1 - x0
            t = (x - x0) / h
            c3, c2 = 2 * y0 + h * m[i] - 2 * y1 + h * m[i + 1], -3 * y0 - 2 * h * m[i] + 3 * y1 - h * m[i + 1]
            return ((c3 * t + c2) * t + h * m[i]) * t + y0

        return clamp(self._pieces(x, hermite))

    def _pieces(self, x: Column, of) -> Column:
        n = len(self.anchors[:MAX_ANCHORS]) - 1
        out = of(n - 1)
        for i in range(n - 2, -1, -1):
            out = F.when(x <= self.anchors[i + 1][0], of(i)).otherwise(out)
        return out


def evaluate_anchors(anchors: Column, x: Num | str) -> Column:
    """Piecewise-linear evaluation where each row brings its own anchors (array of input, output)."""
    v = clamp(x)
    n = F.size(anchors)
    pairs = F.zip_with(F.slice(anchors, 1, n - 1), F.slice(anchors, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hit = F.get(F.filter(pairs, lambda p: (p["a"]["input"] <= v) & (v <= p["b"]["input"])), F.lit(0))
    at = lambda p: p["a"]["output"] + (p["b"]["output"] - p["a"]["output"]) * (v - p["a"]["input"]) / F.greatest(p["b"]["input"] - p["a"]["input"], F.lit(1e-12))
    return F.when(n < 2, v).otherwise(clamp(let(hit, lambda p: F.coalesce(at(p), F.element_at(anchors, -1)["output"]))))


@dataclass(frozen=True)
class Grid:
    """Gains and offsets on a cols x rows lattice, row by row; sampled bilinearly, clamped at the edges."""

    cols: int
    rows: int
    cells: tuple[tuple[float, float], ...]

    @classmethod
    def identity(cls, cols: int = 4, rows: int = 4) -> Grid:
        return cls(cols, rows, ((1.0, 0.0),) * (cols * rows))

    def problem(self) -> str | None:
        if self.cols < 1 or self.rows < 1:
            return "grid dimensions must not be zero"
        if len(self.cells) != self.cols * self.rows:
            return "grid cell count must be cols x rows"
        return None if all(math.isfinite(v) for c in self.cells for v in c) else "grid cells must be finite"

    def sample(self, nx: Num | str, ny: Num | str) -> tuple[Column, Column]:
        """(gain, offset); a grid of a bad shape changes nothing."""
        if self.problem():
            return F.lit(1.0), F.lit(0.0)
        gx, gy = clamp(nx) * float(self.cols - 1), clamp(ny) * float(self.rows - 1)
        x0, y0 = F.floor(gx).cast("int"), F.floor(gy).cast("int")
        x1, y1 = F.least(x0 + 1, F.lit(self.cols - 1)), F.least(y0 + 1, F.lit(self.rows - 1))

        def plane(k: int) -> Column:
            values = F.array(*(F.lit(float(c[k])) for c in self.cells))
            at = lambda x, y: F.get(values, y * self.cols + x)
            return lerp(lerp(at(x0, y0), at(x1, y0), gx - x0), lerp(at(x0, y1), at(x1, y1), gx - x0), gy - y0)

        return plane(0), plane(1)


def ambient_boost(lux: Num | str, breakpoints: tuple[float, ...], boosts: tuple[float, ...]) -> Column:
    """Piecewise-linear boost; constant beyond the ends, 1 for an empty or mismatched policy."""
    if not breakpoints or len(breakpoints) != len(boosts):
        return F.lit(1.0)
    v = col(lux)
    out = F.lit(float(boosts[-1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(zip(breakpoints, boosts, strict=True), zip(breakpoints[1:], boosts[1:], strict=True), strict=False))):
        out = F.when(v <= x1, y0 + (v - x0) * ((y1 - y0) / max(x1 - x0, 1e-9))).otherwise(out)
    return F.when(v <= breakpoints[0], F.lit(float(boosts[0]))).otherwise(out)


@dataclass(frozen=True)
class DisplayLayer:
    source_peak: float = 1000.0
    display_peak: float = 800.0
    model: str = "oled"
    rolloff: float = 0.5
    shadow_lift: float = 0.2

    def adapt(self, v: Num | str, model: str | None = None) -> Column:
        """Scale by the clamped ratio of peaks and the model's bias, lift shadows, clamp."""
        ratio = min(max(self.display_peak / max(self.source_peak, 1.0), 0.1), 4.0)
        return clamp(col(v) * (ratio * (1 + self.rolloff * MODEL_BIAS[model or self.model])) + self.shadow_lift * 0.02)


def curve_table(spark, curve: Curve, size: int):
    """A lookup table (i, input, output) of a curve at i / (size - 1)."""
    if size < 2:
        raise ValueError("a table needs two entries")
    x = F.col("id") / float(size - 1)
    return spark.range(size).select(F.col("id").alias("i"), x.alias("input"), curve.evaluate(x).alias("output"))


def table_lookup(x: Num | str, table: list[float]) -> Column:
    """A table of values at equal distances over 0 to 1, linear between them."""
    values, last = F.array(*map(F.lit, table)), len(table) - 1

    def between(v: Column) -> Column:
        k = F.least(F.floor(v).cast("int"), F.lit(last - 1))
        return F.get(values, k) + (v - k) * (F.get(values, k + 1) - F.get(values, k))

    return let(clamp(x) * float(last), between)
