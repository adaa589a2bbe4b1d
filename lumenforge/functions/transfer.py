"""Transfer functions: SMPTE ST 2084 (PQ) and sRGB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenforge.functions.num import Num, clamp, col

# ST 2084.
PEAK_NITS = 10_000.0
M1, M2 = 2610 / 16384, 2523 / 32
C1, C2, C3 = 3424 / 4096, 2413 / 128, 2392 / 128


def pq_encode(linear: Num | str) -> Column:
    """Inverse EOTF: linear light (1 is 10,000 nits) to the PQ signal; clamps its input."""
    y = F.pow(clamp(linear), F.lit(M1))
    return F.pow((C1 + C2 * y) / (1 + C3 * y), F.lit(M2))


def pq_decode(signal: Num | str) -> Column:
    """EOTF: the PQ signal to linear light (1 is 10,000 nits)."""
    e = F.pow(clamp(signal), F.lit(1 / M2))
    return F.pow(F.greatest(e - C1, F.lit(0.0)) / (C2 - C3 * e), F.lit(1 / M1))


def pq_encode_single(linear: Num | str) -> Column:
    """The same of a single-precision value, as one; the work between is in double precision."""
    return pq_encode(col(linear).cast("float").cast("double")).cast("float")


def pq_decode_single(signal: Num | str) -> Column:
    return pq_decode(col(signal).cast("float").cast("double")).cast("float")


def nits_to_pq(nits: Num | str) -> Column:
    """PQ of absolute luminance; null outside 0 to 10,000 nits."""
    n = col(nits)
    return F.when((n >= 0) & (n <= PEAK_NITS), pq_encode(n / PEAK_NITS))


def pq_to_nits(signal: Num | str) -> Column:
    """Absolute luminance of a PQ signal; null outside 0 to 1."""
    s = col(signal)
    return F.when((s >= 0) & (s <= 1), pq_decode(s) * PEAK_NITS)


def srgb_encode(linear: Num | str) -> Column:
    x = clamp(linear)
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def srgb_decode(code: Num | str) -> Column:
    x = clamp(code)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))
