"""Colour spaces: primaries, luma, YCbCr with 12-bit codes, CIELAB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenforge.functions.num import dot, quantize

Rgb = tuple[Column, Column, Column]
# BT.2100 luma weights; BT.2020, BT.709 and D65 matrices.
KR, KG, KB = 0.2627, 0.6780, 0.0593
REC2020_TO_XYZ = ((0.6369580, 0.1446169, 0.1688810), (0.2627002, 0.6779981, 0.0593017), (0.0, 0.0280727, 1.0609851))
XYZ_TO_REC2020 = ((1.7166512, -0.3556708, -0.2533663), (-0.6666844, 1.6164812, 0.0157685), (0.0176399, -0.0427706, 0.9421031))
REC709_TO_XYZ = ((0.4123908, 0.3575843, 0.1804808), (0.2126390, 0.7151687, 0.0721923), (0.0193308, 0.1191948, 0.9505322))
XYZ_TO_REC709 = ((3.2409699, -1.5373832, -0.4986108), (-0.9692436, 1.8759675, 0.0415551), (0.0556301, -0.2039770, 1.0569715))
D65 = (0.95047, 1.0, 1.08883)


def matrix(m: tuple[tuple[float, ...], ...], rgb: Rgb) -> Rgb:
    return tuple(dot(row, rgb) for row in m)


def rec2020_to_xyz(rgb: Rgb) -> Rgb:
    return matrix(REC2020_TO_XYZ, rgb)


def xyz_to_rec2020(xyz: Rgb) -> Rgb:
    return matrix(XYZ_TO_REC2020, xyz)


def product(a, b) -> tuple[tuple[float, ...], ...]:
    """One matrix for two in a row: the driver multiplies, the rows don't."""
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def rec709_to_rec2020(rgb: Rgb) -> Rgb:
    return matrix(product(XYZ_TO_REC2020, REC709_TO_XYZ), rgb)


def rec2020_to_rec709(rgb: Rgb) -> Rgb:
    return matrix(product(XYZ_TO_REC709, REC2020_TO_XYZ), rgb)


def luma(rgb: Rgb) -> Column:
    return dot((KR, KG, KB), rgb)


def to_ycbcr(rgb: Rgb) -> Rgb:
    y = luma(rgb)
    return y, (rgb[2] - y) / (2 * (1 - KB)), (rgb[0] - y) / (2 * (1 - KR))


def from_ycbcr(y: Column, cb: Column, cr: Column) -> Rgb:
    r, b = y + 2 * (1 - KR) * cr, y + 2 * (1 - KB) * cb
    return r, (y - KR * r - KB * b) / KG, b


def ycbcr12(rgb: Rgb) -> Rgb:
    """12-bit codes of luma and chroma."""
    y, cb, cr = to_ycbcr(rgb)
    return quantize(y, 4095), quantize(cb + 0.5, 4095), quantize(cr + 0.5, 4095)


def from_ycbcr12(y: Column, cb: Column, cr: Column) -> Rgb:
    return from_ycbcr(y / 4095.0, cb / 4095.0 - 0.5, cr / 4095.0 - 0.5)


def lab(rgb: Rgb) -> Rgb:
    """CIELAB of linear BT.2020 light relative to D65."""

    def f(v: Column) -> Column:
        return F.when(v > 216 / 24389, F.cbrt(v)).otherwise(v * (841 / 108) + 4 / 29)

    x, y, z = (f(c / w) for c, w in zip(rec2020_to_xyz(rgb), D65, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def delta_e76(a: Rgb, b: Rgb) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(lab(a), lab(b), strict=True)), F.lit(0.0)))
