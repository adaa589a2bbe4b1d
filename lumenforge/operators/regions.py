"""Regions: boxes on the raster and caps on the sphere, their motion, and the region that governs a pixel.

Regions are metadata of a frame, a bounded handful; they are matched as arrays within each pixel's row, so that no pixel
is ever multiplied by regions in a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.functions.num import let

BOX = "struct<region_id:bigint,ordinal:int,x:double,y:double,width:double,height:double,priority:int>"
#: Regions that a frame may have as one array; more must be refused, not dropped.
MOST_REGIONS = 4_096


def inside_box(nx: Column, ny: Column, box: Column) -> Column:
    """Half-open on the right and bottom."""
    return (nx >= box["x"]) & (nx < box["x"] + box["width"]) & (ny >= box["y"]) & (ny < box["y"] + box["height"])


def inside_cap(azimuth: Column, elevation: Column, cap: Column) -> Column:
    """Closed elevation band; the difference of azimuths wraps, so a cap may cross the seam."""
    wrapped = F.abs(F.pmod(azimuth - cap["centre_azimuth"] + math.pi, F.lit(2 * math.pi)) - math.pi)
    return (F.abs(elevation - cap["centre_elevation"]) <= cap["angular_height"] / 2) & (wrapped <= cap["angular_width"] / 2)


def governing(regions: Column, inside) -> Column:
    """The region of the highest priority that holds the pixel, the last one of equals; null if none does."""
    held = F.filter(regions, inside)
    rank = lambda r: F.struct(r["priority"].alias("p"), r["ordinal"].alias("o"), r.alias("r"))
    return F.array_max(F.transform(held, rank))["r"]


def region_arrays(regions: DataFrame, key: str = "frame_index") -> DataFrame:
    """(key, regions): one array a frame. Frames are bounded by MOST_REGIONS, beyond which this raises."""
    cols = [c for c in regions.columns if c != key]
    got = regions.groupBy(key).agg(F.collect_list(F.struct(*cols)).alias("regions"))
    return got.withColumn("regions", F.when(F.size("regions") <= MOST_REGIONS, F.col("regions")).otherwise(F.raise_error(F.lit("too many regions in a frame"))))


def resolve_flat(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds the ``region`` that governs each pixel of a frame; regions join by frame, not by pixel."""
    return pixels.join(region_arrays(regions), "frame_index", "left").withColumn("region", governing(F.coalesce("regions", F.array().cast(f"array<{BOX}>")), lambda r: inside_box(F.col("nx"), F.col("ny"), r))).drop("regions")


def box_at(region: Column, delta: Column) -> Column:
    """A moving box ``delta`` frames after it was authored; null when its motion does not reach so far.

    ``motion`` is null (only at delta 0) or kind static, translate (dx_per_frame, dy_per_frame) or piecewise_linear
    (keyframes of frame_delta, dx, dy), with frame_count.
    """
    m = region["motion"]
    keys = m["keyframes"]
    n = F.size(keys)
    count = F.when(m["kind"] == "piecewise_linear", F.element_at(keys, -1)["frame_delta"] + 1).otherwise(m["frame_count"])
    pairs = F.zip_with(F.slice(keys, 1, n - 1), F.slice(keys, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hit = F.get(F.filter(pairs, lambda p: (p["a"]["frame_delta"] <= delta) & (delta <= p["b"]["frame_delta"])), F.lit(0))
    exact = F.get(F.filter(keys, lambda k: k["frame_delta"] == delta), F.lit(0))

    def along(p: Column, c: str) -> Column:
        t = (delta - p["a"]["frame_delta"]) / F.greatest(p["b"]["frame_delta"] - p["a"]["frame_delta"], F.lit(1))
        return p["a"][c] + (p["b"][c] - p["a"][c]) * t

    def offset(c: str) -> Column:
        return (
            F.when(m["kind"] == "static", F.lit(0.0)).when(m["kind"] == "translate", m[f"{c}_per_frame"] * delta)
            .otherwise(F.coalesce(exact[c], let(hit, lambda p: along(p, c))))
        )

    moved = F.struct((region["x"] + offset("dx")).alias("x"), (region["y"] + offset("dy")).alias("y"), region["width"].alias("width"), region["height"].alias("height"))
    still = F.struct(region["x"].alias("x"), region["y"].alias("y"), region["width"].alias("width"), region["height"].alias("height"))
    return F.when(m.isNull(), F.when(delta == 0, still)).when((delta >= 0) & (delta < count), moved)


def translation(box: Column, to_x: Column, to_y: Column, frames: Column) -> Column:
    """Deltas a frame that bring a box to a place at its last frame; null for fewer than two frames."""
    steps = (frames - 1).cast("double")
    return F.when(frames >= 2, F.struct(((to_x - box["x"]) / steps).alias("dx_per_frame"), ((to_y - box["y"]) / steps).alias("dy_per_frame")))


def applies_to_frame(flat: Column, spherical: Column, authored: Column, frame: Column) -> Column:
    """Whether metadata authored for one frame holds for another: the same, or only flat regions that all still move."""
    active = F.forall(flat, lambda r: box_at(r, frame - authored).isNotNull())
    return (frame == authored) | ((F.size(spherical) == 0) & (F.size(flat) > 0) & active)


def equirectangular(nx: Column, ny: Column) -> tuple[Column, Column]:
    return (nx - 0.5) * (2 * math.pi), (0.5 - ny) * math.pi


def cubemap(nx: Column, ny: Column, equi_angular: bool = False) -> tuple[Column, Column]:
    """Azimuth and elevation on a 3 x 2 layout of faces: +X +Y +Z over -X -Y -Z."""
    fc, fr = F.least(F.floor(nx * 3), F.lit(2)), F.least(F.floor(ny * 2), F.lit(1))
    u, v = (nx * 3 - fc) * 2 - 1, (ny * 2 - fr) * 2 - 1
    if equi_angular:
        u, v = F.tan(u * (math.pi / 4)), F.tan(v * (math.pi / 4))
    face, one = fr * 3 + fc, F.lit(1.0)
    of = lambda *c: F.when(face == 0, c[0]).when(face == 1, c[1]).when(face == 2, c[2]).when(face == 3, c[3]).when(face == 4, c[4]).otherwise(c[5])
    x, y, z = of(one, u, u, -one, u, -u), of(-v, one, -v, -v, -one, -v), of(-u, v, one, u, -v, -one)
    return F.atan2(x, z), F.atan2(y, F.sqrt(x * x + z * z))


def resolve_region(pixels: DataFrame, flat: DataFrame, caps: DataFrame | None, projection: str | None) -> DataFrame:
    """Under a projection, frames with caps ask only those; all others ask boxes."""
    out = resolve_flat(pixels, flat)
    if projection is None or caps is None:
        return out
    to = {"equirectangular": equirectangular, "cubemap": cubemap, "equi_angular_cubemap": lambda x, y: cubemap(x, y, True)}[projection]
    az, el = to(F.col("nx"), F.col("ny"))
    found = out.join(region_arrays(caps).withColumnRenamed("regions", "caps"), "frame_index", "left").withColumns({"_az": az, "_el": el})
    cap = governing(F.col("caps"), lambda r: inside_cap(F.col("_az"), F.col("_el"), r))
    rid = F.when(F.coalesce(F.size("caps"), F.lit(0)) > 0, cap["region_id"]).otherwise(F.col("region.region_id"))
    return found.withColumn("region_id", rid).drop("caps", "_az", "_el")
