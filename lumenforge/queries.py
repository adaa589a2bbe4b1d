"""Registry of the engine's queries: name -> (Spark query, DuckDB oracle or None)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.functions import aces, color, transfer
from lumenforge.functions.curve import DEFAULT_ANCHORS, Curve, DisplayLayer, Grid, ambient_boost, curve_table, evaluate_anchors, table_lookup
from lumenforge.functions.num import clamp
from lumenforge.operators import export, fidelity, integrity, pixels, regions, temporal, tonemap, validation
from lumenforge.operators.pixels import rgb
from lumenforge.plans import oracle as o
from lumenforge.plans.frames import HEIGHT, WIDTH, conformance_pattern, grey_ramp, pixels_from_events
from lumenforge.sources import bitstream, container, images, metadata

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
KEY = ["frame_index", "pixel_idx"]
GRID = Grid(2, 2, ((1.0, 0.0), (0.8, 0.02), (1.1, -0.01), (0.9, 0.05)))
LUX = ((0.0, 100.0, 400.0), (0.9, 1.0, 1.3))
POLICY = tonemap.Policy(GRID, DisplayLayer(), LUX, 150.0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def nits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels_from_events(spark, sf_dir)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nits(spark, sf_dir).withColumns({c: transfer.pq_encode(F.col(c) / transfer.PEAK_NITS) for c in "rgb"})


def coarse(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.floor(clamp(c) * 31 + 0.5) / 31.0 for c in "rgb"})


def rounded(df: DataFrame, *cols: str, keys: list[str] = KEY, places: int = 9) -> DataFrame:
    return df.select(*keys, *(F.round(c, places).alias(c) for c in cols))


def triple(values: tuple[Column, ...]) -> dict[str, Column]:
    return dict(zip("rgb", values, strict=True))


# ---- transfer functions and colour ---------------------------------------------------------------------------


@query(f"{o.WITH} SELECT frame_index, COUNT(*) AS n_pixels, {o.r9(f'MAX(GREATEST({o.luma()}, 0))', 'peak_nits', 6)}, {o.r9(f'AVG(GREATEST({o.luma()}, 0))', 'average_nits', 6)}, {o.r9(f'AVG({o.d(o.KR)} * {o.pq("r / 10000")} + {o.d(o.KG)} * {o.pq("g / 10000")} + {o.d(o.KB)} * {o.pq("b / 10000")})', 'mean_pq_luma')} FROM p GROUP BY frame_index ORDER BY frame_index")
def frame_luminance_transcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.greatest(color.luma(rgb()), F.lit(0.0))
    coded = color.luma(tuple(transfer.pq_encode(c / transfer.PEAK_NITS) for c in rgb()))
    out = nits(spark, sf_dir).groupBy("frame_index").agg(F.count(F.lit(1)).alias("n_pixels"), F.max(y).alias("peak_nits"), F.avg(y).alias("average_nits"), F.avg(coded).alias("mean_pq_luma"))
    return out.select("frame_index", "n_pixels", F.round("peak_nits", 6).alias("peak_nits"), F.round("average_nits", 6).alias("average_nits"), F.round("mean_pq_luma", 9).alias("mean_pq_luma")).orderBy("frame_index")


@query(f"{o.WITH} SELECT {o.KEY}, {o.each(lambda c: o.pq(f'{c} / 10000'))} FROM p")
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal(spark, sf_dir), "r", "g", "b")


@query(f"SELECT event_id, {o.r9(f'{o.light("value / 500")} * 10000', 'nits', 5)} FROM events")
def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.round(transfer.pq_decode(F.col("value") / 500) * transfer.PEAK_NITS, 5).alias("nits"))


@query(f"SELECT event_id, CASE WHEN value * 40 - 500 BETWEEN 0 AND 10000 THEN {o.r9(o.pq('(value * 40 - 500) / 10000'), 'x').removesuffix(' AS x')} END AS signal FROM events")
def nits_to_pq_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.round(transfer.nits_to_pq(F.col("value") * 40 - 500), 9).alias("signal"))


@query(f"SELECT event_id, {o.r9(o.srgb('value / 500'), 'code')}, {o.r9(o.srgb_light('value / 500'), 'linear')} FROM events")
def srgb_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") / 500
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(transfer.srgb_encode(v), 9).alias("code"), F.round(transfer.srgb_decode(v), 9).alias("linear"))


def _matrix_sql(m) -> str:
    return f"{o.WITH} SELECT {o.KEY}, " + ", ".join(o.r9(o.row(m, i), c) for i, c in enumerate("rgb")) + " FROM p"


@query(_matrix_sql(o.TO_2020))
def rec709_to_rec2020(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nits(spark, sf_dir).withColumns(triple(color.rec709_to_rec2020(rgb()))), "r", "g", "b")


@query(_matrix_sql(o.TO_709))
def rec2020_to_rec709(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nits(spark, sf_dir).withColumns(triple(color.rec2020_to_rec709(rgb()))), "r", "g", "b")


@query(_matrix_sql(o.REC2020_TO_XYZ))
def rec2020_to_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nits(spark, sf_dir).withColumns(triple(color.rec2020_to_xyz(rgb()))), "r", "g", "b")


@query(_matrix_sql(o.XYZ_TO_REC2020))
def xyz_to_rec2020(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nits(spark, sf_dir).withColumns(triple(color.xyz_to_rec2020(rgb()))), "r", "g", "b")


_Y12 = f"{o.WITHS}, y AS (SELECT *, {o.luma()} AS y FROM s), q AS (SELECT {o.KEY}, nx, ny, {o.code('y', 4095)} AS y12, {o.code(f'(b - y) / {o.d(2 * (1 - o.KB))} + {o.d(0.5)}', 4095)} AS cb12, {o.code(f'(r - y) / {o.d(2 * (1 - o.KR))} + {o.d(0.5)}', 4095)} AS cr12 FROM y)"


@query(f"{_Y12} SELECT {o.KEY}, y12, cb12, cr12 FROM q")
def ycbcr12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.ycbcr12_round_trip(signal(spark, sf_dir)).select(*KEY, "y12", "cb12", "cr12")


_BACK = f"{_Y12}, k AS (SELECT {o.KEY}, CAST(y12 AS DOUBLE) / 4095 AS y, CAST(y12 AS DOUBLE) / 4095 + {o.d(2 * (1 - o.KR))} * (CAST(cr12 AS DOUBLE) / 4095 - {o.d(0.5)}) AS r, CAST(y12 AS DOUBLE) / 4095 + {o.d(2 * (1 - o.KB))} * (CAST(cb12 AS DOUBLE) / 4095 - {o.d(0.5)}) AS b FROM q)"


@query(f"{_BACK} SELECT {o.KEY}, {o.r9('r', 'r')}, {o.r9(f'(y - {o.d(o.KR)} * r - {o.d(o.KB)} * b) / {o.d(o.KG)}', 'g')}, {o.r9('b', 'b')} FROM k")
def ycbcr12_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.ycbcr12_round_trip(signal(spark, sf_dir)), "r", "g", "b")


@query(f"{o.WITHS} SELECT {o.KEY}, {', '.join(f'{o.code(c, 1023)} AS {c}' for c in 'rgb')} FROM s")
def hdr10_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.hdr10_codes(signal(spark, sf_dir)).select(*KEY, "r", "g", "b")


@query(f"{o.WITHS}, l AS (SELECT {o.KEY}, {', '.join(f'{o.light(c)} AS {c}' for c in 'rgb')} FROM s) SELECT {o.KEY}, {', '.join(o.r9(v, n, 6) for v, n in zip(o.lab_of(''), 'lmn', strict=True))} FROM l")
def cielab(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = pixels.linear_light(signal(spark, sf_dir))
    return rounded(lit.withColumns(dict(zip("lmn", color.lab(rgb()), strict=True))), "l", "m", "n", places=6)


# ---- frames --------------------------------------------------------------------------------------------------


@query(f"{o.WITH}, {o.STATS} SELECT st.frame_index, {o.r9('peak', 'peak_nits', 6)}, {o.r9('average', 'average_nits', 6)}, (SELECT COUNT(*) FROM p WHERE p.frame_index = st.frame_index) AS n_pixels FROM st")
def frame_luminance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.luminance_stats(nits(spark, sf_dir)).select("frame_index", F.round("peak_nits", 6).alias("peak_nits"), F.round("average_nits", 6).alias("average_nits"), "n_pixels")


@query(f"{o.WITH} SELECT {o.KEY}, " + ", ".join(f"CAST(FLOOR(LEAST(CAST(CAST({o.pq(f'CAST(CAST({c} / 10000 AS FLOAT) AS DOUBLE)')} AS FLOAT) AS DOUBLE), 1) * 65535 + 0.5) AS INTEGER) AS {c}" for c in "rgb") + " FROM p")
def transcode_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.transcode(nits(spark, sf_dir)).select(*KEY, *(F.floor(F.col(c) * 65_535 + 0.5).cast("int").alias(c) for c in "rgb"))


@query(f"{o.WITH}, n AS (SELECT {o.KEY}, CASE WHEN r > 9000 THEN CAST('NaN' AS DOUBLE) ELSE r END AS r, g, CASE WHEN b > 2300 THEN CAST('Infinity' AS DOUBLE) ELSE b END AS b FROM p), f AS (SELECT frame_index, MIN(pixel_idx) AS pixel_idx FROM n WHERE ISNAN(r) OR ISINF(b) GROUP BY frame_index) SELECT frame_index, pixel_idx, CASE WHEN ISNAN(r) THEN 'r' ELSE 'b' END AS channel FROM f JOIN n USING (frame_index, pixel_idx)")
def first_bad_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = nits(spark, sf_dir).withColumns({"r": F.when(F.col("r") > 9000, float("nan")).otherwise(F.col("r")), "b": F.when(F.col("b") > 2300, float("inf")).otherwise(F.col("b"))})
    return pixels.first_bad_pixel(broken)


@query(f"{_Y12} SELECT frame_index, (pixel_idx % 20) // 2 AS cx, pixel_idx // 20 // 2 AS cy, CAST((SUM(cb12) + 2) // 4 AS INTEGER) AS cb12, CAST((SUM(cr12) + 2) // 4 AS INTEGER) AS cr12 FROM q GROUP BY ALL")
def subsample_420(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.subsample_420(pixels.ycbcr12_round_trip(signal(spark, sf_dir)), WIDTH)


@query(f"{_Y12} SELECT {o.KEY}, y12, CAST((SUM(cb12) OVER w + 2) // 4 AS INTEGER) AS cb12, CAST((SUM(cr12) OVER w + 2) // 4 AS INTEGER) AS cr12 FROM q WINDOW w AS (PARTITION BY frame_index, (pixel_idx % 20) // 2, pixel_idx // 20 // 2)")
def upsample_420(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = pixels.ycbcr12_round_trip(signal(spark, sf_dir)).select(*KEY, "y12", "cb12", "cr12")
    return pixels.upsample_420(planes, pixels.subsample_420(planes, WIDTH), WIDTH)


_OVER = f"WITH {o.PIXELS}, l AS (SELECT {o.KEY}, {', '.join(f'{c} / 4000 AS {c}' for c in 'rgb')} FROM p), m AS (SELECT {o.KEY}, {', '.join(f'{o.row(o.TO_709, i)} AS {c}' for i, c in enumerate('rgb'))} FROM l), y AS (SELECT *, {o.luma()} AS y, LEAST(r, g, b) AS lo, GREATEST(r, g, b) AS hi FROM m), t AS (SELECT *, LEAST(GREATEST(CASE WHEN lo < 0 THEN CASE WHEN y - lo > 1e-12 THEN -lo / (y - lo) ELSE 1 END ELSE 0 END, CASE WHEN hi > 1 THEN CASE WHEN hi - y > 1e-12 THEN (hi - 1) / (hi - y) ELSE 1 END ELSE 0 END), 1) AS t FROM y)"


@query(f"{_OVER} SELECT {o.KEY}, {o.each(lambda c: f'CASE WHEN t <= 0 THEN {c} ELSE {o.clamp(f"y + (1 - t) * ({c} - y)")} END')} FROM t")
def gamut_map_709(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.gamut_map_709(nits(spark, sf_dir).withColumns({c: F.col(c) / 4000 for c in "rgb"})), "r", "g", "b")


@query(o.sdr(DEFAULT_ANCHORS, Curve().tangents()))
def sdr_dithered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tonemap.to_sdr(signal(spark, sf_dir), Curve()).select(*KEY, "r", "g", "b")


_SDR = f"WITH {o.PIXELS}, e AS (SELECT {o.KEY}, {', '.join(f'CAST(FLOOR({o.clamp(f"{c} / 4000")} * 255) AS INTEGER) AS {c}' for c in 'rgb')} FROM p), l AS (SELECT {o.KEY}, {', '.join(f'{o.srgb_light(f"CAST({c} AS DOUBLE) / 255")} AS {c}' for c in 'rgb')} FROM e), y AS (SELECT *, {o.luma()} AS y FROM l)"


@query(f"{_SDR} SELECT {o.KEY}, {o.each(lambda c: o.pq(f'GREATEST((({c} - y) * {o.d(1.02)} + y) * (1 + {o.d(0.3)} * POWER(y, {o.d(1.5)})) * (1 + {o.d(0.6)} * y * (1 - y)), 0) / 10'))} FROM y")
def inverse_tone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = nits(spark, sf_dir).withColumns({c: F.floor(clamp(F.col(c) / 4000) * 255).cast("int") for c in "rgb"})
    return rounded(pixels.inverse_tone_map(codes), "r", "g", "b")


# ---- curves, grids, policies ---------------------------------------------------------------------------------


@query(f"SELECT event_id, {o.r9(o.linear_curve('value / 500', DEFAULT_ANCHORS), 'mapped')} FROM events")
def curve_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(Curve("linear").evaluate(F.col("value") / 500), 9).alias("mapped"))


@query(f"SELECT event_id, {o.r9(o.linear_curve('value / 500', DEFAULT_ANCHORS), 'mapped')} FROM events")
def curve_of_each_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = F.array(*(F.struct(F.lit(a).alias("input"), F.lit(b).alias("output")) for a, b in DEFAULT_ANCHORS))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(evaluate_anchors(anchors, F.col("value") / 500), 9).alias("mapped"))


@query(f"SELECT event_id, {o.r9(o.hermite_curve('value / 500', DEFAULT_ANCHORS, Curve().tangents()), 'mapped')} FROM events")
def curve_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(Curve().evaluate(F.col("value") / 500), 9).alias("mapped"))


@query(f"SELECT i, {o.r9('x', 'input')}, {o.r9(o.hermite_curve('x', DEFAULT_ANCHORS, Curve().tangents()), 'output')} FROM (SELECT i, CAST(i AS DOUBLE) / 1023 AS x FROM RANGE(1024) t(i)) u")
def curve_lookup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curve_table(spark, Curve(), 1024), "input", "output", keys=["i"])


_CELLS = GRID.cells


@query(f"{o.WITH} SELECT {o.KEY}, " + ", ".join(o.r9(f"({o.d(_CELLS[0][k])} * (1 - nx) + {o.d(_CELLS[1][k])} * nx) * (1 - ny) + ({o.d(_CELLS[2][k])} * (1 - nx) + {o.d(_CELLS[3][k])} * nx) * ny", n) for k, n in ((0, "gain"), (1, "shift"))) + " FROM p")
def grid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain, shift = GRID.sample("nx", "ny")
    return rounded(nits(spark, sf_dir).withColumns({"gain": gain, "shift": shift}), "gain", "shift")


@query(f"SELECT event_id, {o.r9("CASE WHEN value <= 0 THEN 0.9 WHEN value <= 100 THEN 0.9 + value * 0.001 WHEN value <= 400 THEN 1 + (value - 100) * CAST(0.3 AS DOUBLE) / 300 ELSE 1.3 END", 'boost')} FROM events")
def ambient_boost_for_lux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(ambient_boost("value", *LUX), 9).alias("boost"))


@query("SELECT event_id, " + ", ".join(o.r9(o.clamp(f"value / 500 * {o.d(0.8)} * {o.d(1 + 0.5 * b)} + {o.d(0.004)}"), m) for m, b in (("oled", 0.04), ("lcd", -0.03), ("mini_led", 0.01), ("projector", -0.06))) + " FROM events")
def display_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") / 500
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", *(F.round(DisplayLayer().adapt(v, m), 9).alias(m) for m in ("oled", "lcd", "mini_led", "projector")))


def _policy_sql(c: str) -> str:
    gain, shift = (f"(({o.d(_CELLS[0][k])} * (1 - nx) + {o.d(_CELLS[1][k])} * nx) * (1 - ny) + ({o.d(_CELLS[2][k])} * (1 - nx) + {o.d(_CELLS[3][k])} * nx) * ny)" for k in (0, 1))
    v = o.clamp(f"{c} * {gain} + {shift}")
    v = o.clamp(f"{v} * {o.d(0.8)} * {o.d(1.02)} + {o.d(0.004)}")
    return f"FLOOR({o.clamp(f'{v} * {o.d(1.05)}')} * 65535 + 0.5) / 65535"


_CURVED = f"{o.WITHS}, u AS (SELECT {o.KEY}, nx, ny, {', '.join(f'{o.hermite_curve(f"{o.light(c)} * 10", DEFAULT_ANCHORS, Curve().tangents())} AS {c}' for c in 'rgb')} FROM s)"


@query(f"{_CURVED}, v AS (SELECT {o.KEY}, {', '.join(f'{_policy_sql(c)} AS {c}' for c in 'rgb')} FROM u) SELECT {o.KEY}, {o.each(lambda c: o.pq(f'{o.clamp(f"{c} * 1000", 0.0005, 1000.0)} / 10000'), 6)} FROM v")
def tone_map_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tonemap.tone_map(signal(spark, sf_dir), Curve(), policy=POLICY), "r", "g", "b", places=6)


@query(f"{_CURVED} SELECT {o.KEY}, {o.each(lambda c: o.pq(f'{o.clamp(f"{c} * 1000", 0.0005, 1000.0)} / 10000'), 6)} FROM u")
def tone_map_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tonemap.tone_map(signal(spark, sf_dir), Curve(), policy=tonemap.Policy(locked=True, deterministic=False)), "r", "g", "b", places=6)


# ---- fidelity ------------------------------------------------------------------------------------------------


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.frame_metrics(fidelity.derived(signal(spark, sf_dir), coarse))


@query(f"{o.fidelity()} SELECT frame_index, n_pixels, {', '.join(o.r9(c, c, 6) for c in ('psnr_db', 'ssim', 'delta_e'))} FROM f")
def frame_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_metrics(spark, sf_dir), "psnr_db", "ssim", "delta_e", keys=["frame_index", "n_pixels"], places=6)


_VMAF = f"0.45 * {o.clamp('(psnr_db - 20) / 30 * 100', 0.0, 100.0)} + 0.40 * {o.clamp('ssim * 100', 0.0, 100.0)} + 0.15 * {o.clamp('100 - delta_e * 6', 0.0, 100.0)}"


@query(f"{o.fidelity()}, v AS (SELECT *, {_VMAF} AS vmaf_hdr FROM f) SELECT frame_index, {o.r9('vmaf_hdr', 'vmaf_hdr', 6)}, CAST(psnr_db < 35 AS INTEGER) + CAST(ssim < 0.9 AS INTEGER) + CAST(delta_e > 4.5 AS INTEGER) + CAST(vmaf_hdr < 85 AS INTEGER) AS n_failures FROM v")
def fidelity_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two signals that come apart: their pixels are joined."""
    s = signal(spark, sf_dir)
    m = fidelity.frame_metrics(fidelity.paired(s, coarse(s))).withColumn("vmaf_hdr", fidelity.vmaf_surrogate())
    return m.select("frame_index", F.round("vmaf_hdr", 6).alias("vmaf_hdr"), F.size(fidelity.contract_failures()).alias("n_failures"))


@query(f"{o.fidelity()} SELECT COUNT(*) AS total, COUNT(*) FILTER (psnr_db >= 35 AND ssim >= 0.9) AS passed, COUNT(*) FILTER (NOT (psnr_db >= 35 AND ssim >= 0.9)) AS failed, BOOL_AND(psnr_db >= 35 AND ssim >= 0.9) AS all_passed FROM f")
def conformance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"psnr_db": 35.0, "ssim": 0.90}
    return fidelity.conformance_report(_metrics(spark, sf_dir).withColumn("passed", F.size(fidelity.contract_failures(limits)) == 0))


@query("SELECT event_id, CASE WHEN value <= 100 THEN ROUND(value, 2) END AS score FROM events")
def parse_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.lit("frame= 10 VMAF ready\nVMAF score: "), F.format_string("%.2f", "value"))
    return e.select("event_id", fidelity.parse_score(text).alias("score"))


# ---- regions -------------------------------------------------------------------------------------------------

BOXES = ((1, 0.1, 0.1, 0.5, 0.5, 5), (2, 0.3, 0.3, 0.5, 0.6, 5), (3, 0.7, 0.0, 0.3, 0.2, 9))
CAPS = ((7, math.pi, 0.2, 1.2, 1.0, 4), (8, 0.0, 0.0, 1.5, 0.75, 10))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = nits(spark, sf_dir).select("frame_index").distinct()
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("region_id"), F.lit(k).alias("ordinal"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(p).alias("priority")) for k, (i, x, y, w, h, p) in enumerate(BOXES)))
    return frames.select("frame_index", F.explode(rows).alias("x")).select("frame_index", "x.*")


def _caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = nits(spark, sf_dir).select("frame_index").distinct()
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("region_id"), F.lit(k).alias("ordinal"), F.lit(a).alias("centre_azimuth"), F.lit(e).alias("centre_elevation"), F.lit(w).alias("angular_width"), F.lit(h).alias("angular_height"), F.lit(p).alias("priority")) for k, (i, a, e, w, h, p) in enumerate(CAPS)))
    return frames.select("frame_index", F.explode(rows).alias("x")).select("frame_index", "x.*")


_IN = "CASE " + " ".join(f"WHEN nx >= {o.d(x)} AND nx < {o.d(x + w)} AND ny >= {o.d(y)} AND ny < {o.d(y + h)} THEN {i}" for i, x, y, w, h, _ in (BOXES[2], BOXES[1], BOXES[0])) + " END"


@query(f"{o.WITH} SELECT {o.KEY}, CAST({_IN} AS BIGINT) AS region_id FROM p")
def region_flat_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.resolve_flat(nits(spark, sf_dir), _boxes(spark, sf_dir)).select(*KEY, F.col("region.region_id").alias("region_id"))


_AE = f"a AS (SELECT {o.KEY}, (nx - 0.5) * {o.d(2 * math.pi)} AS az, (0.5 - ny) * {o.d(math.pi)} AS el FROM p)"
_DAZ = lambda c: f"ABS(az - {o.d(c)} + {o.d(math.pi)} - {o.d(2 * math.pi)} * FLOOR((az - {o.d(c)} + {o.d(math.pi)}) / {o.d(2 * math.pi)}) - {o.d(math.pi)})"


@query(f"{o.WITH}, {_AE} SELECT {o.KEY}, CAST(CASE " + " ".join(f"WHEN ABS(el - {o.d(e)}) <= {o.d(h / 2)} AND {_DAZ(a)} <= {o.d(w / 2)} THEN {i}" for i, a, e, w, h, _ in reversed(CAPS)) + " END AS BIGINT) AS region_id FROM a")
def region_sphere_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.resolve_region(nits(spark, sf_dir), _boxes(spark, sf_dir), _caps(spark, sf_dir), "equirectangular").select(*KEY, "region_id")


def _cube_sql(warp: bool) -> str:
    uv = [f"(n{a} * {k} - f{a}) * 2 - 1" for a, k in (("x", 3), ("y", 2))]
    u, v = (f"TAN(({x}) * {o.d(math.pi / 4)})" if warp else x for x in uv)
    pick = lambda cases: "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"
    return f"""{o.WITH}, f AS (SELECT *, LEAST(FLOOR(nx * 3), 2) AS fx, LEAST(FLOOR(ny * 2), 1) AS fy FROM p), g AS (SELECT {o.KEY}, CAST(fy * 3 + fx AS INTEGER) AS f, {u} AS u, {v} AS v FROM f),
      h AS (SELECT {o.KEY}, {pick(("1", "u", "u", "-1", "u", "-u"))} AS x, {pick(("-v", "1", "-v", "-v", "-1", "-v"))} AS y, {pick(("-u", "v", "1", "u", "-v", "-1"))} AS z FROM g)
      SELECT {o.KEY}, {o.r9("ATAN2(x, z)", "azimuth")}, {o.r9("ATAN2(y, SQRT(x * x + z * z))", "elevation")} FROM h"""


@query(_cube_sql(False))
def cubemap_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    az, el = regions.cubemap(F.col("nx"), F.col("ny"))
    return rounded(nits(spark, sf_dir).withColumns({"azimuth": az, "elevation": el}), "azimuth", "elevation")


@query(_cube_sql(True))
def equi_angular_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    az, el = regions.cubemap(F.col("nx"), F.col("ny"), True)
    return rounded(nits(spark, sf_dir).withColumns({"azimuth": az, "elevation": el}), "azimuth", "elevation")


MOVING = "named_struct('x', 0.1D, 'y', 0.2D, 'width', 0.25D, 'height', 0.25D, 'motion', named_struct('kind', {kind}, 'frame_count', 30L, 'dx_per_frame', 0.01D, 'dy_per_frame', 0.005D, 'keyframes', array(named_struct('frame_delta', 0L, 'dx', 0.0D, 'dy', 0.0D), named_struct('frame_delta', 10L, 'dx', 0.2D, 'dy', 0.1D), named_struct('frame_delta', 25L, 'dx', 0.3D, 'dy', 0.4D))))"


@query("""WITH f AS (SELECT DISTINCT event_id // 200 AS i FROM events), k AS (SELECT i, k FROM f, (VALUES ('static'), ('translate'), ('piecewise_linear')) t(k)),
  m AS (SELECT i, k, CASE k WHEN 'piecewise_linear' THEN 26 ELSE 30 END AS n, CAST(CASE k WHEN 'static' THEN 0 WHEN 'translate' THEN 0.01 * i ELSE CASE WHEN i <= 10 THEN 0.02 * i ELSE 0.2 + 0.1 * (i - 10) / 15 END END AS DOUBLE) AS dx,
    CAST(CASE k WHEN 'static' THEN 0 WHEN 'translate' THEN 0.005 * i ELSE CASE WHEN i <= 10 THEN 0.01 * i ELSE 0.1 + 0.3 * (i - 10) / 15 END END AS DOUBLE) AS dy FROM k)
  SELECT i AS frame_index, k AS kind, CASE WHEN i < n THEN ROUND(0.1 + dx, 9) END AS x, CASE WHEN i < n THEN ROUND(0.2 + dy, 9) END AS y FROM m""")
def region_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = nits(spark, sf_dir).select("frame_index").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, ("static", "translate", "piecewise_linear")))))
    at = frames.withColumn("region", F.expr(MOVING.format(kind="kind"))).withColumn("box", regions.box_at(F.col("region"), F.col("frame_index")))
    return at.select("frame_index", "kind", F.round("box.x", 9).alias("x"), F.round("box.y", 9).alias("y"))


def _region_sql(c: str) -> str:
    return o.pq(f"CASE WHEN {_IN} = 2 THEN {o.clamp(f'{o.linear_curve(f"{o.light(c)} * 10", ((0.0, 0.0), (1.0, 1.0)))} * 1000', 0.0005, 1000.0)} ELSE {o.clamp(f'{o.hermite_curve(f"{o.light(c)} * 10", DEFAULT_ANCHORS, Curve().tangents())} * 1000', 0.0005, 1000.0)} END / 10000")


@query(f"{o.WITHS} SELECT {o.KEY}, {o.each(_region_sql, 6)} FROM s")
def tone_map_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regions.resolve_flat(signal(spark, sf_dir), _boxes(spark, sf_dir)).withColumn("region_id", F.col("region.region_id"))
    return rounded(tonemap.tone_map_regions(found, {2: Curve("linear", ((0.0, 0.0), (1.0, 1.0)))}, Curve()), "r", "g", "b", places=6)


# ---- time ----------------------------------------------------------------------------------------------------


def gain_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of four streams with times that run over and under budget, and the mean luma of their pixels."""
    luma = signal(spark, sf_dir).groupBy("frame_index").agg(F.avg(color.luma(rgb())).alias("luma"))
    return luma.select(F.concat(F.lit("s"), (F.col("frame_index") % 4).cast("string")).alias("stream_id"), "frame_index", (4.0 + F.col("frame_index") % 13).alias("frame_time_ms"), "luma", (F.col("frame_index") % 11 == 10).alias("locked"))


@query(o.gains(temporal.Controller(), f"{o.WITHS}, m AS (SELECT * FROM s)", "SELECT stream_id, frame_index, ROUND(gain, 9) AS gain FROM g WHERE k > 0"))
def gain_stabilised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.stabilise(gain_frames(spark, sf_dir)), "gain", keys=["stream_id", "frame_index"])


_MAPPED = f"{_CURVED}, m AS (SELECT {o.KEY}, {', '.join(f'{o.pq(f'{o.clamp(f"{c} * 1000", 0.0005, 1000.0)} / 10000')} AS {c}' for c in 'rgb')} FROM u)"
_SNAPPED = lambda c: f"CASE WHEN g.locked THEN m.{c} ELSE FLOOR({o.clamp(f'm.{c} * g.gain')} * 65535 + 0.5) / 65535 END"


@query(o.gains(temporal.Controller(), _MAPPED, f"SELECT m.frame_index, m.pixel_idx, {o.each(_SNAPPED, 6)} FROM m JOIN g ON m.frame_index = g.frame_index"))
def tone_map_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone mapping and the gain controller over four streams, its gains on the pixels."""
    streams = signal(spark, sf_dir).withColumn("stream_id", F.concat(F.lit("s"), (F.col("frame_index") % 4).cast("string")))
    times = gain_frames(spark, sf_dir).select("stream_id", "frame_index", "frame_time_ms", "locked")
    mapped = tonemap.tone_map(streams, Curve(), policy=tonemap.Policy(deterministic=False))
    gains = temporal.stabilise(mapped.groupBy("stream_id", "frame_index").agg(F.avg(color.luma(rgb())).alias("luma")).join(times, ["stream_id", "frame_index"]))
    passing = gains.join(times.where("not locked"), ["stream_id", "frame_index"], "left_semi")
    return rounded(tonemap.apply_gain(mapped, passing, ("stream_id", "frame_index")), "r", "g", "b", places=6)


@query("""SELECT frame_index, position, CASE WHEN frame_index = before THEN 'frame index comes twice' WHEN most > frame_index THEN 'frame comes after a later one' WHEN frame_index <> COALESCE(before + 1, 0) THEN 'frames are missing before this one' END AS failure
  FROM (SELECT *, LAG(frame_index) OVER w AS before, ROW_NUMBER() OVER w - 1 AS position, MAX(frame_index) OVER (PARTITION BY s ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most
    FROM (SELECT i % 4 AS s, i // 4 - CASE WHEN i % 23 = 5 THEN 1 ELSE 0 END AS frame_index, CASE WHEN i % 17 = 3 THEN i + 9 ELSE i END AS arrival FROM (SELECT DISTINCT event_id // 20 AS i FROM events) e WHERE i % 31 <> 7) p
    WINDOW w AS (PARTITION BY s ORDER BY frame_index, arrival)) q""")
def encode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of four streams, of which some are late, lost or come twice."""
    i = F.col("i")
    packets = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("event_id div 20").alias("i")).distinct().where("i % 31 != 7")
    packets = packets.select((i % 4).alias("stream_id"), (F.floor(i / 4) - F.when(i % 23 == 5, 1).otherwise(0)).alias("frame_index"), F.when(i % 17 == 3, i + 9).otherwise(i).alias("arrival"))
    return temporal.encode_order(packets).select("frame_index", "position", "failure")


@query("WITH f AS (SELECT DISTINCT event_id // 200 AS i FROM events) SELECT i % 4 AS stream_id, i // 4 AS frame_index, SUM(CASE WHEN i // 4 % 3 = 0 AND i >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY i % 4 ORDER BY i)::BIGINT AS segment FROM f")
def keyframe_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = nits(spark, sf_dir).select("frame_index").distinct().select((F.col("frame_index") % 4).alias("stream_id"), F.expr("frame_index div 4").alias("frame_index"))
    return temporal.keyframe_segments(frames.withColumn("is_keyframe", F.col("frame_index") % 3 == 0)).select("stream_id", "frame_index", "segment")


@query("SELECT DISTINCT CONCAT('t', event_id // 200 % 5) AS track, event_id // 1000 AS chunk, CAST(CASE WHEN event_id // 1000 >= 3 + event_id // 200 % 5 THEN 3 WHEN event_id // 1000 >= 1 THEN 7 ELSE 4 END AS INTEGER) AS samples FROM events")
def samples_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = nits(spark, sf_dir).select(F.concat(F.lit("t"), F.col("frame_index") % 5).alias("track"), F.expr("frame_index div 5").alias("chunk")).distinct()
    entries = spark.createDataFrame([(f"t{k}", at, n) for k in range(5) for at, n in ((0, 4), (1, 7), (3 + k, 3))], "track string, first_chunk long, samples int")
    return temporal.samples_per_chunk(chunks, entries)


# ---- metadata ------------------------------------------------------------------------------------------------


def dynamic_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_index, dynamic_meta): every frame's statistics as metadata; odd frames carry a v2 payload."""
    stats = pixels.luminance_stats(nits(spark, sf_dir))
    anchors = "array(" + ", ".join(f"named_struct('input', {a}D, 'output', {b}D)" for a, b in DEFAULT_ANCHORS) + ")"
    v2 = """IF(frame_index % 2 = 1, named_struct('temporal', named_struct('max_global_gain_delta_per_frame', 0.08D, 'anti_pumping_strength', 0.7D),
      'ambient_policy', named_struct('lux_breakpoints', array(0D, 100D, 400D), 'boost_multipliers', array(0.9D, 1.0D, 1.3D), 'max_delta_per_second', 0.5D),
      'gaming_profile', IF(frame_index % 4 = 1, named_struct('frame_time_budget_ms', 6.5D, 'anti_pumping_strength', 0.9D, 'max_gain_delta_per_frame', 0.04D), NULL)), NULL)"""
    meta = f"""named_struct('metadata_schema_version', IF(frame_index % 2 = 1, 2, 1), 'frame_index', frame_index, 'scene_peak_luminance_nits', peak_nits,
      'scene_average_luminance_nits', average_nits, 'tone_map_curve', named_struct('type', 'bezier', 'anchors', {anchors}),
      'target_display_hint', named_struct('min_luminance_nits', 0.0005D, 'max_luminance_nits', 1000D), 'open_dynamic_v2', {v2})"""
    # Fields that a struct lacks come as nulls of their type by way of JSON.
    return stats.select("frame_index", F.from_json(F.to_json(F.expr(meta)), validation.DYNAMIC).alias("dynamic_meta"))


_PCT = lambda positions, bits: "CONCAT_WS(',', " + ", ".join(f"CAST(FLOOR({o.clamp(f'peak * {o.d(p)} / 10000')} * {(1 << bits) - 1} + 0.5) AS INTEGER)" for p in positions) + ")"
_BITS = lambda x, bits: f"CAST(FLOOR({o.clamp(f'{x} / 10000')} * {(1 << bits) - 1} + 0.5) AS INTEGER)"
_ANCHORS = lambda bits: ",".join(str(int(b * ((1 << bits) - 1) + 0.5)) for a, b in DEFAULT_ANCHORS if 0 < a < 1)
_BASIC = f"frame_index, CAST(FLOOR(peak + 0.5) AS BIGINT) AS display_max, {_BITS('average', 10)} AS average_maxrgb, {_BITS('peak', 10)} AS maxscl, {_PCT(export.PCT10, 10)} AS distribution, '{_ANCHORS(10)}' AS anchors, 256 AS knee_x, 225 AS knee_y"
_WIDE = f"{_BITS('average', 16)} AS average_16, {_BITS('peak', 16)} AS maxscl_16, {_PCT(export.PCT15, 16)} AS distribution_16, '{_ANCHORS(16)}' AS anchors_16"


def _basic_columns(e: str = "entry") -> list[Column]:
    c = F.col
    return [
        c(f"{e}.targeted_system_display_maximum_luminance").alias("display_max"), c(f"{e}.average_maxrgb").alias("average_maxrgb"), F.get(f"{e}.maxscl", F.lit(2)).alias("maxscl"),
        F.array_join(f"{e}.distribution_values", ",").alias("distribution"), F.array_join(f"{e}.bezier_curve_anchors", ",").alias("anchors"), c(f"{e}.knee_point_x").alias("knee_x"), c(f"{e}.knee_point_y").alias("knee_y"),
    ]


def _wide_columns(e: str = "entry") -> list[Column]:
    return [F.col(f"{e}.average_maxrgb_16bit").alias("average_16"), F.get(f"{e}.maxscl_16bit", F.lit(0)).alias("maxscl_16"), F.array_join(f"{e}.distribution_values_16bit", ",").alias("distribution_16"), F.array_join(f"{e}.bezier_curve_anchors_16bit", ",").alias("anchors_16")]


@query(f"{o.WITH}, {o.STATS} SELECT {_BASIC} FROM st")
def hdr10plus_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.profile_export(dynamic_frames(spark, sf_dir), "basic").select("frame_index", *_basic_columns())


@query(f"{o.WITH}, {o.STATS} SELECT {_BASIC}, {_WIDE} FROM st")
def hdr10plus_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.profile_export(dynamic_frames(spark, sf_dir), "advanced").select("frame_index", *_basic_columns(), *_wide_columns())


@query(f"{o.WITH}, {o.STATS} SELECT frame_index, {_BITS('peak', 16)} AS maxscl_16, CAST(CASE WHEN frame_index % 2 = 1 THEN 100 ELSE 0 END AS DOUBLE) AS lux, CAST(1 AS DOUBLE) AS boost, 16384 AS boost_16, CASE WHEN frame_index % 2 = 1 THEN 8192 ELSE 0 END AS rate_16 FROM st")
def hdr10plus_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = export.profile_export(dynamic_frames(spark, sf_dir), "adaptive")
    return e.select("frame_index", F.get("entry.base.maxscl_16bit", F.lit(0)).alias("maxscl_16"), F.col("entry.ambient_lux").alias("lux"), F.col("entry.ambient_boost_multiplier").alias("boost"), F.col("entry.ambient_boost_multiplier_16bit").alias("boost_16"), F.col("entry.adaptation_max_delta_per_second_16bit").alias("rate_16"))


@query(f"{o.WITH}, {o.STATS} SELECT frame_index, CAST(CASE WHEN frame_index % 4 = 1 THEN 6.5 ELSE 8.3 END AS DOUBLE) AS budget, CAST(FLOOR(CAST(CASE WHEN frame_index % 4 = 1 THEN 0.9 WHEN frame_index % 2 = 1 THEN 0.7 ELSE 0.8 END AS DOUBLE) * 65535 + 0.5) AS INTEGER) AS strength_16, CAST(FLOOR(CAST(CASE WHEN frame_index % 4 = 1 THEN 0.04 WHEN frame_index % 2 = 1 THEN 0.08 ELSE 0.05 END AS DOUBLE) / 0.25 * 65535 + 0.5) AS INTEGER) AS delta_16 FROM st")
def hdr10plus_gaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = export.profile_export(dynamic_frames(spark, sf_dir), "gaming")
    return e.select("frame_index", F.col("entry.frame_time_budget_ms").alias("budget"), F.col("entry.anti_pumping_strength_16bit").alias("strength_16"), F.col("entry.max_gain_delta_per_frame_16bit").alias("delta_16"))


_UNION = lambda base, more: ";".join(sorted((*base, *more)))


@query(f"SELECT DISTINCT 'hdr10' AS target, '{_UNION(('target_display_hint.min_luminance_nits',), export.HDR10_DROPPED_V2)}' AS dropped, '{_UNION(export.HDR10_APPROXIMATED, ('open_dynamic_v2.adaptation_layer -> static mastering display assumption',))}' AS approximated, 'open_dynamic_v2 inverse reconstruction hints' AS unsupported FROM events")
def loss_report_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = dynamic_frames(spark, sf_dir).select(F.lit("hdr10").alias("target"), export.hdr10_loss(F.col("dynamic_meta.open_dynamic_v2")).alias("report"))
    m = export.merge_reports(reports, ["target"])
    return m.select("target", F.array_join("dropped_fields", ";").alias("dropped"), F.array_join("approximated_fields", ";").alias("approximated"), F.array_join("unsupported_features", ";").alias("unsupported"))


@query(f"{o.WITH}, {o.STATS} SELECT frame_index, {o.r9(o.clamp('peak / 10000'), 'fraction')}, 5 AS n_anchors, FALSE AS generated FROM st")
def open_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dynamic_frames(spark, sf_dir).select(export.open_sidecar(F.col("dynamic_meta")).alias("s"))
    return s.select("s.frame_index", F.round("s.target_max_linear_fraction", 9).alias("fraction"), F.size("s.curve_anchors").alias("n_anchors"), F.col("s.proprietary_bitstream_generated").alias("generated"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 50 END AS frame_delta, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 0.25 END::DOUBLE AS dx FROM events")
def parse_motion_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("event_id") % 50).cast("string"), F.when(F.col("event_id") % 3 == 0, ":0.25").otherwise(":0.25:-0.5"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", export.parse_keyframe(text).alias("k")).select("event_id", "k.frame_delta", "k.dx")


@query(f"{o.WITH}, {o.STATS} SELECT frame_index, CASE frame_index % 5 WHEN 0 THEN NULL WHEN 1 THEN 'scene luminance values must be non-negative' WHEN 2 THEN 'scene_average_luminance_nits exceeds scene_peak_luminance_nits' WHEN 3 THEN 'display hint requires max_luminance_nits > min_luminance_nits' ELSE 'metadata_schema_version is unsupported' END AS failure FROM st")
def validate_dynamic_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("frame_index") % 5, F.col("dynamic_meta")
    broken = (
        m.withField("scene_average_luminance_nits", F.when(k == 1, -1.0).when(k == 2, m["scene_peak_luminance_nits"] + 1).otherwise(m["scene_average_luminance_nits"]))
        .withField("target_display_hint.max_luminance_nits", F.when(k == 3, 0.0).otherwise(m["target_display_hint"]["max_luminance_nits"]))
        .withField("metadata_schema_version", F.when(k == 4, 3).otherwise(m["metadata_schema_version"]))
    )
    return dynamic_frames(spark, sf_dir).withColumn("d", broken).select("frame_index", validation.first_failure(validation.dynamic_meta(F.col("d"))).alias("failure"))


@query(f"{o.WITH}, {o.STATS} SELECT frame_index, CASE WHEN frame_index % 3 = 2 THEN 'static and dynamic metadata schema versions must match' WHEN frame_index % 2 = 1 AND frame_index % 7 = 3 THEN 'mastering-tier files must not carry open_dynamic_v2.ambient_policy (delivery-only adaptation)' END AS failure FROM st")
def compatibility_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, m = F.col("frame_index"), F.col("dynamic_meta")
    version = m["metadata_schema_version"]
    rules = validation.compatibility(F.when(i % 3 == 2, 3 - version).otherwise(version), version, F.when(i % 7 == 3, "mastering").otherwise("delivery"), m["open_dynamic_v2"], m["inverse_tone_mapping_hint"])
    return dynamic_frames(spark, sf_dir).select("frame_index", validation.first_failure(rules).alias("failure"))


# ---- integrity and files -------------------------------------------------------------------------------------


@query("SELECT event_id, SHA256(props) AS sha256 FROM events")
def payload_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", integrity.payload_sha256(F.col("props")).alias("sha256"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'payload hash mismatch' WHEN event_id % 10 = 4 THEN 'signature mismatch' END AS failure FROM events")
def manifest_sign_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("props").alias("payload"))
    m = integrity.sign(e, "studio", b"test key")
    k = F.col("event_id") % 10
    forged = m.withColumns({"payload": F.when(k == 3, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")), "signature_hex": F.when(k == 4, F.sha2("signature_hex", 256)).otherwise(F.col("signature_hex"))})
    return integrity.verify(forged, b"test key").select("event_id", "failure")


@query(o.stream_hashes(5))
def stream_canonical_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of five streams' frames, hashed in order."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pixel_idx")
        return pd.DataFrame({"frame_index": [part.frame_index.iloc[0]], "pixels": [part[["r", "g", "b"]].to_numpy("<f4").tobytes()]})

    frames = nits(spark, sf_dir).select(*KEY, "r", "g", "b").groupBy("frame_index").applyInPandas(pack, "frame_index long, pixels binary")
    return integrity.stream_sha256(frames.select((F.col("frame_index") % 5).cast("string").alias("stream_id"), "frame_index", F.lit("{}").alias("meta_json"), "pixels"))


@query(o.aces_rec709(aces))
def aces_rec709(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aces.render(nits(spark, sf_dir), "rec709_100nit"), "r", "g", "b")


@query(o.aces_rec2020(aces, 1000.0))
def aces_rec2020_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aces.render(nits(spark, sf_dir), "rec2020_1000nit"), "r", "g", "b")


@query(o.aces_rec2020(aces, 4000.0))
def aces_rec2020_4000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aces.render(nits(spark, sf_dir), "rec2020_4000nit"), "r", "g", "b")


@query(f"{o.WITH} SELECT {o.KEY}, " + ", ".join(o.r9(f"{o.row(aces.REC2020_TO_AP0, i)} / 203", c) for i, c in enumerate("rgb")) + " FROM p")
def aces_ap0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aces.render(nits(spark, sf_dir), "ap0"), "r", "g", "b")


@query("SELECT DISTINCT event_id // 200 AS stream, 2 AS version, 'mastering' AS tier, 20 AS width, 10 AS height, 1 AS frames, 4800 AS payload_bytes FROM events")
def container_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes each frame as a container of its own and reads it back, on the executors."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        body = part.sort_values("pixel_idx")[["r", "g", "b"]].to_numpy("<f8").tobytes()
        data = container.build(container.Header(2, "mastering", 0, WIDTH, HEIGHT, 1, 0), '{"metadata_schema_version":2}', [('{"frame_index":0}', body)])
        head, _, frames = container.parse(data)
        _, _, at, n = frames[0]
        assert data[at : at + n] == body
        return pd.DataFrame({"stream": [part.frame_index.iloc[0]], "version": [head.version], "tier": [head.tier], "width": [head.width], "height": [head.height], "frames": [head.frames], "payload_bytes": [n]})

    return nits(spark, sf_dir).select(*KEY, "r", "g", "b").groupBy("frame_index").applyInPandas(one, "stream long, version int, tier string, width int, height int, frames int, payload_bytes int")


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder where the session keeps shared files; a local one only where it names none."""
    import tempfile
    import uuid

    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()}/{name}-{uuid.uuid4().hex}"


@query(f"""{o.WITH}, v AS ({" UNION ALL ".join(o.float_bits(c, "p", f"{o.KEY}, {i} AS channel") for i, c in enumerate("rgb"))}),
  b AS (SELECT frame_index, UNHEX(STRING_AGG({o.hex_le('CAST(bits AS BIGINT)', 4)}, '' ORDER BY pixel_idx, channel)) AS b FROM v GROUP BY frame_index)
  SELECT CONCAT('stream-', frame_index % 3, '.bin') AS name, frame_index // 3 AS frame_index, CAST(OCTET_LENGTH(b) AS BIGINT) AS n_bytes, SHA256(b) AS sha256 FROM b""")
def container_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes three streams of frames as files and reads them back, by ranges of four frames each."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pixel_idx")
        return pd.DataFrame({"i": [part.frame_index.iloc[0]], "payload": [part[["r", "g", "b"]].to_numpy("<f4").tobytes()]})

    frames = nits(spark, sf_dir).select(*KEY, "r", "g", "b").groupBy("frame_index").applyInPandas(pack, "i long, payload binary")
    counts = nits(spark, sf_dir).select("frame_index").distinct().groupBy((F.col("frame_index") % 3).alias("s")).agg(F.count(F.lit(1)).cast("int").alias("frame_count"))
    rows = frames.withColumn("s", F.col("i") % 3).join(counts, "s").select(
        F.concat(F.lit("stream-"), F.col("s"), F.lit(".bin")).alias("name"), F.lit(2).alias("version"), F.lit("delivery").alias("tier"), F.lit(0).alias("codec"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
        "frame_count", F.lit('{"metadata_schema_version":2}').alias("static_meta"), F.expr("i div 3").alias("frame_index"), F.concat(F.lit('{"frame_index":'), F.expr("i div 3"), F.lit("}")).alias("dynamic_meta"), "payload",
    )
    folder = _shared(spark, "containers")
    container.write_containers(rows, folder)
    back = spark.read.format("frames").options(path=folder, payload="true", range_frames="4", long_file="1000").load()
    return back.select(F.substring_index("path", "/", -1).alias("name"), "frame_index", F.col("payload_length").alias("n_bytes"), F.sha2("payload", 256).alias("sha256"))


@query("SELECT event_id, SHA256(props) AS item, SHA256(CONCAT('{\"event\":', event_id, '}')) AS metadata FROM events WHERE props <> ''")
def still_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties as the coded item of a still picture with metadata, and both read back."""

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [bitstream.read_avif(bitstream.write_avif(p.encode(), 16, 16, f'{{"event":{i}}}'.encode())) for i, p in zip(b.event_id, b.props, strict=True)]
            yield pd.DataFrame({"event_id": b.event_id, "item": [r[1] for r in read], "metadata": [r[2] for r in read]})

    back = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props").where("props != ''").mapInPandas(files, "event_id long, item binary, metadata binary")
    return back.select("event_id", F.sha2("item", 256).alias("item"), F.sha2("metadata", 256).alias("metadata"))


@query("SELECT frame_index, CAST(t AS INTEGER) AS sample, t * (1000 + frame_index) AS decode_time FROM (SELECT DISTINCT event_id // 200 AS frame_index FROM events) f, LATERAL (SELECT UNNEST(RANGE(3 + frame_index % 9)) AS t) s")
def fragment_decode_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode times of files of some samples in fragments of two, read back from their boxes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in b.frame_index:
                samples = [(bytes([i]), i % 2 == 0) for i in range(3 + f % 9)]
                data = b"".join(bitstream.write_fragments([samples[i : i + 2] for i in range(0, len(samples), 2)], 16, 16, 1000 + f))
                times = [t for t, _ in bitstream.fragment_times(data)]
                yield pd.DataFrame({"frame_index": f, "sample": range(len(times)), "decode_time": times})

    return nits(spark, sf_dir).select("frame_index").distinct().mapInPandas(run, "frame_index long, sample int, decode_time long")


@query("SELECT CAST(event_id AS VARCHAR) AS path, 'ivf' AS kind, CAST(0 AS BIGINT) AS unit, props AS payload FROM events")
def bitstream_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeds each event's properties into a temporal unit in an IVF file and finds them again."""

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = bytes([2 << 3 | 2, 0, 6 << 3 | 2, 3, 1, 2, 3])
        for b in batches:
            yield pd.DataFrame({"path": b.event_id.astype(str), "content": [bitstream.write_ivf([bitstream.embed(unit, p.encode())], 16, 16, 24.0) for p in b.props]})

    made = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.coalesce("props", F.lit("")).alias("props")).mapInPandas(files, "path string, content binary")
    return bitstream.probe(made).select("path", "kind", "unit", F.decode("payload", "UTF-8").alias("payload"))


@query(o.frame_images())
def frame_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = images.frames_as_bytes(pixels.hdr10_codes(signal(spark, sf_dir)), WIDTH)
    return made.select("frame_index", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query("SELECT CAST(i // 64 AS BIGINT) AS frame_index, CAST(i % 64 AS BIGINT) AS pixel_idx, ROUND(CAST(i % 64 % 16 AS DOUBLE) / 15 * 1000, 9) AS r FROM RANGE(128) t(i)")
def grey_ramp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grey_ramp(spark, frames=2), "r")


@query("SELECT CAST(i AS BIGINT) AS pixel_idx, ROUND(LEAST(x * 1350 + p * 120, 10000), 9) AS r, ROUND(LEAST(y * 1350 + p * 90, 10000), 9) AS g, ROUND(LEAST((x * 0.6 + y * 0.4) * 1350 + p * 60, 10000), 9) AS b FROM (SELECT i, x, y, SIN(3 * (x * 17 + y * 13)) * 0.5 + 0.5 AS p FROM (SELECT i, CAST(i % 64 AS DOUBLE) / 63 AS x, CAST(i // 64 AS DOUBLE) / 63 AS y FROM RANGE(4096) t(i)) a) b")
def conformance_pattern_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(conformance_pattern(spark, 2), "r", "g", "b", keys=["pixel_idx"])


@query(f"{o.WITHS} SELECT frame_index, {o.r9('AVG((r + g + b) / 3)', 'mean_signal')} FROM s GROUP BY frame_index")
def frame_mean_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.mean_signal(signal(spark, sf_dir)), "mean_signal", keys=["frame_index"])


@query(f"{o.WITH}, {o.STATS} SELECT event_id // 100 AS packet, event_id // 200 AS frame_index, {o.r9('MAX(peak)', 'peak_nits', 6)} FROM events LEFT JOIN st ON st.frame_index = event_id // 200 AND st.frame_index % 2 = 0 GROUP BY ALL")
def packets_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("event_id div 100").alias("packet"), F.expr("event_id div 200").alias("frame_index")).distinct()
    stats = pixels.luminance_stats(nits(spark, sf_dir)).where("frame_index % 2 = 0").select("frame_index", F.round("peak_nits", 6).alias("peak_nits"))
    return pixels.with_metadata(packets, stats).select("packet", "frame_index", "peak_nits")


@query(f"{o.WITH}, {o.STATS} SELECT frame_index, CASE WHEN frame_index % 2 = 1 THEN 2 ELSE 1 END AS version, {o.r9('peak', 'peak_nits', 6)}, CAST(NULL AS VARCHAR) AS error FROM st")
def metadata_binary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's metadata to its binary form and back."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            yield pd.DataFrame({"frame_index": b.frame_index, "content": [metadata.encode(json.loads(j)) for j in b.j]})

    blobs = dynamic_frames(spark, sf_dir).select("frame_index", F.to_json("dynamic_meta").alias("j")).mapInPandas(pack, "frame_index long, content binary")
    back = metadata.decode_table(blobs).withColumn("m", F.from_json("json", validation.DYNAMIC))
    return back.select("frame_index", F.col("m.metadata_schema_version").alias("version"), F.round("m.scene_peak_luminance_nits", 6).alias("peak_nits"), "error")


@query("SELECT DISTINCT event_id // 200 AS frame_index, ROUND(CASE WHEN event_id // 200 >= 2 THEN 0.4 / CAST(event_id // 200 - 1 AS DOUBLE) END, 9) AS dx, ROUND(CASE WHEN event_id // 200 >= 2 THEN CAST(0.3 AS DOUBLE) / (event_id // 200 - 1) END, 9) AS dy FROM events")
def region_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas that take a box to a place within as many frames as each row says."""
    t = regions.translation(F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y")), F.lit(0.5), F.lit(0.5), F.col("frame_index"))
    return nits(spark, sf_dir).select("frame_index").distinct().withColumn("t", t).select("frame_index", F.round("t.dx_per_frame", 9).alias("dx"), F.round("t.dy_per_frame", 9).alias("dy"))


_BOX_OK = lambda dx, dy: f"ISFINITE({dx}) AND ISFINITE({dy}) AND x + {dx} >= 0 AND 0.2 + {dy} >= 0 AND x + {dx} + 0.25 <= 1 AND 0.2 + {dy} + 0.25 <= 1"


@query(f"""WITH m AS (SELECT event_id, event_id % 3 AS kind, event_id % 11 AS k, CAST(event_id % 40 - 1 AS BIGINT) AS n, value / 1000 AS x, CASE WHEN event_id % 29 = 0 THEN CAST('NaN' AS DOUBLE) ELSE (value % 7 - 3) / 200 END AS dx, (value % 5 - 2) / 400 AS dy FROM events)
  SELECT event_id, CASE WHEN kind <> 2 AND n <= 0 THEN 'region motion frame_count must be greater than zero'
    WHEN kind = 1 AND (ISNAN(dx) OR ISNAN(dy)) THEN 'region motion deltas must be finite'
    WHEN kind = 1 AND NOT ({_BOX_OK("dx * (n - 1)", "dy * (n - 1)")}) THEN 'region motion leaves the frame'
    WHEN kind <> 2 THEN NULL WHEN k = 0 THEN 'piecewise-linear region motion requires at least two keyframes'
    WHEN k <> 1 AND ISNAN(dx) THEN 'piecewise-linear region motion offsets must be finite' WHEN k = 1 THEN 'piecewise-linear region motion must start at frame_delta 0 with zero offset'
    WHEN k = 2 THEN 'piecewise-linear region motion keyframes must be strictly increasing' WHEN NOT ({_BOX_OK("dx * 20", "dy * 20")} AND {_BOX_OK("0.0", "0.0")}) THEN 'region motion leaves the frame' END AS failure FROM m""")
def validate_region_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of every kind of motion, of which some break one rule or several."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value").withColumn("k", F.col("event_id") % 11)
    kind = F.element_at(F.array(*map(F.lit, ("static", "translate", "piecewise_linear"))), (F.col("event_id") % 3 + 1).cast("int"))
    dx, dy = F.when(F.col("event_id") % 29 == 0, float("nan")).otherwise((F.col("value") % 7 - 3) / 200), (F.col("value") % 5 - 2) / 400
    key = lambda at, a, b: F.struct(F.lit(at).cast("long").alias("frame_delta"), a.cast("double").alias("dx"), b.cast("double").alias("dy"))
    start, end, zero = key(0, F.lit(0.0), F.lit(0.0)), key(10, dx * 20, dy * 20), F.lit(0.0)
    keys = F.when(F.col("k") == 0, F.array(start)).when(F.col("k") == 1, F.array(key(0, zero + 0.1, zero), key(9, zero, zero))).when(F.col("k") == 2, F.array(start, end, end)).otherwise(F.array(start, end))
    motion = F.struct(kind.alias("kind"), (F.col("event_id") % 40 - 1).alias("frame_count"), dx.alias("dx_per_frame"), dy.alias("dy_per_frame"), keys.alias("keyframes"))
    region = F.struct((F.col("value") / 1000).alias("x"), F.lit(0.2).alias("y"), F.lit(0.25).alias("width"), F.lit(0.25).alias("height"), motion.alias("motion"))
    return e.withColumn("region", region).select("event_id", validation.first_failure(validation.region_motion(F.col("region"))).alias("failure"))


@query(f"""WITH c AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value % 8 - 4 END AS a, value % 4 - 2 AS e, value % 9 - 0.5 AS w, value % 5 - 0.3 AS h FROM events)
  SELECT event_id, CASE WHEN ISNAN(a) THEN 'spherical region angles must be finite' WHEN ABS(a) > {o.d(math.pi)} THEN 'spherical region centre_azimuth must be in [-pi, pi]'
    WHEN ABS(e) > {o.d(math.pi / 2)} THEN 'spherical region centre_elevation must be in [-pi/2, pi/2]' WHEN w <= 0 OR w > {o.d(2 * math.pi)} THEN 'spherical region angular_width must be in (0, 2*pi]'
    WHEN h <= 0 OR h > {o.d(math.pi)} THEN 'spherical region angular_height must be in (0, pi]' WHEN ABS(e) + h / 2 > {o.d(math.pi / 2 + 1e-4)} THEN 'spherical region latitude extent must stay within [-pi/2, pi/2]' END AS failure FROM c""")
def validate_spherical_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps whose angles come from the events' values and break every rule somewhere."""
    v = F.col("value")
    azimuth = F.when(F.col("event_id") % 50 == 0, float("nan")).otherwise(v % 8 - 4)
    cap = F.struct(azimuth.alias("centre_azimuth"), (v % 4 - 2).alias("centre_elevation"), (v % 9 - 0.5).alias("angular_width"), (v % 5 - 0.3).alias("angular_height"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", cap.alias("cap"))
    return e.select("event_id", validation.first_failure(validation.spherical_region(F.col("cap"))).alias("failure"))


@query(f"SELECT event_id, CASE WHEN value % 13 - 1 < 0 OR value % 13 - 1 > 10 THEN 'speed must be in 0..=10' WHEN event_id % 300 > 255 THEN 'quantizer must be in 0..=255' WHEN event_id % 2 = 0 AND event_id % 300 <> 0 THEN 'lossless requires quantizer 0' END AS failure FROM events")
def validate_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("c", F.struct((F.col("value") % 13 - 1).alias("speed"), (F.col("event_id") % 300).alias("quantizer"), (F.col("event_id") % 2 == 0).alias("lossless")))
    return e.select("event_id", validation.first_failure(validation.encoder_config(F.col("c"))).alias("failure"))


@query("SELECT event_id, REGEXP_FULL_MATCH(id, '[A-Za-z0-9_-]{1,128}') AS id_ok, path NOT LIKE '/%' AND path <> '' AND NOT LIST_CONTAINS(STRING_SPLIT_REGEX(path, '[/\\\\]'), '..') AS path_ok FROM (SELECT event_id, CONCAT('v-', event_id, CASE WHEN event_id % 7 = 0 THEN ' x' ELSE '' END, CASE WHEN event_id % 11 = 0 THEN REPEAT('a', 128) ELSE '_ok' END) AS id, CASE event_id % 5 WHEN 0 THEN '/abs' WHEN 1 THEN 'a/../b' WHEN 2 THEN '' WHEN 3 THEN 'a\\..\\b' ELSE CONCAT('a/', event_id) END AS path FROM events) t")
def vector_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and relative paths of conformance vectors, of which some are not allowed."""
    i = F.col("event_id")
    name = F.concat(F.lit("v-"), i.cast("string"), F.when(i % 7 == 0, " x").otherwise(""), F.when(i % 11 == 0, "a" * 128).otherwise("_ok"))
    path = F.when(i % 5 == 0, "/abs").when(i % 5 == 1, "a/../b").when(i % 5 == 2, "").when(i % 5 == 3, "a\\..\\b").otherwise(F.concat(F.lit("a/"), i.cast("string")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(i, validation.vector_id(name).alias("id_ok"), validation.relative_path(path).alias("path_ok"))


@query("SELECT DISTINCT event_id // 200 AS frame_index, CAST(n AS INTEGER) AS samples, CAST(n * (n + 1) // 2 AS INTEGER) AS n_bytes, CAST((n + 5) // 6 AS INTEGER) AS segments FROM (SELECT event_id, 2 + event_id // 200 % 17 AS n FROM events) e")
def fragment_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of growing sizes as a progressive file and as fragments of six, and their sample tables read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in b.frame_index:
                frames = [(bytes([i]) * (i + 1), i % 6 == 0) for i in range(2 + f % 17)]
                whole = bitstream.write_mp4(frames, 16, 16, 3750)
                parts = bitstream.write_fragments([frames[i : i + 6] for i in range(0, len(frames), 6)], 16, 16, 3750)
                data = b"".join(parts)
                if not [whole[a : a + n] for a, n in bitstream.mp4_samples(whole)] == [data[a : a + n] for a, n in bitstream.mp4_samples(data)] == [f for f, _ in frames]:
                    raise bitstream.BitstreamError("samples differ")
                n = bitstream.mp4_samples(data)
                yield pd.DataFrame({"frame_index": [f], "samples": len(n), "n_bytes": sum(x for _, x in n), "segments": len(parts) - 1})

    return nits(spark, sf_dir).select("frame_index").distinct().mapInPandas(run, "frame_index long, samples int, n_bytes int, segments int")


# ---- single precision, ACES matrices, table lookup -----------------------------------------------------------


@query(f"SELECT event_id, ROUND(CAST(CAST({o.pq('CAST(CAST(value / 500 AS FLOAT) AS DOUBLE)')} AS FLOAT) AS DOUBLE), 6) AS signal, ROUND(CAST(CAST({o.light('CAST(CAST(value / 500 AS FLOAT) AS DOUBLE)')} AS FLOAT) AS DOUBLE), 6) AS linear FROM events")
def pq_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") / 500
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(transfer.pq_encode_single(v).cast("double"), 6).alias("signal"), F.round(transfer.pq_decode_single(v).cast("double"), 6).alias("linear"))


_ACES = ((("to_ap1", aces.REC2020_TO_AP1), ("from_ap0", aces.AP0_TO_REC2020), ("from_ap1", aces.AP1_TO_REC2020)))


@query(f"{o.WITH} SELECT {o.KEY}, " + ", ".join(o.r9(o.row(m, i), f"{name}_{c}") for name, m in _ACES for i, c in enumerate("rgb")) + " FROM p")
def aces_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = {}
    for name, of in (("to_ap1", aces.rec2020_to_ap1), ("from_ap0", aces.ap0_to_rec2020), ("from_ap1", aces.ap1_to_rec2020)):
        out |= {f"{name}_{c}": x for c, x in zip("rgb", of(rgb()), strict=True)}
    return rounded(nits(spark, sf_dir).withColumns(out), *out)


@query(f"{o.WITHS}, l AS (SELECT {o.KEY}, {', '.join(f'{o.light(c)} * 10000 AS {c}' for c in 'rgb')} FROM s) SELECT {o.KEY}, " + ", ".join(o.r9(f"{o.row(aces.REC2020_TO_AP0, i)} / 203", c, 6) for i, c in enumerate("rgb")) + " FROM l")
def aces_from_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivery signal in AP0: PQ to nits, then as for a master."""
    return rounded(aces.render(aces.delivery_nits(signal(spark, sf_dir)), "ap0"), "r", "g", "b", places=6)


@query(f"WITH t AS (SELECT LIST({o.hermite_curve('CAST(i AS DOUBLE) / 63', DEFAULT_ANCHORS, Curve().tangents())} ORDER BY i) AS t FROM RANGE(64) t(i)), x AS (SELECT event_id, {o.clamp('value / 400')} * 63 AS x FROM events), k AS (SELECT event_id, x, LEAST(CAST(FLOOR(x) AS BIGINT), 62) AS k FROM x) SELECT event_id, ROUND(t[k + 1] + (x - k) * (t[k + 2] - t[k + 1]), 9) AS mapped FROM k, t")
def curve_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve by linear interpolation in its table of 64 entries."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(table_lookup(F.col("value") / 400, Curve().table(64)), 9).alias("mapped"))
