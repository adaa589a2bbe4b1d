"""Fidelity of a candidate against a reference frame, and contracts on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.functions import color
from lumenforge.functions.num import clamp
from lumenforge.functions.transfer import pq_decode
from lumenforge.operators.pixels import rgb

# SSIM constants, and the contract that delivery must meet.
SSIM_C1, SSIM_C2 = 1e-4, 9e-4
CONTRACT = {"psnr_db": 35.0, "ssim": 0.90, "delta_e": 4.5, "vmaf_hdr": 85.0}


def paired(reference: DataFrame, candidate: DataFrame, by: str = "frame_index") -> DataFrame:
    """Pixels of both signals side by side; both sides shuffle once on (frame, pixel)."""
    side = lambda df, p: df.select(by, "pixel_idx", *(F.col(c).alias(f"{p}{c}") for c in "rgb"))
    return side(reference, "a_").join(side(candidate, "b_"), [by, "pixel_idx"])


def derived(reference: DataFrame, step, by: str = "frame_index") -> DataFrame:
    """The same for a candidate that ``step`` makes of the reference's own rows (a function from a frame to one with r, g, b in
    place): both stay side by side from the start, and nothing is shuffled or joined."""
    kept = step(reference.withColumns({f"a_{c}": F.col(c) for c in "rgb"}))
    return kept.select(by, "pixel_idx", *(f"a_{c}" for c in "rgb"), *(F.col(c).alias(f"b_{c}") for c in "rgb"))


def frame_metrics(pairs: DataFrame, by: str = "frame_index") -> DataFrame:
    """PSNR and global SSIM of clamped PQ luma, and mean CIE 1976 difference of linear light, in one pass.

    Identical frames have an infinite PSNR, an SSIM of 1 and no difference.
    """
    lit = pairs.withColumns({"_x": clamp(color.luma(rgb("a_"))), "_y": clamp(color.luma(rgb("b_")))})
    lit = lit.withColumns({f"{p}{c}": pq_decode(f"{p}{c}") for p in ("a_", "b_") for c in "rgb"})
    lit = lit.withColumns({f"_{p}{n}": v for p in ("a_", "b_") for n, v in zip("lab", color.lab(rgb(p)), strict=True)})
    e = F.sqrt(sum(((F.col(f"_a_{n}") - F.col(f"_b_{n}")) * (F.col(f"_a_{n}") - F.col(f"_b_{n}")) for n in "lab"), F.lit(0.0)))
    d = F.col("_x") - F.col("_y")
    sums = lit.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.avg(d * d).alias("_mse"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"),
        F.coalesce(F.var_samp("_x"), F.lit(0.0)).alias("_vx"), F.coalesce(F.var_samp("_y"), F.lit(0.0)).alias("_vy"),
        F.coalesce(F.covar_samp("_x", "_y"), F.lit(0.0)).alias("_c"), F.avg(e).alias("delta_e"),
    )
    mx, my = F.col("_mx"), F.col("_my")
    ssim = ((2 * mx * my + SSIM_C1) * (2 * F.col("_c") + SSIM_C2)) / ((mx * mx + my * my + SSIM_C1) * (F.col("_vx") + F.col("_vy") + SSIM_C2))
    psnr = F.when(F.col("_mse") <= 2.220446049250313e-16, F.lit(float("inf"))).otherwise(10 * F.log10(1 / F.col("_mse")))
    return sums.select(by, "n_pixels", psnr.alias("psnr_db"), clamp(ssim).alias("ssim"), "delta_e")


def vmaf_surrogate(psnr: Column | str = "psnr_db", ssim: Column | str = "ssim", delta_e: Column | str = "delta_e") -> Column:
    """A deterministic stand-in for a perceptual score, 0 to 100."""
    # The weights, ranges and slopes.
    p, s, d = (F.col(x) if isinstance(x, str) else x for x in (psnr, ssim, delta_e))
    return 0.45 * clamp((p - 20) / 30 * 100, 0.0, 100.0) + 0.40 * clamp(s * 100, 0.0, 100.0) + 0.15 * clamp(100 - d * 6, 0.0, 100.0)


def contract_failures(limits: dict[str, float | None] = CONTRACT) -> Column:
    """All failures of the metrics psnr_db, ssim, delta_e and vmaf_hdr, in that order; a missing metric fails."""
    # The texts.
    text = {
        "psnr_db": ("PSNR regression: measured %.4f dB below required %.4f dB", "PSNR threshold configured but metric unavailable"),
        "ssim": ("SSIM regression: measured %.6f below required %.6f", "SSIM threshold configured but metric unavailable"),
        "delta_e": ("DeltaE regression: measured %.6f above allowed %.6f", "DeltaE threshold configured but metric unavailable"),
        "vmaf_hdr": ("VMAF-HDR regression: measured %.4f below required %.4f", "VMAF-HDR threshold configured but no in-repo evaluator is available"),
    }
    found = []
    for name, (worse, missing) in text.items():
        if (limit := limits.get(name)) is not None:
            m = F.col(name)
            bad = (m > limit) if name == "delta_e" else (m < limit)
            found.append(F.when(m.isNull() | F.isnan(m), F.lit(missing)).when(bad, F.format_string(worse, m, F.lit(float(limit)))))
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def conformance_report(results: DataFrame) -> DataFrame:
    """Counts of vectors that pass and fail, from a boolean column ``passed``."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))


def parse_score(text: Column) -> Column:
    """A score of 0 to 100 in a tool's output: after the last 'vmaf score', else the last 'vmaf', else a bare number."""
    number = r"\s*[:=]?\s*(-?[0-9]+(?:\.[0-9]+)?)"
    low = F.lower(text)
    after = lambda word: F.nullif(F.regexp_extract(low, f"(?s).*{word}{number}", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(F.trim(text), r"^(-?[0-9]+(?:\.[0-9]+)?)$", 1), F.lit(""))
    v = F.coalesce(after("vmaf score"), after("vmaf"), bare).cast("double")
    return F.when((v >= 0) & (v <= 100), v)


def parse_json_score(text: Column) -> Column:
    """A pooled score in a JSON report."""
    paths = ("$.pooled_metrics.vmaf.mean", "$.aggregate.VMAF_score", "$.vmaf")
    v = F.coalesce(*(F.get_json_object(text, p) for p in paths)).try_cast("double")
    return F.when((v >= 0) & (v <= 100), v)
