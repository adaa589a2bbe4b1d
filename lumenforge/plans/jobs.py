"""Whole jobs, one function for each command of a video toolchain: they compose operators and return DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.functions import aces, transfer
from lumenforge.functions.curve import DEFAULT_ANCHORS, Curve
from lumenforge.operators import export, fidelity, integrity, pixels, tonemap
from lumenforge.plans.frames import conformance_pattern, grey_ramp
from lumenforge.sources import bitstream, container


def static_metadata(tier: str = "delivery", schema: int = 2) -> dict:
    """The default metadata of a stream."""
    point = lambda x, y: {"x": x, "y": y}
    return {
        "format_version": "1.0", "metadata_schema_version": schema, "tier": tier, "precision": "float32" if tier == "delivery" else "float64",
        "colour_standard": "rec2100", "colour_primaries": "rec2020", "transfer_function": "st2084_pq" if tier == "delivery" else "linear",
        "dynamic_metadata_standard": "st2094", "chroma_subsampling": "4:4:4",
        "mastering_display": {"red_primary": point(0.708, 0.292), "green_primary": point(0.170, 0.797), "blue_primary": point(0.131, 0.046), "white_point": point(0.3127, 0.3290), "min_luminance_nits": 0.0001, "max_luminance_nits": 10_000.0},
        "content_light_level": {"max_cll_nits": 1000.0, "max_fall_nits": 400.0}, "compatibility_tags": ["hdr10"],
    }


def dynamic_metadata(frame: int = 0, peak: float = 1000.0, average: float = 200.0, v2: bool = False) -> dict:
    """The default metadata of a frame; ``v2`` adds the default open policies."""
    meta = {
        "metadata_schema_version": 2 if v2 else 1, "frame_index": frame, "scene_peak_luminance_nits": peak, "scene_average_luminance_nits": average,
        "tone_map_curve": {"type": "bezier", "anchors": [{"input": a, "output": b} for a, b in DEFAULT_ANCHORS]},
        "target_display_hint": {"min_luminance_nits": 0.0005, "max_luminance_nits": 1000.0}, "creator_intent_locked": False,
    }
    if v2:
        meta["open_dynamic_v2"] = {
            "temporal": {"max_global_gain_delta_per_frame": 0.08, "anti_pumping_strength": 0.7},
            "local_tone_map_grid": {"cols": 4, "rows": 4, "cells": [{"gain": 1.0, "offset": 0.0}] * 16},
            "adaptation_layer": {"source_mastering_peak_nits": 1000.0, "abstract_display_peak_nits": 800.0, "display_model": "oled", "highlight_rolloff_strength": 0.5, "shadow_lift_strength": 0.2},
            "gaming_profile": {"frame_time_budget_ms": 8.3, "anti_pumping_strength": 0.8, "max_gain_delta_per_frame": 0.05},
        }
    return meta


def info(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """One row a stream: header, tier and number of frames found."""
    spark.dataSource.register(container.ContainerSource)
    frames = spark.read.format("frames").options(path=path, **options).load()
    return frames.groupBy("path", "version", "tier", "codec", "width", "height", "frame_count").agg(F.count(F.lit(1)).alias("frames_read"))


def pq(spark: SparkSession, nits: list[float]) -> DataFrame:
    """Luminances and their PQ signal (null outside the range)."""
    return spark.createDataFrame([(float(n),) for n in nits], "nits double").withColumn("signal", transfer.nits_to_pq("nits"))


def write_test(spark: SparkSession, tier: str = "mastering", width: int = 16, height: int = 4, frames: int = 1) -> DataFrame:
    """Frames of a test stream: nits for mastering, a PQ signal for delivery."""
    ramp = grey_ramp(spark, width, height, frames)
    return ramp if tier == "mastering" else convert(ramp)


def convert(nits: DataFrame, deterministic: bool = True) -> DataFrame:
    """Mastering to delivery."""
    return pixels.transcode(nits, deterministic)


def inspect(signal: DataFrame, curve: Curve = Curve(), target: tonemap.Target = tonemap.Target()) -> DataFrame:  # noqa: B008
    """Each frame's mean signal before and after tone mapping."""
    after = pixels.mean_signal(tonemap.tone_map(signal, curve, target=target)).withColumnRenamed("mean_signal", "mean_after")
    return pixels.mean_signal(signal).withColumnRenamed("mean_signal", "mean_before").join(after, "frame_index")


def hdr10plus(frames: DataFrame, mode: str = "basic") -> DataFrame:
    """One JSON text a frame of a profile."""
    e = export.profile_export(frames, mode)
    return e.select("frame_index", F.to_json(F.struct("profile", "certification_status", "missing_capabilities", "entry")).alias("json"))


def interop_bundle(frames: DataFrame, signal: DataFrame) -> dict[str, DataFrame]:
    """The artefacts of an export: 10-bit pixels, profile entries, sidecars, and a loss report for each target."""
    meta = F.col("dynamic_meta")
    losses = frames.select(F.lit("hdr10").alias("target"), export.hdr10_loss(meta["open_dynamic_v2"]).alias("report"))
    return {
        "hdr10": pixels.hdr10_codes(signal), "hdr10plus": hdr10plus(frames, "advanced"), "sidecar": frames.select(export.open_sidecar(meta).alias("sidecar")),
        "loss": export.merge_reports(losses, ["target"]), "frame_loss": losses,
    }


def write_bundle(bundle: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Writes each artefact of `interop_bundle` as JSON lines (pixels as Parquet) in a folder of its own; gives the folders."""
    out = {}
    for name, df in bundle.items():
        out[name] = f"{folder}/{name}"
        (df.write.mode("overwrite").parquet if name == "hdr10" else df.write.mode("overwrite").json)(out[name])
    return out


def packed_sidecars(spark: SparkSession, sidecars: DataFrame, folder: str, command: str | None) -> DataFrame:
    """The sidecars of a stream as one file for a vendor's packer, its run and what it made: one row of the adapter's status.

    The packer is an outside program that takes one file of a stream, a line a frame; the driver runs it. Without a
    command, or where it fails, the open sidecar stands alone."""
    path = f"{folder}/sidecar.jsonl"
    with open(path, "w", encoding="utf-8") as f:
        for r in sidecars.select(F.to_json("sidecar").alias("j"), F.col("sidecar.frame_index").alias("i")).orderBy("i").toLocalIterator():
            f.write(r.j + "\n")
    status = export.run_adapter(command, path, f"{folder}/rpu.bin", f"{folder}/report.json")
    schema = "configured_command string, command_detected boolean, invocation_attempted boolean, invocation_succeeded boolean, rpu_output_path string, missing_capabilities array<string>, error string"
    row = spark.createDataFrame([tuple(status.values())], schema)
    return row.withColumn("compatibility", export.packaging(F.col("invocation_succeeded")))


def aces_export(nits: DataFrame, target: str = "ap0", reference_white: float = 203.0) -> DataFrame:
    return aces.render(nits, target, reference_white)


def sign_manifests(payloads: DataFrame, signer: str, key: bytes) -> DataFrame:
    return integrity.sign(payloads, signer, key)


def verify_manifests(manifests: DataFrame, key: bytes) -> DataFrame:
    return integrity.verify(manifests, key)


def probe(spark: SparkSession, path: str) -> DataFrame:
    """User metadata of all bitstreams in a folder."""
    return bitstream.probe(spark.read.format("binaryFile").load(path))


def conformance_generate(spark: SparkSession, vectors: int = 3, width: int = 64, height: int = 64) -> DataFrame:
    """Mastering patterns of a corpus; ``frame_index`` is the vector's seed."""
    out = None
    for seed in range(vectors):
        one = conformance_pattern(spark, seed, width, height).withColumn("frame_index", F.lit(seed).cast("long"))
        out = one if out is None else out.union(one)
    return out


def conformance_run(nits: DataFrame, limits: dict[str, float | None] = fidelity.CONTRACT) -> DataFrame:
    """Each vector through the 12-bit codec step, its metrics and its failures against a contract."""
    signal = convert(nits)
    m = fidelity.frame_metrics(fidelity.derived(signal, pixels.ycbcr12_round_trip)).withColumn("vmaf_hdr", fidelity.vmaf_surrogate())
    failures = fidelity.contract_failures(limits)
    return m.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def object_motion(kind: str, box: tuple[float, float, float, float], frames: int, to: tuple[float, float] | None = None, delta: tuple[float, float] = (0.0, 0.0), keyframes: tuple[tuple[int, float, float], ...] = ()) -> str:
    """JSON of a moving region: still, by deltas or to a place, or along keyframes."""
    if kind == "translate" and to is not None:
        if frames < 2 or delta != (0.0, 0.0):
            raise ValueError("a place needs at least two frames and no deltas")
        delta = ((to[0] - box[0]) / (frames - 1), (to[1] - box[1]) / (frames - 1))
    motion: dict = {"kind": kind}
    if kind == "piecewise_linear":
        motion["keyframes"] = [dict(zip(("frame_delta", "dx", "dy"), k, strict=True)) for k in keyframes]
    else:
        motion["frame_count"] = frames
        if kind == "translate":
            motion |= {"dx_per_frame": delta[0], "dy_per_frame": delta[1]}
    return json.dumps({"bounding_box": dict(zip(("x", "y", "width", "height"), box, strict=True)), "motion": motion})
