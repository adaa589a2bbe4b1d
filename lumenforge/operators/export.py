"""Metadata exports: HDR10+ style entries, loss reports, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.functions.num import clamp, finite

# Positions of the distribution samples, full scales of 16-bit slots, capability and report texts.
PCT10 = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.98, 0.99)
PCT15 = (0.01, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99)
CEILING_NITS, BOOST_FULL_SCALE, DELTA_FULL_SCALE, NEUTRAL_GAIN = 10_000.0, 4.0, 0.25, 32_768
CERTIFICATION = ("licensed HDR10+ profile conformance suite", "vendor-issued profile certificates and signing chain", "proprietary packaging and compliance workflow")
HDR10_APPROXIMATED = (
    "tone_map_curve -> static transfer with quantized 10-bit encoding",
    "scene_peak_luminance_nits -> maxcll integer rounding",
    "scene_average_luminance_nits -> maxfall integer rounding",
)
HDR10_DROPPED_V2 = ("open_dynamic_v2.local_tone_map_grid", "open_dynamic_v2.object_constraints", "open_dynamic_v2.temporal", "open_dynamic_v2.ambient_policy")
SIDECAR_NOTES = ("Open DV-compatible sidecar only; proprietary RPU bitstream generation unavailable", "Use this payload as an intermediate for downstream proprietary packaging")

SIDECAR_DROPPED = ("proprietary_dolby_rpu_extension_blocks", "vendor-specific profile negotiation")
SIDECAR_APPROXIMATED = ("tone_map_curve anchors mapped into open sidecar schema", "scene luminance mapped to target_max_linear_fraction")
SIDECAR_UNSUPPORTED = ("generation of certified Dolby Vision bitstream", "private metadata carriage and vendor keys")
PACKER_CAPABILITIES = ("certified Dolby Vision bitstream packer", "vendor signing keys and profile certificates", "licensed proprietary RPU block serializer")
#: The schema's name is our own; other families of tools have theirs.
SIDECAR_SCHEMA = "lumenforge.dv-compatible.sidecar.v1"


def scale_bits(nits: Column, bits: int) -> Column:
    """A luminance as a fraction of 10,000 nits in ``bits`` bits, saturating."""
    return F.floor(clamp(nits / CEILING_NITS) * float((1 << bits) - 1) + 0.5).cast("int")


def saturates(nits: Column) -> Column:
    return ~finite(nits) | (nits < 0) | (nits > CEILING_NITS)


def unit16(v: Column) -> Column:
    return F.floor(clamp(v) * 65_535.0 + 0.5).cast("int")


def _interior(anchors: Column) -> Column:
    return F.filter(anchors, lambda a: (a["input"] > 0) & (a["input"] < 1))


def _code(v: Column, bits: int) -> Column:
    return F.floor(clamp(v) * float((1 << bits) - 1) + 0.5).cast("int")


def distribution(peak: Column, positions: tuple[float, ...], bits: int) -> Column:
    """Fixed fractions of the peak: what the format carries as its distribution."""
    return F.array(*(scale_bits(peak * p, bits) for p in positions))


def _entry(m: Column, bits: int, suffix: str = "") -> list[Column]:
    peak, inner = m["scene_peak_luminance_nits"], _interior(m["tone_map_curve"]["anchors"])
    first = F.get(inner, F.lit(0))
    top = scale_bits(peak, bits)
    return [
        scale_bits(m["scene_average_luminance_nits"], bits).alias(f"average_maxrgb{suffix}"), F.array(top, top, top).alias(f"maxscl{suffix}"),
        distribution(peak, PCT10 if bits == 10 else PCT15, bits).alias(f"distribution_values{suffix}"),
        F.transform(inner, lambda a: _code(a["output"], bits)).alias(f"bezier_curve_anchors{suffix}"),
        F.coalesce(_code(first["input"], bits), F.lit(0)).alias(f"knee_point_x{suffix}"), F.coalesce(_code(first["output"], bits), F.lit(0)).alias(f"knee_point_y{suffix}"),
    ]


def basic_entry(m: Column) -> Column:
    peak = m["scene_peak_luminance_nits"]
    whole = F.when(finite(peak), F.floor(F.greatest(peak, F.lit(0.0)) + 0.5)).otherwise(0).cast("long")
    return F.struct(m["frame_index"].alias("frame_index"), whole.alias("targeted_system_display_maximum_luminance"), *_entry(m, 10))


def advanced_entry(m: Column) -> Column:
    b = basic_entry(m)
    names = ["frame_index", "targeted_system_display_maximum_luminance", "average_maxrgb", "maxscl", "distribution_values", "bezier_curve_anchors", "knee_point_x", "knee_point_y"]
    return F.struct(*(b[n].alias(n) for n in names), *_entry(m, 16, "_16bit"), F.lit(NEUTRAL_GAIN).alias("colour_saturation_gain"))


def boost_at(policy: Column, lux: Column) -> Column:
    """A row's own ambient policy at a lux value: piecewise linear, constant beyond its ends."""
    x, y = policy["lux_breakpoints"], policy["boost_multipliers"]
    n = F.size(x)
    i = F.size(F.filter(x, lambda v: v < lux))
    x0, x1, y0, y1 = F.get(x, i - 1), F.get(x, i), F.get(y, i - 1), F.get(y, i)
    inner = y0 + (y1 - y0) * (lux - x0) / F.greatest(x1 - x0, F.lit(1e-9))
    return F.when((n == 0) | (n != F.size(y)), F.lit(1.0)).when(i == 0, F.get(y, F.lit(0))).when(i >= n, F.element_at(y, -1)).otherwise(inner)


def adaptive_entry(m: Column) -> Column:
    p = m["open_dynamic_v2"]["ambient_policy"]
    n = F.size(p["lux_breakpoints"])
    lux = F.when(p.isNull() | (n <= 0), F.lit(0.0)).otherwise(F.greatest(F.get(p["lux_breakpoints"], F.floor(n / 2).cast("int")), F.lit(0.0)))
    boost = F.when(p.isNull(), F.lit(1.0)).otherwise(boost_at(p, lux))
    rate = F.coalesce(p["max_delta_per_second"], F.lit(0.0))
    return F.struct(advanced_entry(m).alias("base"), lux.alias("ambient_lux"), boost.alias("ambient_boost_multiplier"), unit16(boost / BOOST_FULL_SCALE).alias("ambient_boost_multiplier_16bit"), unit16(rate / BOOST_FULL_SCALE).alias("adaptation_max_delta_per_second_16bit"))


def gaming_entry(m: Column) -> Column:
    v2 = m["open_dynamic_v2"]
    g, t = v2["gaming_profile"], v2["temporal"]
    pick = lambda a, b, d: F.when(v2.isNull(), F.lit(d)).when(g.isNotNull(), a).otherwise(F.coalesce(b, F.lit(d)))
    budget = pick(g["frame_time_budget_ms"], t["frame_time_budget_ms"], 8.3)
    strength = pick(g["anti_pumping_strength"], t["anti_pumping_strength"], 0.8)
    delta = pick(g["max_gain_delta_per_frame"], t["max_global_gain_delta_per_frame"], 0.05)
    return F.struct(advanced_entry(m).alias("base"), budget.alias("frame_time_budget_ms"), unit16(strength).alias("anti_pumping_strength_16bit"), unit16(delta / DELTA_FULL_SCALE).alias("max_gain_delta_per_frame_16bit"))


ENTRIES = {"basic": basic_entry, "advanced": advanced_entry, "adaptive": adaptive_entry, "gaming": gaming_entry}


def profile_export(frames: DataFrame, mode: str, meta: str = "dynamic_meta") -> DataFrame:
    """One row a frame: the entry of a profile with its tag. No certification is ever claimed."""
    return frames.select(*(c for c in frames.columns if c != meta), F.lit(mode).alias("profile"), F.lit("not_certified").alias("certification_status"), F.array(*map(F.lit, CERTIFICATION)).alias("missing_capabilities"), ENTRIES[mode](F.col(meta)).alias("entry"))


def hdr10_loss(v2: Column) -> Column:
    """What HDR10 drops, approximates and cannot carry of a frame's metadata."""
    has = v2.isNotNull()
    texts = lambda items: F.array(*map(F.lit, items)).cast("array<string>")
    more = lambda items: F.when(has, texts(items)).otherwise(texts(()))
    return F.struct(
        F.lit("hdr10").alias("target"), F.concat(texts(("target_display_hint.min_luminance_nits",)), more(HDR10_DROPPED_V2)).alias("dropped_fields"),
        F.concat(texts(HDR10_APPROXIMATED), more(("open_dynamic_v2.adaptation_layer -> static mastering display assumption",))).alias("approximated_fields"),
        more(("open_dynamic_v2 inverse reconstruction hints",)).alias("unsupported_features"),
    )


def open_sidecar(m: Column) -> Column:
    return F.struct(
        m["frame_index"].alias("frame_index"), clamp(m["scene_peak_luminance_nits"] / CEILING_NITS).alias("target_max_linear_fraction"),
        m["tone_map_curve"]["anchors"].alias("curve_anchors"), F.lit(False).alias("proprietary_bitstream_generated"), F.array(*map(F.lit, SIDECAR_NOTES)).alias("notes"), packaging().alias("compatibility"),
    )


def packaging(packaged: Column | bool = False) -> Column:
    """Compatibility metadata of a sidecar: an open one alone, or one that a vendor's packer has made into a bitstream."""
    done = packaged if isinstance(packaged, Column) else F.lit(packaged)
    missing = F.when(done, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, PACKER_CAPABILITIES)))
    return F.struct(
        F.when(done, "proprietary_adapter_packaged").otherwise("open_sidecar_only").alias("mode"), F.lit(SIDECAR_SCHEMA).alias("sidecar_schema"), F.lit(True).alias("requires_proprietary_packer"),
        done.alias("proprietary_packer_available"), done.alias("certified_output_generated"), missing.alias("missing_capabilities"),
    )


def sidecar_loss() -> Column:
    """What an open sidecar drops, approximates and cannot carry, whatever the frame."""
    texts = lambda items: F.array(*map(F.lit, items)).cast("array<string>")
    return F.struct(F.lit("dolby_vision_compatible").alias("target"), texts(SIDECAR_DROPPED).alias("dropped_fields"), texts(SIDECAR_APPROXIMATED).alias("approximated_fields"), texts(SIDECAR_UNSUPPORTED).alias("unsupported_features"))


def adapter_command(template: str, sidecar: str, rpu: str, report: str) -> list[str]:
    """A packer's command with the paths in its placeholders, as a list of arguments; no shell ever sees it."""
    import shlex

    for label, path in (("sidecar", sidecar), ("rpu", rpu), ("report", report)):
        if "\0" in path:
            raise ValueError(f"{label} path contains a NUL byte")
    try:
        parts = shlex.split(template)
    except ValueError as e:
        raise ValueError(f"malformed adapter command: {e}") from e
    for name, path in (("{sidecar}", sidecar), ("{rpu}", rpu), ("{report}", report)):
        parts = [p.replace(name, path) for p in parts]
    return parts


def run_adapter(template: str | None, sidecar: str, rpu: str, report: str, timeout: float = 600.0) -> dict:
    """Best effort: whether a packer was configured, found, run and made its output, and the first error."""
    import os
    import shutil
    import subprocess

    status = {"configured_command": None, "command_detected": False, "invocation_attempted": False, "invocation_succeeded": False, "rpu_output_path": None, "missing_capabilities": list(PACKER_CAPABILITIES), "error": None}
    if not template or not template.strip():
        return status | {"error": "no adapter command configured; only the open sidecar was made"}
    status["configured_command"] = template.strip()
    try:
        parts = adapter_command(template.strip(), sidecar, rpu, report)
    except ValueError as e:
        return status | {"error": str(e)}
    if not parts or not shutil.which(parts[0]):
        return status | {"error": "adapter command not found"}
    status |= {"command_detected": True, "invocation_attempted": True}
    try:
        done = subprocess.run(parts, capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        return status | {"error": str(e)}
    if done.returncode:
        return status | {"error": f"adapter command failed with {done.returncode}: {done.stderr.decode(errors='replace')[:500]}"}
    if not os.path.exists(rpu) or not os.path.getsize(rpu):
        return status | {"error": "adapter command made no output"}
    return status | {"invocation_succeeded": True, "rpu_output_path": rpu, "missing_capabilities": []}


def merge_reports(reports: DataFrame, by: list[str], column: str = "report") -> DataFrame:
    """Sorted unions of each list over all frames. Texts are distinct before they meet: a handful a group."""
    out = None
    for name in ("dropped_fields", "approximated_fields", "unsupported_features"):
        one = reports.select(*by, F.explode_outer(f"{column}.{name}").alias("x")).groupBy(*by).agg(F.array_sort(F.collect_set("x")).alias(name))
        out = one if out is None else out.join(one, by)
    return out


def parse_keyframe(text: Column) -> Column:
    """``frame:dx:dy`` as a struct; null if it has another shape."""
    parts = F.split(text, ":")
    key = F.struct(F.get(parts, F.lit(0)).try_cast("long").alias("frame_delta"), F.get(parts, F.lit(1)).try_cast("double").alias("dx"), F.get(parts, F.lit(2)).try_cast("double").alias("dy"))
    return F.when((F.size(parts) == 3) & key["frame_delta"].isNotNull() & key["dx"].isNotNull() & key["dy"].isNotNull(), key)
