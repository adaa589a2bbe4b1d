"""Validators: each gives the first rule that a row's metadata breaks, or null. Rules are tables of (condition, message)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenforge.functions.num import finite

# The messages of all rules below are what callers match on.
Rules = list[tuple[Column, str]]
DYNAMIC = """struct<metadata_schema_version:int,frame_index:bigint,scene_peak_luminance_nits:double,scene_average_luminance_nits:double,
tone_map_curve:struct<type:string,anchors:array<struct<input:double,output:double>>>,
target_display_hint:struct<min_luminance_nits:double,max_luminance_nits:double>,
open_dynamic_v2:struct<scene_constraints:array<struct<scene_id:string,start_frame:bigint,end_frame:bigint,max_highlight_compression_gain:double>>,
object_constraints:array<struct<object_id:bigint,region:struct<x:double,y:double,width:double,height:double>,max_luminance_delta_per_frame:double>>,
temporal:struct<max_global_gain_delta_per_frame:double,anti_pumping_strength:double,frame_time_budget_ms:double,integration_window_frames:int>,
local_tone_map_grid:struct<cols:int,rows:int,cells:array<struct<gain:double,offset:double>>>,
adaptation_layer:struct<source_mastering_peak_nits:double,abstract_display_peak_nits:double,display_model:string,highlight_rolloff_strength:double,shadow_lift_strength:double>,
ambient_policy:struct<lux_breakpoints:array<double>,boost_multipliers:array<double>,max_delta_per_second:double>,
gaming_profile:struct<frame_time_budget_ms:double,anti_pumping_strength:double,max_gain_delta_per_frame:double>,
inverse_tone_mapping_hint:struct<highlight_recovery_strength:double,midtone_contrast_boost:double,saturation_compensation:double>>,
inverse_tone_mapping_hint:struct<highlight_recovery_strength:double,midtone_contrast_boost:double,saturation_compensation:double>,
creator_intent_locked:boolean>""".replace("\n", "")


def first_failure(rules: Rules) -> Column:
    return F.coalesce(*(F.when(bad, F.lit(message)) for bad, message in rules))


def _unit(v: Column) -> Column:
    return finite(v) & (v >= 0) & (v <= 1)


def _any(values: Column, bad) -> Column:
    return F.coalesce(F.exists(values, bad), F.lit(False))


def _increasing(values: Column) -> Column:
    n = F.size(values)
    return F.forall(F.zip_with(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.slice(values, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b > a), lambda x: x)


def anchors(a: Column, endpoints: bool = True) -> Rules:
    inputs = F.transform(a, lambda p: p["input"])
    ends = [((F.get(inputs, F.lit(0)) != 0) | (F.element_at(inputs, -1) != 1), "tone map curve must span inputs 0 to 1")] if endpoints else []
    return [
        ((F.size(a) < 2) | (F.size(a) > 32), "tone map curve needs 2 to 32 anchors"),
        (_any(a, lambda p: ~finite(p["input"]) | ~finite(p["output"])), "tone map anchors must be finite"),
        (_any(a, lambda p: ~_unit(p["input"]) | ~_unit(p["output"])), "tone map anchors must be in [0, 1]"),
        *ends, (~_increasing(inputs), "tone map anchor inputs must be strictly increasing"),
    ]


def box(b: Column) -> Rules:
    sides = [b[c] for c in ("x", "y", "width", "height")]
    bad = sides[0].isNull()
    for s in sides:
        bad = bad | ~finite(s)
    return [
        (bad, "bounding box values must be finite"),
        ((b["x"] < 0) | (b["y"] < 0) | (b["width"] <= 0) | (b["height"] <= 0), "bounding box must have a positive size within the frame"),
        ((b["x"] + b["width"] > 1) | (b["y"] + b["height"] > 1), "bounding box must stay within the frame"),
    ]


def _hint(h: Column, message: str) -> Rules:
    bad = F.lit(False)
    for c in ("highlight_recovery_strength", "midtone_contrast_boost", "saturation_compensation"):
        bad = bad | ~_unit(h[c])
    return [(h.isNotNull() & bad, message)]


def ambient(p: Column) -> Rules:
    lux, boost = p["lux_breakpoints"], p["boost_multipliers"]
    rules = [
        ((F.size(lux) == 0) | (F.size(boost) == 0), "ambient policy requires at least one breakpoint and boost"),
        (F.size(lux) != F.size(boost), "ambient policy breakpoint/boost length mismatch"),
        (~_increasing(lux), "ambient policy lux breakpoints must be strictly increasing"),
        (_any(lux, lambda v: ~finite(v) | (v < 0)), "ambient policy lux breakpoints must be finite and non-negative"),
        (_any(boost, lambda v: ~finite(v) | (v <= 0)), "ambient policy boost multipliers must be finite and > 0"),
        (~finite(p["max_delta_per_second"]) | (p["max_delta_per_second"] <= 0), "ambient policy max_delta_per_second must be finite and > 0"),
    ]
    return [(p.isNotNull() & bad, m) for bad, m in rules]


def grid(g: Column) -> Rules:
    rules = [
        ((g["cols"] <= 0) | (g["rows"] <= 0), "local tone map grid dimensions must be non-zero"),
        (F.size(g["cells"]) != g["cols"] * g["rows"], "local tone map grid cell count mismatch"),
        (_any(g["cells"], lambda c: ~finite(c["gain"]) | ~finite(c["offset"])), "local tone map grid cells must be finite"),
    ]
    return [(g.isNotNull() & bad, m) for bad, m in rules]


def open_dynamic_v2(v: Column) -> Rules:
    t, scenes, objects, layer, game = (v[c] for c in ("temporal", "scene_constraints", "object_constraints", "adaptation_layer", "gaming_profile"))
    ids = F.transform(scenes, lambda s: s["scene_id"])
    numbers = F.transform(objects, lambda o: o["object_id"])
    rules = [
        (~finite(t["max_global_gain_delta_per_frame"]) | (t["max_global_gain_delta_per_frame"] < 0), "temporal max_global_gain_delta_per_frame must be finite and >= 0"),
        (~_unit(t["anti_pumping_strength"]), "temporal anti_pumping_strength must be in [0, 1]"),
        (~finite(t["frame_time_budget_ms"]) | (t["frame_time_budget_ms"] <= 0), "temporal frame_time_budget_ms must be finite and > 0"),
        (t["integration_window_frames"] == 0, "temporal integration_window_frames must be > 0"),
        (_any(scenes, lambda s: F.trim(s["scene_id"]) == ""), "scene constraint scene_id must not be empty"),
        (F.size(F.array_distinct(ids)) != F.size(ids), "scene constraint scene_id must be unique"),
        (_any(scenes, lambda s: s["end_frame"] < s["start_frame"]), "scene constraint end_frame must be >= start_frame"),
        (_any(scenes, lambda s: ~finite(s["max_highlight_compression_gain"]) | (s["max_highlight_compression_gain"] <= 0)), "scene max_highlight_compression_gain must be finite and > 0"),
        (F.size(F.array_distinct(numbers)) != F.size(numbers), "object constraint object_id must be unique"),
        (_any(objects, lambda o: ~finite(o["max_luminance_delta_per_frame"]) | (o["max_luminance_delta_per_frame"] < 0)), "object max_luminance_delta_per_frame must be finite and >= 0"),
        (_any(objects, lambda o: first_failure(box(o["region"])).isNotNull()), "object constraint region is invalid"),
        *grid(v["local_tone_map_grid"]),
        (layer.isNotNull() & (~finite(layer["source_mastering_peak_nits"]) | ~finite(layer["abstract_display_peak_nits"]) | (layer["source_mastering_peak_nits"] <= 0) | (layer["abstract_display_peak_nits"] <= 0)), "adaptation layer peaks must be finite and > 0"),
        (layer.isNotNull() & ~_unit(layer["highlight_rolloff_strength"]), "adaptation highlight_rolloff_strength must be in [0,1]"),
        (layer.isNotNull() & ~_unit(layer["shadow_lift_strength"]), "adaptation shadow_lift_strength must be in [0,1]"),
        *ambient(v["ambient_policy"]),
        (game.isNotNull() & (~finite(game["frame_time_budget_ms"]) | (game["frame_time_budget_ms"] <= 0)), "gaming frame_time_budget_ms must be finite and > 0"),
        (game.isNotNull() & ~_unit(game["anti_pumping_strength"]), "gaming anti_pumping_strength must be in [0, 1]"),
        (game.isNotNull() & (~finite(game["max_gain_delta_per_frame"]) | (game["max_gain_delta_per_frame"] < 0)), "gaming max_gain_delta_per_frame must be finite and >= 0"),
        *_hint(v["inverse_tone_mapping_hint"], "inverse tone mapping hint values must be in [0, 1]"),
    ]
    return [(v.isNotNull() & bad, m) for bad, m in rules]


def dynamic_meta(d: Column) -> Rules:
    peak, avg, hint = d["scene_peak_luminance_nits"], d["scene_average_luminance_nits"], d["target_display_hint"]
    return [
        (~d["metadata_schema_version"].isin(1, 2), "metadata_schema_version is unsupported"),
        (~finite(peak) | ~finite(avg), "scene luminance values must be finite"),
        ((peak < 0) | (avg < 0), "scene luminance values must be non-negative"),
        (avg > peak, "scene_average_luminance_nits exceeds scene_peak_luminance_nits"),
        (~finite(hint["min_luminance_nits"]) | ~finite(hint["max_luminance_nits"]), "display hint luminance values must be finite"),
        (hint["min_luminance_nits"] < 0, "display hint min luminance must be non-negative"),
        (hint["max_luminance_nits"] <= hint["min_luminance_nits"], "display hint requires max_luminance_nits > min_luminance_nits"),
        *anchors(d["tone_map_curve"]["anchors"]), *open_dynamic_v2(d["open_dynamic_v2"]),
        *_hint(d["inverse_tone_mapping_hint"], "inverse_tone_mapping_hint values must be in [0, 1]"),
    ]


def static_meta(s: Column) -> Rules:
    m, level = s["mastering_display"], s["content_light_level"]
    points = F.array(*(m[p] for p in ("red_primary", "green_primary", "blue_primary", "white_point")))
    pair = ((s["tier"] == "delivery") & (s["precision"] == "float32")) | ((s["tier"] == "mastering") & (s["precision"] == "float64"))
    return [
        (F.trim(s["format_version"]) == "", "format version must not be empty"),
        (~s["metadata_schema_version"].isin(1, 2), "metadata_schema_version is unsupported"),
        (~pair, "tier and precision combination is invalid"),
        (s["colour_standard"] != "rec2100", 'colour_standard must be "rec2100"'),
        (s["colour_primaries"] != "rec2020", 'colour_primaries must be "rec2020"'),
        ((s["tier"] == "delivery") & (s["transfer_function"] != "st2084_pq"), 'delivery tier requires transfer_function "st2084_pq"'),
        ((s["tier"] == "mastering") & (s["transfer_function"] != "linear"), 'mastering tier requires transfer_function "linear"'),
        (s["dynamic_metadata_standard"] != "st2094", 'dynamic_metadata_standard must be "st2094"'),
        (_any(points, lambda p: ~finite(p["x"]) | ~finite(p["y"])), "mastering display chromaticity points must be finite"),
        (_any(points, lambda p: ~_unit(p["x"]) | ~_unit(p["y"])), "mastering display chromaticity points must be in [0.0, 1.0]"),
        (~finite(m["min_luminance_nits"]) | ~finite(m["max_luminance_nits"]), "mastering display luminance values must be finite"),
        ((m["min_luminance_nits"] < 0) | (m["max_luminance_nits"] <= m["min_luminance_nits"]), "mastering display requires max_luminance_nits > min_luminance_nits >= 0"),
        (~finite(level["max_cll_nits"]) | ~finite(level["max_fall_nits"]), "content light level values must be finite"),
        ((level["max_cll_nits"] < 0) | (level["max_fall_nits"] < 0), "content light level values must be non-negative"),
        (level["max_fall_nits"] > level["max_cll_nits"], "max_fall_nits must be <= max_cll_nits"),
        (_any(s["compatibility_tags"], lambda t: F.trim(t) == ""), "compatibility_tags cannot contain empty entries"),
    ]


def compatibility(static_version: Column, dynamic_version: Column, tier: Column, v2: Column, hint: Column, strict: bool = False, write_version: Column | int = 2) -> Rules:
    """Whether static and dynamic metadata of one stream fit together; the order of rules decides which message comes."""
    w = write_version if isinstance(write_version, Column) else F.lit(write_version)
    master = tier == "mastering"
    mode = (static_version != 2, "strict mode only accepts current metadata schema version") if strict else (~static_version.isin(1, 2), "unsupported metadata schema version")
    only = lambda f: f"mastering-tier files must not carry {f} (delivery-only adaptation)"
    return [
        (static_version != dynamic_version, "static and dynamic metadata schema versions must match"),
        ((static_version == 2) & v2.isNull(), "schema v2 requires open_dynamic_v2 payload"),
        ((static_version == 1) & v2.isNotNull(), "schema v1 cannot carry open_dynamic_v2 payload"),
        mode, ((w < 1) | (w > 2), "write_schema_version is out of supported range"),
        (master & hint.isNotNull(), only("inverse_tone_mapping_hint")),
        *((master & v2[f].isNotNull(), only(f"open_dynamic_v2.{f}")) for f in ("adaptation_layer", "ambient_policy", "gaming_profile", "inverse_tone_mapping_hint")),
    ]


def container_schema(container: Column, schema: Column) -> Rules:
    return [
        (~container.isin(1, 2), "unsupported container version"),
        ((container == 1) & (schema != 1), "container version 1 only supports metadata schema 1"),
        (~schema.isin(1, 2), "unsupported metadata schema version"),
    ]


def object_regions(regions: Column) -> Rules:
    ids = F.transform(regions, lambda r: r["region_id"])
    return [
        (F.size(F.array_distinct(ids)) != F.size(ids), "region ids must be unique"),
        (_any(regions, lambda r: first_failure(box(r)).isNotNull()), "region bounding box is invalid"),
    ]


def region_motion(region: Column, most_keyframes: int = 1024) -> Rules:
    """A moving box (x, y, width, height, motion as in `regions.box_at`) must stay within the frame on its whole way."""
    m = region["motion"]
    keys = m["keyframes"]
    deltas = F.transform(keys, lambda k: k["frame_delta"])
    piecewise, moving = m["kind"] == "piecewise_linear", m["kind"] == "translate"
    first = F.get(keys, F.lit(0))
    at = lambda dx, dy: F.struct((region["x"] + dx).alias("x"), (region["y"] + dy).alias("y"), region["width"].alias("width"), region["height"].alias("height"))
    last = F.when(piecewise, F.element_at(deltas, -1) + 1).otherwise(m["frame_count"])
    rules = [
        (~piecewise & (last <= 0), "region motion frame_count must be greater than zero"),
        (moving & (~finite(m["dx_per_frame"]) | ~finite(m["dy_per_frame"])), "region motion deltas must be finite"),
        (moving & first_failure(box(at(m["dx_per_frame"] * (last - 1), m["dy_per_frame"] * (last - 1)))).isNotNull(), "region motion leaves the frame"),
        (piecewise & (F.size(keys) < 2), "piecewise-linear region motion requires at least two keyframes"),
        (piecewise & (F.size(keys) > most_keyframes), "piecewise-linear region motion has too many keyframes"),
        (piecewise & _any(keys, lambda k: ~finite(k["dx"]) | ~finite(k["dy"])), "piecewise-linear region motion offsets must be finite"),
        (piecewise & ((first["frame_delta"] != 0) | (first["dx"] != 0) | (first["dy"] != 0)), "piecewise-linear region motion must start at frame_delta 0 with zero offset"),
        (piecewise & ~_increasing(deltas), "piecewise-linear region motion keyframes must be strictly increasing"),
        (piecewise & _any(keys, lambda k: first_failure(box(at(k["dx"], k["dy"]))).isNotNull()), "region motion leaves the frame"),
    ]
    return [(m.isNotNull() & bad, text) for bad, text in rules]


def spherical_region(c: Column) -> Rules:
    half, pi = c["angular_height"] / 2, math.pi
    bad = F.lit(False)
    for name in ("centre_azimuth", "centre_elevation", "angular_width", "angular_height"):
        bad = bad | ~finite(c[name])
    return [
        (bad, "spherical region angles must be finite"),
        (F.abs(c["centre_azimuth"]) > pi, "spherical region centre_azimuth must be in [-pi, pi]"),
        (F.abs(c["centre_elevation"]) > pi / 2, "spherical region centre_elevation must be in [-pi/2, pi/2]"),
        ((c["angular_width"] <= 0) | (c["angular_width"] > 2 * pi), "spherical region angular_width must be in (0, 2*pi]"),
        ((c["angular_height"] <= 0) | (c["angular_height"] > pi), "spherical region angular_height must be in (0, pi]"),
        (F.abs(c["centre_elevation"]) + half > pi / 2 + 1e-4, "spherical region latitude extent must stay within [-pi/2, pi/2]"),
    ]


def encoder_config(c: Column) -> Rules:
    return [
        ((c["speed"] < 0) | (c["speed"] > 10), "speed must be in 0..=10"),
        ((c["quantizer"] < 0) | (c["quantizer"] > 255), "quantizer must be in 0..=255"),
        (c["lossless"] & (c["quantizer"] != 0), "lossless requires quantizer 0"),
    ]


def unknown_keys(json: Column, allowed: tuple[str, ...]) -> Column:
    """Top-level keys of a JSON object that a strict schema does not know (null text: none)."""
    return F.coalesce(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed))), F.array().cast("array<string>"))


def vector_id(text: Column) -> Column:
    """Ids of conformance vectors: letters, digits, dash and underscore."""
    return text.rlike("^[A-Za-z0-9_-]{1,128}$")


def relative_path(text: Column) -> Column:
    """Paths that stay below their root."""
    return ~text.startswith("/") & ~F.array_contains(F.split(text, "[/\\\\]"), "..") & (text != "")
