"""Binary forms of stream and frame metadata: JSON behind a short head, and two older fixed layouts.

The eight-byte names of the forms are parameters: files of other families differ in them alone.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

STATIC_NAME, DYNAMIC_NAME, STATIC_V1_NAME = b"LFSMETA2", b"LFDMETA2", b"LFSMETA1"
HEAD = struct.Struct("<8sHI")
FIXED_STATIC, FIXED_DYNAMIC, MOST_ANCHORS = 128, 28, 32


class MetadataError(ValueError):
    """Bytes that are no metadata of the expected form."""


def encode(meta: dict, name: bytes = DYNAMIC_NAME) -> bytes:
    """Head (name, schema version, length) and compact JSON."""
    if len(meta.get("tone_map_curve", {}).get("anchors", ())) > MOST_ANCHORS:
        raise MetadataError("too many anchors")
    text = json.dumps(meta, separators=(",", ":"), ensure_ascii=False).encode()
    return HEAD.pack(name, meta.get("metadata_schema_version", 1), len(text)) + text


def _framed(data: bytes) -> dict:
    _, version, n = HEAD.unpack_from(data)
    if len(data) != HEAD.size + n:
        raise MetadataError("truncated metadata" if len(data) < HEAD.size + n else "bytes after the metadata")
    return json.loads(data[HEAD.size :]) | {"metadata_schema_version": version}  # the head's version holds


def decode_static(data: bytes, name: bytes = STATIC_NAME, old: bytes = STATIC_V1_NAME) -> dict:
    if data[:8] == name and len(data) >= HEAD.size:
        return _framed(data)
    if data[:8] != old or len(data) < FIXED_STATIC:
        raise MetadataError("no static metadata")
    if len(data) > FIXED_STATIC:
        raise MetadataError("bytes after the metadata")
    kinds = (("mastering", "delivery"), ("float64", "float32"), ("4:4:4", "4:2:0"))
    if any(data[8 + i] >= len(k) for i, k in enumerate(kinds)):
        raise MetadataError("unknown tier, precision or chroma")
    tier, precision, chroma = (k[data[8 + i]] for i, k in enumerate(kinds))
    v = struct.unpack_from("<10d2f", data, 12)
    point = lambda i: {"x": v[2 * i], "y": v[2 * i + 1]}
    return {
        "metadata_schema_version": 1, "tier": tier, "precision": precision, "chroma_subsampling": chroma, "colour_standard": "rec2100",
        "colour_primaries": "rec2020", "transfer_function": "linear" if tier == "mastering" else "st2084_pq", "dynamic_metadata_standard": "st2094",
        "mastering_display": {"red_primary": point(0), "green_primary": point(1), "blue_primary": point(2), "white_point": point(3), "min_luminance_nits": v[8], "max_luminance_nits": v[9]},
        "content_light_level": {"max_cll_nits": v[10], "max_fall_nits": v[11]},
    }


def decode_dynamic(data: bytes, name: bytes = DYNAMIC_NAME) -> dict:
    if data[:8] == name and len(data) >= HEAD.size:
        return _framed(data)
    if len(data) < FIXED_DYNAMIC:
        raise MetadataError("dynamic metadata is too short")
    index, peak, average, kind, count, low, high = struct.unpack_from("<QffBBxxff", data)
    if kind > 1 or count > MOST_ANCHORS:
        raise MetadataError("unknown curve or too many anchors")
    if len(data) != FIXED_DYNAMIC + 8 * count:
        raise MetadataError("truncated anchors" if len(data) < FIXED_DYNAMIC + 8 * count else "bytes after the metadata")
    anchors = [dict(zip(("input", "output"), p, strict=True)) for p in struct.iter_unpack("<ff", data[FIXED_DYNAMIC:])]
    return {
        "metadata_schema_version": 1, "frame_index": index, "scene_peak_luminance_nits": peak, "scene_average_luminance_nits": average,
        "tone_map_curve": {"type": "linear" if kind else "bezier", "anchors": anchors}, "target_display_hint": {"min_luminance_nits": low, "max_luminance_nits": high},
    }


def decode_table(blobs: DataFrame, kind: str = "dynamic", column: str = "content") -> DataFrame:
    """Adds ``json`` and ``error`` for a column of binary metadata; then validate it with `operators.validation`."""
    if kind not in ("static", "dynamic"):
        raise ValueError("kind is static or dynamic")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = decode_static if kind == "static" else decode_dynamic
        for b in batches:
            out = []
            for blob in b[column]:
                try:
                    out.append((json.dumps(decode(bytes(blob or b""))), None))
                except (MetadataError, UnicodeDecodeError, json.JSONDecodeError) as e:
                    out.append((None, str(e)))
            yield b.assign(json=[x[0] for x in out], error=[x[1] for x in out])

    from pyspark.sql import types as T  # noqa: N812

    schema = T.StructType([*blobs.schema.fields, T.StructField("json", T.StringType()), T.StructField("error", T.StringType())])
    return blobs.mapInPandas(run, schema)
