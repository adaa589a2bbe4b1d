"""Image payloads: raw 10-bit triplets and PPM, made where the pixels are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def frames_as_bytes(pixels: DataFrame, width: int, kind: str = "hdr10") -> DataFrame:
    """(frame_index, content) of integer pixels r, g, b: ``hdr10`` (u16 little endian), ``ppm8`` or ``ppm16``.

    One frame is one row of at most 16 Mi pixels; it is assembled in the task that gets its pixels.
    """
    types = {"hdr10": "<u2", "ppm8": "u1", "ppm16": ">u2"}
    if kind not in types:
        raise ValueError(f"unknown kind {kind}")

    def image(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pixel_idx")
        body = part[["r", "g", "b"]].to_numpy().astype(types[kind]).tobytes()
        head = b"" if kind == "hdr10" else f"P6\n{width} {len(part) // width}\n{255 if kind == 'ppm8' else 65535}\n".encode()
        return pd.DataFrame({"frame_index": [part.frame_index.iloc[0]], "content": [head + body]})

    return pixels.select("frame_index", "pixel_idx", "r", "g", "b").groupBy("frame_index").applyInPandas(image, "frame_index long, content binary")


def write_images(images: DataFrame, folder: str, suffix: str) -> None:
    """Each row's content as a file of its own, moved into place whole; tasks that run twice write the same bytes."""

    def write(rows: Iterator) -> None:
        import uuid

        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(path, recursive=True)
        for r in rows:
            part = f"{path}/.{r.frame_index}.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as f:
                f.write(bytes(r.content))
            files.move(part, f"{path}/{r.frame_index:06d}.{suffix}")

    images.foreachPartition(write)


def scale_codes(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes of ``bits`` bits as 16-bit samples."""
    return (codes.astype(np.uint32) * 65_535 + ((1 << bits) - 1) // 2) // ((1 << bits) - 1)
