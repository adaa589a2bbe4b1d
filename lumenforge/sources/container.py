"""Frame containers: header, metadata blocks and payload ranges, as a data source and as functions on bytes.

Layout (little endian): magic, version u16, tier u8, codec u8, width, height, frames, flags (must be 0), metadata length
u32; the stream's metadata as JSON; then for each frame a length-prefixed JSON block and its payload (raw samples in
codec 0, length-prefixed bytes in codec 1). The magic is a parameter: files of other families differ in it alone.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC = b"LFHD"
HEADER = struct.Struct("<4sHBBIIIII")
TIERS = ("delivery", "mastering")
# What a reader accepts at most.
MAX_JSON, MAX_PIXELS, MAX_PAYLOAD, MAX_FRAMES = 16 << 20, 16_777_216, 512 << 20, 100_000
SCHEMA = "path string, version int, tier string, codec int, width int, height int, frame_count int, static_meta string, frame_index long, dynamic_meta string, payload_offset long, payload_length long"


class ContainerError(ValueError):
    """A file that breaks the layout or a limit."""


@dataclass(frozen=True)
class Header:
    version: int
    tier: str
    codec: int
    width: int
    height: int
    frames: int
    meta_length: int

    def to_bytes(self, magic: bytes = MAGIC) -> bytes:
        return HEADER.pack(magic, self.version, TIERS.index(self.tier), self.codec, self.width, self.height, self.frames, 0, self.meta_length)

    @classmethod
    def from_bytes(cls, data: bytes, magic: bytes = MAGIC) -> Header:
        if len(data) < HEADER.size:
            raise ContainerError("truncated header")
        found, version, tier, codec, width, height, frames, flags, meta = HEADER.unpack_from(data)
        checks = [
            (found != magic, "bad magic"), (version > 2, "container version is from the future"), (version not in (1, 2), "unsupported container version"),
            (flags != 0, "reserved flags must be zero"), (tier >= len(TIERS), "unknown tier"), (codec not in (0, 1), "unknown codec"),
            (width == 0 or height == 0, "dimensions must not be zero"), (frames > MAX_FRAMES, "too many frames"),
            (meta > MAX_JSON, "metadata is too long"), (width * height > MAX_PIXELS, "frames are too large"),
        ]
        for bad, message in checks:
            if bad:
                raise ContainerError(message)
        return cls(version, TIERS[tier], codec, width, height, frames, meta)

    @property
    def raw_bytes(self) -> int:
        return self.width * self.height * 3 * (4 if self.tier == "delivery" else 8)


def compressed_budget(raw: int) -> int:
    """What a compressed frame may take: eight times its raw size, 256 KiB at least, 512 MiB at most."""
    return min(max(8 * raw, 256 << 10), MAX_PAYLOAD)


def _block(data: bytes, at: int, limit: int) -> tuple[bytes, int]:
    if at + 4 > len(data):
        raise ContainerError("truncated length")
    (n,) = struct.unpack_from("<I", data, at)
    if n > limit:
        raise ContainerError("block is longer than its limit")
    if at + 4 + n > len(data):
        raise ContainerError("truncated block")
    return data[at + 4 : at + 4 + n], at + 4 + n


def parse(data: bytes, magic: bytes = MAGIC, strict_end: bool = True) -> tuple[Header, str, list[tuple[int, str, int, int]]]:
    """Header, stream metadata, and (index, metadata, payload offset, payload length) of each frame; payloads stay put."""
    head = Header.from_bytes(data, magic)
    at = HEADER.size + head.meta_length
    static = data[HEADER.size : at]
    if len(static) < head.meta_length:
        raise ContainerError("truncated metadata")
    schema = json.loads(static or b"{}").get("metadata_schema_version", 1)
    if (head.version == 1 and schema != 1) or schema not in (1, 2):
        raise ContainerError("metadata schema does not fit the container version")
    frames = []
    for i in range(head.frames):
        meta, at = _block(data, at, MAX_JSON)
        if json.loads(meta).get("frame_index", i) != i:
            raise ContainerError("frame index does not match its position")
        if head.codec == 0:
            start, n = at, head.raw_bytes
            at += n
            if at > len(data):
                raise ContainerError("truncated pixels")
        else:
            payload, end = _block(data, at, compressed_budget(head.raw_bytes))
            start, n, at = at + 4, len(payload), end
        frames.append((i, meta.decode(), start, n))
    if strict_end and at != len(data):
        raise ContainerError("bytes after the last frame")
    return head, static.decode(), frames


def build(head: Header, static: str, frames: list[tuple[str, bytes]], magic: bytes = MAGIC) -> bytes:
    """The file of a header's stream; frame counts and lengths are filled in."""
    meta = static.encode()
    head = Header(head.version, head.tier, head.codec, head.width, head.height, len(frames), len(meta))
    out = [head.to_bytes(magic), meta]
    for text, payload in frames:
        block = text.encode()
        if head.codec == 0 and len(payload) != head.raw_bytes:
            raise ContainerError("payload does not match the dimensions")
        out += [struct.pack("<I", len(block)), block, *([struct.pack("<I", len(payload))] if head.codec else []), payload]
    return b"".join(out)


def raw_pixels(payload: bytes, tier: str) -> np.ndarray:
    """(pixels, 3) of an uncompressed payload; values must be finite."""
    out = np.frombuffer(payload, "<f4" if tier == "delivery" else "<f8").reshape(-1, 3)
    if not np.isfinite(out).all():
        raise ContainerError("pixels must be finite")
    return out


#: Frames of a long file that one partition reads, and bytes from which a file is long.
RANGE_FRAMES, LONG_FILE = 256, 64 << 20


def _open(uri: str):
    """(pyarrow filesystem, path) of a path or URI, in any store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = uri.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class ContainerSource(DataSource):
    """``spark.read.format("frames")``: one row a frame, with its payload's byte range.

    Options: path (a file or a folder of files), magic, strict_end, payload (``true`` adds the payload's bytes as a column),
    range_frames and long_file (how long files are split). Files are opened where tasks run, through pyarrow's filesystems.
    A long file is read by ranges of frames, one partition each: a task skips ahead by lengths alone and holds one frame.

    ``df.write.format("frames")`` writes rows (name, version, tier, codec, width, height, frame_count, static_meta,
    frame_index, dynamic_meta, payload): a file for each name, moved into place when the whole job has succeeded. A
    stream's rows must come together and in order (`write_containers`).
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA + (", payload binary" if self.options.get("payload", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return ContainerReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ContainerWriter(self.options, overwrite)


@dataclass
class FramePartition(InputPartition):
    """Frames ``first`` to ``last`` (not included; None: to the end) of a file."""

    path: str
    first: int
    last: int | None


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.magic = options["path"], options.get("magic", MAGIC.decode()).encode()
        self.strict, self.payload = (options.get(k, d).lower() == "true" for k, d in (("strict_end", "true"), ("payload", "false")))
        self.frames, self.long = int(options.get("range_frames", RANGE_FRAMES)), int(options.get("long_file", LONG_FILE))

    def partitions(self) -> list[FramePartition]:
        from pyarrow import fs

        files, path = _open(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else [f for f in files.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        prefix = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        out = []
        for f in found:
            n = 0
            if f.size > self.long:  # only then is its header read here
                with files.open_input_file(f.path) as data:
                    n = Header.from_bytes(data.read(HEADER.size), self.magic).frames
            firsts = range(0, n, self.frames) if n else (0,)
            out += [FramePartition(prefix + f.path, a, None if a + self.frames >= n else a + self.frames) for a in firsts]
        return out

    def read(self, partition: FramePartition) -> Iterator[tuple]:
        files, path = _open(partition.path)
        with files.open_input_file(path) as f:
            end = f.size()
            for row in frames_of(f, end, partition.first, partition.last, self.magic, self.strict, self.payload):
                yield partition.path, *row


def frames_of(f, end: int, first: int, last: int | None, magic: bytes, strict: bool, payload: bool) -> Iterator[tuple]:
    """The rows of some frames of an open file; frames before them are skipped by their lengths."""

    def length(at: int, limit: int) -> int:
        if at + 4 > end:
            raise ContainerError("truncated length")
        f.seek(at)
        (n,) = struct.unpack("<I", f.read(4))
        if n > limit:
            raise ContainerError("block is longer than its limit")
        if at + 4 + n > end:
            raise ContainerError("truncated block")
        return n

    f.seek(0)
    head = Header.from_bytes(f.read(HEADER.size), magic)
    static = f.read(head.meta_length)
    if len(static) < head.meta_length:
        raise ContainerError("truncated metadata")
    schema = json.loads(static or b"{}").get("metadata_schema_version", 1)
    if (head.version == 1 and schema != 1) or schema not in (1, 2):
        raise ContainerError("metadata schema does not fit the container version")
    at, last = HEADER.size + head.meta_length, head.frames if last is None else min(last, head.frames)
    for i in range(last):
        n = length(at, MAX_JSON)
        meta = f.read(n) if i >= first else b""
        at += 4 + n
        size = head.raw_bytes if head.codec == 0 else length(at, compressed_budget(head.raw_bytes))
        at += 0 if head.codec == 0 else 4
        if at + size > end:
            raise ContainerError("truncated pixels")
        if i >= first:
            if json.loads(meta).get("frame_index", i) != i:
                raise ContainerError("frame index does not match its position")
            body: tuple = ()
            if payload:
                f.seek(at)
                body = (f.read(size),)
            yield head.version, head.tier, head.codec, head.width, head.height, head.frames, static.decode(), i, meta.decode(), at, size, *body
        at += size
    if strict and last == head.frames and at != end:
        raise ContainerError("bytes after the last frame")


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (where they are, where they belong)."""

    files: list[tuple[str, str]]


class ContainerWriter(DataSourceWriter):
    """Each task writes whole files under hidden names; the driver moves them into place, or removes them."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.magic, self.overwrite = options["path"], options.get("magic", MAGIC.decode()).encode(), overwrite

    def write(self, iterator: Iterator) -> Written:
        files, folder = _open(self.path)
        files.create_dir(folder, recursive=True)
        done: list[tuple[str, str]] = []
        name, out, head, index = None, None, None, 0

        def close() -> None:
            if out:
                out.close()
                if index != head.frames:
                    raise ContainerError(f"{name}: {index} frames instead of {head.frames}")

        try:
            for r in iterator:
                if r["name"] != name:
                    close()
                    name, index, meta = r["name"], 0, (r["static_meta"] or "{}").encode()
                    if not name or "/" in name or name.startswith((".", "_")):
                        raise ContainerError("a name must be that of a file")
                    head = Header(r["version"], r["tier"], r["codec"], r["width"], r["height"], r["frame_count"], len(meta))
                    start = head.to_bytes(self.magic)
                    Header.from_bytes(start, self.magic)
                    done.append((f"{folder}/.{name}.{uuid.uuid4().hex}", f"{folder}/{name}"))
                    out = files.open_output_stream(done[-1][0])
                    out.write(start + meta)
                if r["frame_index"] != index:
                    raise ContainerError(f"{name}: frame {r['frame_index']} where {index} belongs")
                block, payload = (r["dynamic_meta"] or "{}").encode(), bytes(r["payload"])
                if json.loads(block).get("frame_index", index) != index:
                    raise ContainerError("frame index does not match its position")
                if head.codec == 0 and len(payload) != head.raw_bytes:
                    raise ContainerError("payload does not match the dimensions")
                if head.codec == 1 and len(payload) > compressed_budget(head.raw_bytes):
                    raise ContainerError("block is longer than its limit")
                if head.codec == 0:
                    raw_pixels(payload, head.tier)
                out.write(struct.pack("<I", len(block)) + block + (struct.pack("<I", len(payload)) if head.codec else b""))
                out.write(payload)
                index += 1
            close()
        except BaseException:
            for part, _ in done:
                if files.get_file_info(part).is_file:
                    files.delete_file(part)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _open(self.path)
        moves = [m for w in messages if w for m in w.files]
        if len({final for _, final in moves}) < len(moves):
            self.abort(messages)
            raise ContainerError("a stream's frames came to several tasks")
        if self.overwrite:
            from pyarrow import fs

            for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.is_file and not f.base_name.startswith((".", "_")):
                    files.delete_file(f.path)
        for part, final in moves:
            files.move(part, final)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _open(self.path)
        for w in messages:
            for part, _ in w.files if w else ():
                if files.get_file_info(part).is_file:
                    files.delete_file(part)


COLUMNS = ("name", "version", "tier", "codec", "width", "height", "frame_count", "static_meta", "frame_index", "dynamic_meta", "payload")


def write_containers(frames: DataFrame, folder: str, mode: str = "append", **options: str) -> None:
    """A file for each ``name``; its frames meet in one task, in order, and are written one after another."""
    frames.sparkSession.dataSource.register(ContainerSource)
    dealt = frames.select(*COLUMNS).repartition("name").sortWithinPartitions("name", "frame_index")
    dealt.write.format("frames").mode(mode).options(path=folder, **options).save()
