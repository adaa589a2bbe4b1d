"""Bitstreams: LEB128, AV1 open bitstream units with user metadata, IVF, and sample tables of MP4 boxes.

Functions on bytes, and mappers that turn a ``binaryFile`` table (path, content) into rows on the executors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Unit types, user-data framing.
FRAME_HEADER, METADATA, FRAME = 3, 5, 6
T35, COUNTRY_US, MARKER = 4, 0xB5, 0x80
PROVIDER = b"LFHD\x01"


class BitstreamError(ValueError):
    """Bytes that are cut short or out of bounds."""


def write_leb128(value: int) -> bytes:
    out = bytearray()
    while True:
        out.append((value & 0x7F) | (0x80 if value > 0x7F else 0))
        value >>= 7
        if not value:
            return bytes(out)


def read_leb128(data: bytes, at: int) -> tuple[int, int]:
    """Value, and the place after it; eight bytes at most."""
    value = 0
    for i in range(8):
        if at + i >= len(data):
            raise BitstreamError("truncated LEB128 value")
        value |= (data[at + i] & 0x7F) << (7 * i)
        if data[at + i] < 0x80:
            return value, at + i + 1
    raise BitstreamError("LEB128 value is longer than eight bytes")


def units(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(type, start, payload start, end) of each unit of a temporal unit; one without a size takes the rest."""
    at = 0
    while at < len(data):
        head = data[at]
        if head & 0x80:
            raise BitstreamError("forbidden bit is set")
        start = at + 1 + (head >> 2 & 1)
        if start > len(data):
            raise BitstreamError("truncated unit header")
        end = len(data)
        if head >> 1 & 1:
            size, start = read_leb128(data, start)
            end = start + size
            if end > len(data):
                raise BitstreamError("unit runs past the temporal unit")
        yield head >> 3 & 15, at, start, end
        at = end


def metadata_unit(payload: bytes, provider: bytes = PROVIDER) -> bytes:
    body = write_leb128(T35) + bytes([COUNTRY_US]) + provider + payload + bytes([MARKER])
    return bytes([METADATA << 3 | 2]) + write_leb128(len(body)) + body


def embed(data: bytes, payload: bytes, provider: bytes = PROVIDER) -> bytes:
    """The temporal unit with user metadata ahead of its first frame (at its end, if it has none)."""
    at = next((start for kind, start, _, _ in units(data) if kind in (FRAME_HEADER, FRAME)), len(data))
    return data[:at] + metadata_unit(payload, provider) + data[at:]


def extract(data: bytes, provider: bytes = PROVIDER) -> list[bytes]:
    """Payloads of all user metadata of this provider, in order."""
    head = write_leb128(T35) + bytes([COUNTRY_US]) + provider
    return [data[a + len(head) : b - 1] for kind, _, a, b in units(data) if kind == METADATA and data[a:b].startswith(head) and b - a > len(head) and data[b - 1] == MARKER]


def write_ivf(frames: list[bytes], width: int, height: int, fps: float, scale: int = 1000) -> bytes:
    if not frames or not (0 < width < 65_536 and 0 < height < 65_536) or not fps > 0:
        raise BitstreamError("IVF needs frames, 16-bit dimensions and a positive rate")
    head = struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, b"AV01", width, height, int(fps * scale + 0.5), scale, len(frames), 0)
    return head + b"".join(struct.pack("<IQ", len(f), i) + f for i, f in enumerate(frames))


def read_ivf(data: bytes) -> list[tuple[int, bytes]]:
    """(timestamp, frame) of an IVF file."""
    if data[:4] != b"DKIF" or len(data) < 32:
        raise BitstreamError("not an IVF file")
    at, out = struct.unpack_from("<H", data, 6)[0], []
    while at < len(data):
        if at + 12 > len(data):
            raise BitstreamError("truncated IVF frame header")
        n, stamp = struct.unpack_from("<IQ", data, at)
        if at + 12 + n > len(data):
            raise BitstreamError("truncated IVF frame")
        out.append((stamp, data[at + 12 : at + 12 + n]))
        at += 12 + n
    return out


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the boxes in a range; 64-bit sizes and a last box without size included."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind, body = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8], at + 8
        if size == 1:
            if at + 16 > end:
                raise BitstreamError("truncated box")
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        stop = end if size == 0 else at + size
        if stop > end or stop < body:
            raise BitstreamError("box runs past its parent")
        yield kind, body, stop
        at = stop


def find(data: bytes, path: str, start: int = 0, end: int | None = None) -> tuple[int, int] | None:
    """Body of the first box at a path such as moov/trak/mdia."""
    head, _, rest = path.partition("/")
    for kind, a, b in boxes(data, start, end):
        if kind == head.encode() and (found := (a, b) if not rest else find(data, rest, a, b)):
            return found
    return None


def mp4_samples(data: bytes) -> list[tuple[int, int]]:
    """(offset, size) of every sample of a progressive file's first track, or of all fragments of a fragmented one."""
    table = find(data, "moov/trak/mdia/minf/stbl")
    if table and (sizes := _sizes(data, table)):
        return _progressive(data, table, sizes)
    out: list[tuple[int, int]] = []
    for a, b in ((a, b) for k, a, b in boxes(data) if k == b"moof"):
        traf = find(data, "traf", a, b)
        if not traf:
            continue
        default, base = 0, a - 8
        if head := find(data, "tfhd", *traf):
            flags, at = struct.unpack_from(">I", data, head[0])[0] & 0xFFFFFF, head[0] + 8
            if flags & 1:
                base = struct.unpack_from(">Q", data, at)[0]
            at += sum(n for bit, n in ((1, 8), (2, 4), (8, 4)) if flags & bit)
            default = struct.unpack_from(">I", data, at)[0] if flags & 0x10 else 0
        place = None
        for run, c, d in boxes(data, *traf):
            if run != b"trun":
                continue
            flags, count = struct.unpack_from(">II", data, c)
            flags, at = flags & 0xFFFFFF, c + 8
            if flags & 1:
                place, at = base + struct.unpack_from(">i", data, at)[0], at + 4
            at += 4 if flags & 4 else 0
            each = [(bit, 4) for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            if at + 4 * len(each) * count > d:
                raise BitstreamError("truncated run of samples")
            place = b if place is None else place
            for _ in range(count):
                size = default
                for bit, n in each:
                    if bit == 0x200:
                        size = struct.unpack_from(">I", data, at)[0]
                    at += n
                if place + size > len(data):
                    raise BitstreamError("sample runs past the file")
                out.append((place, size))
                place += size
    return out


def _sizes(data: bytes, table: tuple[int, int]) -> list[int]:
    at = find(data, "stsz", *table)
    if not at:
        return []
    same, count = struct.unpack_from(">II", data, at[0] + 4)
    if not same and at[0] + 12 + 4 * count > at[1]:
        raise BitstreamError("truncated sample sizes")
    return [same] * count if same else list(struct.unpack_from(f">{count}I", data, at[0] + 12))


def _progressive(data: bytes, table: tuple[int, int], sizes: list[int]) -> list[tuple[int, int]]:
    runs, short, long = find(data, "stsc", *table), find(data, "stco", *table), find(data, "co64", *table)
    if not runs or not (short or long):
        raise BitstreamError("sample table is incomplete")
    n = struct.unpack_from(">I", data, runs[0] + 4)[0]
    entries = [struct.unpack_from(">III", data, runs[0] + 8 + 12 * i)[:2] for i in range(n)]
    a = (short or long)[0]
    count = struct.unpack_from(">I", data, a + 4)[0]
    chunks = struct.unpack_from(f">{count}{'I' if short else 'Q'}", data, a + 8)
    out, i, e = [], 0, 0
    for k, place in enumerate(chunks, 1):
        while e + 1 < len(entries) and entries[e + 1][0] <= k:
            e += 1
        for size in sizes[i : i + entries[e][1]]:
            if place + size > len(data):
                raise BitstreamError("sample runs past the file")
            out.append((place, size))
            place += size
            i += 1
    return out


def sniff(data: bytes) -> str:
    return "ivf" if data[:4] == b"DKIF" else "mp4" if data[4:8] == b"ftyp" else "obu"


def stream_units(data: bytes) -> list[bytes]:
    """Temporal units of a file of any of the three kinds."""
    kind = sniff(data)
    return [f for _, f in read_ivf(data)] if kind == "ivf" else [data[a : a + n] for a, n in mp4_samples(data)] if kind == "mp4" else [data]


def probe(files: DataFrame, provider: bytes = PROVIDER) -> DataFrame:
    """(path, kind, unit, payload, error) of all user metadata in files (path, content); a bad file gives one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                content = bytes(content or b"")
                try:
                    out += [(path, sniff(content), i, p, None) for i, u in enumerate(stream_units(content)) for p in extract(u, provider)]
                except (BitstreamError, struct.error) as e:
                    out.append((path, sniff(content), None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "kind", "unit", "payload", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, kind string, unit long, payload binary, error string")


def box(kind: bytes, *parts: bytes) -> bytes:
    """A box; beyond 4 GiB with a 64-bit size."""
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I", len(body) + 8) + kind + body
    return struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body


def _words(*v: int) -> bytes:
    return struct.pack(f">{len(v)}I", *v)


_MATRIX = _words(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _track(width: int, height: int, ticks: int, table: bytes, clock: int) -> bytes:
    """A video track of AV1 samples around a sample table."""
    head = box(b"tkhd", _words(7, 0, 0, 1, 0, ticks, 0, 0, 0, 0), _MATRIX, _words(width << 16, height << 16))
    handler = box(b"hdlr", _words(0, 0), b"vide", _words(0, 0, 0), b"\0")
    refs = box(b"dinf", box(b"dref", _words(0, 1), box(b"url ", _words(1))))
    return box(b"trak", head, box(b"mdia", box(b"mdhd", _words(0, 0, 0, clock, ticks, 0x55C40000)), handler, box(b"minf", box(b"vmhd", _words(1, 0, 0)), refs, table)))


def _entry(width: int, height: int) -> bytes:
    av1c = box(b"av1C", bytes([0x81, 0, 0x0C, 0]))
    return box(b"stsd", _words(0, 1), box(b"av01", b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HH", width, height), _words(0x480000, 0x480000, 0), struct.pack(">H", 1), b"\0" * 32, struct.pack(">Hh", 24, -1), av1c))


def write_mp4(frames: list[tuple[bytes, bool]], width: int, height: int, ticks: int, clock: int = 90_000) -> bytes:
    """A progressive file of (sample, is keyframe) in one chunk; 64-bit offsets where they are needed."""
    if not frames:
        raise BitstreamError("a file needs frames")
    sizes = [len(f) for f, _ in frames]
    start = box(b"ftyp", b"iso6", _words(0), b"iso6av01mp41")
    place = len(start) + (16 if sum(sizes) + 8 >= 1 << 32 else 8)
    keys = [i for i, (_, key) in enumerate(frames, 1) if key]
    offsets = box(b"stco", _words(0, 1, place)) if place < 1 << 32 else box(b"co64", _words(0, 1), struct.pack(">Q", place))
    table = box(
        b"stbl", _entry(width, height), box(b"stts", _words(0, 1, len(frames), ticks)), box(b"stss", _words(0, len(keys), *keys)),
        box(b"stsc", _words(0, 1, 1, len(frames), 1)), box(b"stsz", _words(0, 0, len(frames), *sizes)), offsets,
    )
    total = ticks * len(frames)
    head = box(b"mvhd", _words(0, 0, 0, clock, total, 0x10000, 0x1000000, 0, 0), _MATRIX, _words(0, 0, 0, 0, 0, 0, 2))
    return start + box(b"mdat", *(f for f, _ in frames)) + box(b"moov", head, _track(width, height, total, table, clock))


def write_fragments(segments: list[list[tuple[bytes, bool]]], width: int, height: int, ticks: int, clock: int = 90_000) -> list[bytes]:
    """A header, then one fragment for each segment of (sample, is keyframe); decode times go on from fragment to fragment."""
    if not segments or not all(segments):
        raise BitstreamError("a fragment needs frames")
    empty = box(b"stbl", _entry(width, height), *(box(k, _words(0, 0)) for k in (b"stts", b"stsc", b"stco")), box(b"stsz", _words(0, 0, 0)))
    head = box(b"mvhd", _words(0, 0, 0, clock, 0, 0x10000, 0x1000000, 0, 0), _MATRIX, _words(0, 0, 0, 0, 0, 0, 2))
    out = [box(b"ftyp", b"iso6", _words(0), b"iso6av01cmfc") + box(b"moov", head, _track(width, height, 0, empty, clock), box(b"mvex", box(b"trex", _words(0, 1, 1, 0, 0, 0))))]
    done = 0
    for n, segment in enumerate(segments, 1):

        def moof(offset: int, n: int = n, segment: list = segment, done: int = done) -> bytes:
            runs = b"".join(_words(ticks, len(f), 0x02000000 if key else 0x01010000) for f, key in segment)
            traf = box(b"traf", box(b"tfhd", _words(0x020000, 1)), box(b"tfdt", _words(0x01000000), struct.pack(">Q", done * ticks)), box(b"trun", _words(0x000701, len(segment), offset), runs))
            return box(b"moof", box(b"mfhd", _words(0, n)), traf)

        out.append(moof(len(moof(0)) + 8) + box(b"mdat", *(f for f, _ in segment)))
        done += len(segment)
    return out


def write_units(frames: list[bytes]) -> bytes:
    """An elementary stream: the temporal units one after another."""
    return b"".join(frames)


def fragment_times(data: bytes) -> list[tuple[int, int]]:
    """(decode time in ticks, duration) of every sample of a fragmented file: from each fragment's base time and runs."""
    out: list[tuple[int, int]] = []
    for kind, body in _boxes(data):
        if kind != b"moof":
            continue
        for traf in (b for k, b in _boxes(body) if k == b"traf"):
            parts = dict(_boxes(traf))
            if b"tfdt" not in parts:
                raise BitstreamError("a fragment without a decode time")
            time = struct.unpack_from(">Q" if parts[b"tfdt"][0] else ">I", parts[b"tfdt"], 4)[0]
            default = 0
            flags, at = struct.unpack_from(">I", parts[b"tfhd"])[0], 8
            for bit, size in ((1, 8), (2, 4), (8, 4)):
                if flags & bit:
                    default = struct.unpack_from(">I", parts[b"tfhd"], at)[0] if bit == 8 else default
                    at += size
            for run in (b for k, b in _boxes(traf) if k == b"trun"):
                flags, n = struct.unpack_from(">II", run)
                at = 8 + 4 * bool(flags & 1) + 4 * bool(flags & 4)
                step = 4 * sum(bool(flags & b) for b in (0x100, 0x200, 0x400, 0x800))
                for i in range(n):
                    ticks = struct.unpack_from(">I", run, at + i * step)[0] if flags & 0x100 else default
                    out.append((time, ticks))
                    time += ticks
    return out


def _boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of the boxes of some bytes, one after another."""
    return ((kind, data[a:b]) for kind, a, b in boxes(data))


METADATA_TYPE = "application/json"


def write_avif(item: bytes, width: int, height: int, metadata: bytes | None = None, content_type: str = METADATA_TYPE, name: bytes = b"lumenforge") -> bytes:
    """A still picture of one coded AV1 item, with metadata as a second item that describes the first."""
    if not width or not height:
        raise BitstreamError("dimensions must not be zero")
    if not item or metadata == b"":
        raise BitstreamError("items must not be empty")
    parts = [item] + ([metadata] if metadata else [])
    full = lambda kind, *body, flags=0, version=0: box(kind, _words(version << 24 | flags), *body)
    start = box(b"ftyp", b"avif", _words(0), b"avif", b"mif1", b"miaf", b"avis")
    entries = [full(b"infe", struct.pack(">HH", 1, 0), b"av01", b"\0", version=2)]
    if metadata:
        entries.append(full(b"infe", struct.pack(">HH", 2, 0), b"mime", b"\0", content_type.encode() + b"\0", version=2, flags=1))
    handler = full(b"hdlr", _words(0), b"pict", b"\0" * 12, name + b"\0")
    infos = full(b"iinf", struct.pack(">H", len(entries)), *entries)
    refs = [full(b"iref", box(b"cdsc", struct.pack(">HHH", 2, 1, 1)))] if metadata else []
    colour = box(b"colr", b"nclx", struct.pack(">HHHB", 9, 16, 9, 0x80))
    props = box(b"ipco", full(b"ispe", _words(width, height)), full(b"pixi", bytes([3, 12, 12, 12])), colour, box(b"av1C", bytes([0x81, 0x40, 0x6C, 0])))
    props = box(b"iprp", props, full(b"ipma", _words(1), struct.pack(">HB", 1, 4), bytes([1, 2, 3, 0x84])))

    def meta(base: int) -> bytes:
        places, at = [], base
        for i, p in enumerate(parts, 1):
            places.append(struct.pack(">HHHQQ", i, 0, 1, at, len(p)))
            at += len(p)
        iloc = full(b"iloc", bytes([0x88, 0]), struct.pack(">H", len(parts)), *places)
        return full(b"meta", handler, full(b"pitm", struct.pack(">H", 1)), iloc, infos, *refs, props)

    data = box(b"mdat", *parts)
    return start + meta(len(start) + len(meta(0)) + len(data) - sum(map(len, parts))) + data


def read_avif(data: bytes) -> dict[int, bytes]:
    """The items of a file by number, by their places."""
    kinds = dict(_boxes(data))
    if b"meta" not in kinds or not kinds.get(b"ftyp", b"").startswith(b"avif"):
        raise BitstreamError("not a still picture")
    iloc = dict(_boxes(kinds[b"meta"][4:]))[b"iloc"]
    if iloc[4:6] != bytes([0x88, 0]):
        raise BitstreamError("unsupported item places")
    (n,) = struct.unpack_from(">H", iloc, 6)
    out = {}
    for i in range(n):
        item, _, _, at, size = struct.unpack_from(">HHHQQ", iloc, 8 + i * 22)
        if at + size > len(data):
            raise BitstreamError("an item beyond the end")
        out[item] = data[at : at + size]
    return out
