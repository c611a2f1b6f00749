"""ISO media containers: an index of their samples, without decoding payloads.

``container`` stores bytes as an uncompressed 8-bit grey video track; ``index``
walks the nested boxes of any ISO file, plain or fragmented, and reads from its
sample tables the codec, the duration, and the byte ranges of samples and keyframes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a frame (8 by 8 grey samples), frames of a chunk, frames from one
#: keyframe to the next, and frames a second of the containers written here.
FRAME, CHUNK, GROUP, RATE = 64, 32, 30, 30
#: Boxes that hold boxes, and the bytes of fields before these.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}


#: Boxes within boxes that are followed.
DEPTH = 32


class Malformed(ValueError):
    """The bytes break the box structure or their tables contradict each other."""


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    #: In units of the timescale; None if the file says that it is unknown.
    duration: int | None = 0
    #: One entry for each sample: offset and size; keyframes by number from 0.
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def key_ranges(self) -> np.ndarray:
        """(start, end) of each keyframe in the file."""
        start = self.offsets[self.keyframes]
        return np.stack([start, start + self.sizes[self.keyframes]], axis=1)


# --- writing ----------------------------------------------------------------------


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of ``FRAME``."""
    return data + bytes(-len(data) % FRAME or (0 if data else FRAME))


def container(payload: bytes) -> bytes:
    """An ISO file whose one track holds ``payload`` as frames of ``FRAME`` bytes."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    frames = len(payload) // FRAME
    long_time = frames >= 1 << 32
    when = ">QQIQ" if long_time else ">IIII"
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    large = len(payload) + 16 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(head) + len(mdat)
    chunks = -(-frames // CHUNK)
    at = first + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME
    wide = first + len(payload) >= 1 << 32
    rest = frames - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, rest, 1)] * (chunks == 1 or rest != CHUNK)
    keys = np.arange(0, frames, GROUP, dtype=np.int64) + 1
    grey = struct.pack(">6xH16x2H2I4xH32x2h", 1, 8, 8, 72 << 16, 72 << 16, 1, 40, -1)
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", grey)),
        _full(b"stts", struct.pack(">III", 1, frames, 1)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
    )
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(when, 0, 0, RATE, frames), struct.pack(">HH", 0x55C4, 0), version=int(long_time)),
        _full(b"hdlr", bytes(4), b"vide", bytes(13)),
        minf,
    )
    head_of_track = struct.pack(">QQIIQ" if long_time else ">IIIII", 0, 0, 1, 0, frames)
    tkhd = _full(b"tkhd", head_of_track, bytes(16), matrix, struct.pack(">II", 8 << 16, 8 << 16), version=int(long_time), flags=7)
    mvhd = _full(b"mvhd", struct.pack(when, 0, 0, RATE, frames), struct.pack(">IH10x", 1 << 16, 256), matrix, bytes(24), struct.pack(">I", 2), version=int(long_time))
    return b"".join([head, mdat, payload, _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))])


# --- reading ----------------------------------------------------------------------


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, start of box, start of body, end) of each box between two offsets."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise Malformed(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Malformed(f"a cut box at {start}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if start + size > end or body > start + size:
            raise Malformed(f"box {kind!r} at {start} leaves its parent")
        yield kind, start, body, start + size
        start += size


class _Table:
    """The fields of one box, read with checks against its end."""

    def __init__(self, data: bytes, body: int, end: int):
        self.data, self.at, self.end = data, body, end

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > self.end:
            raise Malformed(f"a table is cut at {self.at}")
        self.at += size
        return struct.unpack_from(form, self.data, self.at - size)

    def time(self, wide: bool) -> int | None:
        """A duration; all ones mean that it is unknown, and none beyond 63 bits is known."""
        value = self.take(">Q" if wide else ">I")[0]
        return None if value == (1 << (64 if wide else 32)) - 1 or value >> 63 else value

    def array(self, n: int, kind: str, width: int = 1) -> np.ndarray:
        size = n * width * int(kind[-1])
        if self.at + size > self.end:
            raise Malformed(f"a table is cut at {self.at}")
        self.at += size
        read = np.frombuffer(self.data, kind, n * width, self.at - size)
        if kind == ">u8" and len(read) and int(read.max()) >> 63:
            raise Malformed("an offset beyond any file")
        found = read.astype(np.int64)
        return found.reshape(n, width) if width > 1 else found

    def version(self) -> tuple[int, int]:
        (both,) = self.take(">I")
        return both >> 24, both & 0xFFFFFF


def index(data: bytes) -> list[Track]:
    """The tracks of an ISO file. Payload bytes are never read. ``Malformed`` is raised for
    bytes that are no such file, break off, nest deeper than ``DEPTH`` or hold more samples
    than bytes, and for tables outside the boxes that they belong to."""
    file = _File(data)
    file.walk(0, len(data), {}, 0)
    return file.done()


class _File:
    """What a walk over all boxes of a file has found so far. ``near`` passes on what the
    boxes around and before a box say: its track, its fragment and that one's defaults."""

    def __init__(self, data: bytes):
        self.data = data
        self.tracks: dict[int, Track] = {}
        self.defaults: dict[int, tuple[int, int, int]] = {}
        #: Samples of fragments by track: (offsets, sizes, whether a keyframe).
        self.runs: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.in_runs = 0

    def done(self) -> list[Track]:
        for number, runs in self.runs.items():
            track = self.tracks[number]
            before = len(track.sizes)
            offsets, sizes, keys = (np.concatenate(x) for x in zip(*runs, strict=True))
            track.keyframes = np.append(track.keyframes, before + np.flatnonzero(keys))
            track.offsets, track.sizes = np.append(track.offsets, offsets), np.append(track.sizes, sizes)
        return list(self.tracks.values())

    def walk(self, start: int, end: int, near: dict, depth: int) -> None:
        if depth > DEPTH:
            raise Malformed("boxes nest too deeply")
        for kind, at, body, stop in boxes(self.data, start, end):
            if kind == b"trak":
                inner: dict = {"track": Track()}
                self.walk(body, stop, inner, depth + 1)
                _samples(inner)
                self.tracks[inner["track"].track_id] = inner["track"]
            elif kind == b"moof":
                self.walk(body, stop, {"moof": at}, depth + 1)
            elif kind == b"traf":
                self.walk(body, stop, {"moof": _needed(near, "moof", "traf")}, depth + 1)
            elif kind == b"meta" and self.data[body + 4 : body + 8] in (b"hdlr", b"keys", b"ilst"):
                self.walk(body, stop, {}, depth + 1)  # the form without version
            elif kind in NESTED:
                self.walk(body + NESTED[kind], stop, {} if kind in (b"meta", b"udta") else near, depth + 1)
            else:
                self.leaf(kind, _Table(self.data, body, stop), near)

    def leaf(self, kind: bytes, t: _Table, near: dict) -> None:
        track = near.get("track")
        if kind == b"trex":
            t.version()
            number, _, duration, size, flags = t.take(">IIIII")
            self.defaults[number] = duration, size, flags
        elif kind == b"tfhd":
            self.fragment(t, near)
        elif kind == b"trun":
            self.run(t, near)
        elif track is None:
            return
        elif kind == b"tkhd":
            version, _ = t.version()
            track.track_id = t.take(">QQI" if version else ">III")[2]
        elif kind == b"mdhd":
            version, _ = t.version()
            track.timescale = t.take(">QQI" if version else ">III")[2]
            track.duration = t.time(bool(version))
        elif kind == b"hdlr":
            track.handler = t.take(">II4s")[2].decode("latin-1")
        elif kind == b"stsd":
            t.version()
            if t.take(">I")[0]:
                track.codec = t.take(">I4s")[1].decode("latin-1")
        elif kind in (b"stts", b"stsc", b"stss", b"stsz", b"stz2", b"stco", b"co64"):
            near[kind] = _sample_table(kind, t)

    def fragment(self, t: _Table, near: dict) -> None:
        """What a fragment's header says of its samples."""
        start = _needed(near, "moof", "tfhd")
        _, flags = t.version()
        near["id"] = t.take(">I")[0]
        near["base"] = t.take(">Q")[0] if flags & 1 else start
        if near["base"] > len(self.data):
            raise Malformed("a fragment lies outside the file")
        if flags & 2:
            t.take(">I")
        duration, size, sample_flags = self.defaults.get(near["id"], (0, 0, 0))
        near["duration"] = t.take(">I")[0] if flags & 8 else duration
        near["size"] = t.take(">I")[0] if flags & 16 else size
        near["flags"] = t.take(">I")[0] if flags & 32 else sample_flags
        near.pop("next", None)

    def run(self, t: _Table, near: dict) -> None:
        """Adds the samples of a fragment's run."""
        number = _needed(near, "id", "trun")
        track = self.tracks.setdefault(number, Track(number))
        _, flags = t.version()
        (n,) = t.take(">I")
        self.in_runs += n
        if self.in_runs > len(self.data):
            raise Malformed("more samples than the file has bytes")
        start = near["base"] + t.take(">i")[0] if flags & 1 else near.get("next", near["base"])
        first = t.take(">I")[0] if flags & 4 else None
        columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        rows = t.array(n, ">u4", len(columns)).reshape(n, len(columns)) if columns else np.zeros((n, 0), np.int64)
        of = lambda bit, else_: rows[:, columns.index(bit)] if bit in columns else np.full(n, else_, np.int64)
        sizes, marks = of(0x200, near["size"]), of(0x400, near["flags"]).copy()
        if first is not None and n:
            marks[0] = first
        self.runs.setdefault(number, []).append((start + np.cumsum(sizes) - sizes, sizes, marks >> 16 & 1 == 0))
        track.duration = (track.duration or 0) + int(of(0x100, near["duration"]).sum())
        near["next"] = start + int(sizes.sum())


def _needed(near: dict, name: str, kind: str) -> int:
    if name not in near:
        raise Malformed(f"{kind} lies outside the box that it belongs to")
    return near[name]


def _sample_table(kind: bytes, t: _Table) -> np.ndarray | tuple[int, int]:
    t.version()
    if kind == b"stsz":
        size, n = t.take(">II")
        if size * n > len(t.data):
            raise Malformed("more samples than the file holds")
        return (size, n) if size else t.array(n, ">u4")
    if kind == b"stz2":
        bits, n = t.take(">3xBI")
        if bits == 4:
            both = t.array((n + 1) // 2, ">u1")
            return np.stack([both >> 4, both & 15], axis=1).ravel()[:n]
        return t.array(n, ">u1" if bits == 8 else ">u2")
    (n,) = t.take(">I")
    if kind == b"co64":
        return t.array(n, ">u8")
    return t.array(n, ">u4", {b"stts": 2, b"stsc": 3}.get(kind, 1))


def _samples(near: dict) -> None:
    """Turns a track's tables into offsets, sizes and keyframes."""
    track = near["track"]
    sizes = near.get(b"stsz", near.get(b"stz2", np.zeros(0, np.int64)))
    if isinstance(sizes, tuple):
        sizes = np.full(sizes[1], sizes[0], np.int64) if sizes[1] else np.zeros(0, np.int64)
    chunks = near.get(b"co64", near.get(b"stco", np.zeros(0, np.int64)))
    runs = near.get(b"stsc", np.zeros((0, 3), np.int64))
    track.sizes = sizes
    if len(sizes):
        if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks):
            raise Malformed("stsc does not fit the chunks")
        in_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        if in_chunk.sum() != len(sizes):
            raise Malformed("chunks and sizes differ in their number of samples")
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(in_chunk) - in_chunk
        full = in_chunk > 0
        track.offsets = np.repeat(chunks[full] - before[first[full]], in_chunk[full]) + before
    if b"stss" in near:
        track.keyframes = near[b"stss"] - 1
        if len(track.keyframes) and (track.keyframes.min() < 0 or track.keyframes.max() >= len(sizes)):
            raise Malformed("stss names a sample that is not there")
    else:
        track.keyframes = np.arange(len(sizes))
    if track.duration == 0 and b"stts" in near:
        total = sum(n * each for n, each in near[b"stts"].tolist())
        track.duration = total if total < 1 << 63 else None


def payload(data: bytes, track: Track) -> bytes:
    """The bytes of a track's samples, in their order."""
    if not len(track.sizes):
        return b""
    breaks = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    starts = track.offsets[np.append(0, breaks)]
    ends = (track.offsets + track.sizes)[np.append(breaks - 1, len(track.sizes) - 1)]
    if starts.min() < 0 or ends.max() > len(data):
        raise Malformed("samples lie outside the file")
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


# --- columns ----------------------------------------------------------------------

_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TRACK = pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", _RANGES)])
_INDEX = pa.struct([("tracks", pa.list_(_TRACK)), ("error", pa.string())])
#: Types of the columns below.
TRACK = "struct<track_id: long, handler: string, codec: string, timescale: long, duration: long, samples: long, keyframes: array<struct<start: long, end: long>>>"
MEDIA = f"struct<tracks: array<{TRACK}>, error: string>"


def _described(t: Track) -> dict:
    ranges = [{"start": a, "end": b} for a, b in t.key_ranges().tolist()]
    return {"track_id": t.track_id, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "samples": len(t.sizes), "keyframes": ranges}


def read(data: bytes) -> tuple[list[Track], dict]:
    """Tracks of a file and a row of ``MEDIA``; any fault of the bytes is its ``error``."""
    try:
        tracks = index(data)
        return tracks, {"tracks": [_described(t) for t in tracks]}
    except Malformed as e:
        return [], {"error": str(e)}
    except (struct.error, ArithmeticError, LookupError, ValueError) as e:  # whatever else bytes can do to the tables
        return [], {"error": f"{type(e).__name__}: {e}"}


def _stored(data: bytes, tracks: list[Track], number: int) -> bytes | None:
    try:
        return payload(data, tracks[number]) if number < len(tracks) else None
    except Malformed:
        return None


def media_index(data: Column) -> Column:
    """``MEDIA`` of each file: all its tracks, or the ``error`` of bytes that are no ISO
    file, break off or contradict themselves. Null gives null; no byte, no track. Files of
    any length are read by their tables only; equal files give equal rows."""

    @F.arrow_udf(MEDIA)
    def of(cells: pa.Array) -> pa.Array:
        return pa.array([None if x is None else read(x)[1] for x in cells.to_pylist()], _INDEX)

    return of(data)


def text_container(text: Column) -> Column:
    """Each text (null: empty) as UTF-8, padded, in an ISO file. Texts of any length are
    stored whole."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([container(padded((x or "").encode())) for x in texts.to_pylist()], pa.binary())

    return of(text)


def stored_payload(data: Column, number: int = 0) -> Column:
    """The bytes of the samples of one track of each file, the first by default. Null
    where there is no such track, or the bytes are no file that can be read."""

    @F.arrow_udf("binary")
    def of(cells: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _stored(x, read(x)[0], number) for x in cells.to_pylist()], pa.binary())

    return of(data)


def stored_text(text: Column) -> Column:
    """Struct ``media, payload, index``: the file of ``text_container``, its
    ``stored_payload`` and its ``media_index``, made and read once."""

    @F.arrow_udf(f"struct<media: binary, payload: binary, index: {MEDIA}>")
    def of(texts: pa.Array) -> pa.Array:
        media = pa.array((container(padded((x.as_py() or "").encode())) for x in texts), pa.binary())
        parts = [(_stored(x.as_py(), tracks, 0), row) for x in media for tracks, row in [read(x.as_py())]]
        return pa.StructArray.from_arrays([media, pa.array([p for p, _ in parts], pa.binary()), pa.array([r for _, r in parts], _INDEX)], ["media", "payload", "index"])

    return of(text)
