"""Media columns from ISO media containers, without decoding payloads.

``read_tracks`` walks the nested boxes of a file, decodes the sample tables of each track (sizes,
chunk offsets, samples to chunks, times and sync samples) and gives its codec, duration and the
byte ranges of its samples and keyframes. ``write_container`` stores bytes losslessly as 8-bit
frames of 192 samples, so that the reader can be held against known payloads.

Defined results: ``text_media`` stores a null or empty text as one frame of spaces. ``read_tracks`` and
``read_container`` raise ``ValueError`` with the box at fault. ``media_columns`` raises nothing: a file that
cannot be read, null and empty ones too, gives one row with its status ("empty" or "damaged"), a message
and nulls. Tables are never longer than their boxes allow, boxes nest to ``MAX_DEPTH``. Rows are independent.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import in_arrow

FRAME = 192  # bytes in a frame: 16 x 12 samples of 8 bits
KEY_EVERY = 8
MAX_DEPTH = 32
TIMESCALE = 600
PER_CHUNK = 16
#: Boxes that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _u32(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


_MATRIX = _u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_container(payload: bytes) -> bytes:
    """An ISO media file with one raw video track; ``payload`` is a positive multiple of 192 bytes."""
    n = len(payload) // FRAME
    if not n or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    file_type = _box(b"ftyp", b"qt  ", _u32(0x200), b"qt  ", b"isom")
    chunks = -(-n // PER_CHUNK)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 16, 12), _u32(0x480000, 0x480000, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 40, -1))
    runs = [(1, PER_CHUNK, 1)] if n >= PER_CHUNK else []
    if n % PER_CHUNK:
        runs.append((chunks, n % PER_CHUNK, 1))
    keys = range(1, n + 1, KEY_EVERY)

    def movie(data_at: int) -> bytes:
        offsets = [data_at + k * PER_CHUNK * FRAME for k in range(chunks)]
        table = _box(
            b"stbl",
            _full(b"stsd", _u32(1), entry),
            _full(b"stts", _u32(1, n, 20)),
            _full(b"stss", _u32(len(keys), *keys)),
            _full(b"stsc", _u32(len(runs), *(x for r in runs for x in r))),
            _full(b"stsz", _u32(FRAME, n)),
            _full(b"stco", _u32(chunks, *offsets)) if offsets[-1] < 2**32 else _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets)),
        )
        length = 20 * n
        info = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", _u32(1), _full(b"url ", flags=1))), table)
        media = _box(b"mdia", _full(b"mdhd", _u32(0, 0, TIMESCALE, length, 0)), _full(b"hdlr", _u32(0), b"vide", bytes(12), b"\0"), info)
        header = _full(b"tkhd", _u32(0, 0, 1, 0, length, 0, 0, 0, 0), _MATRIX, _u32(16 << 16, 12 << 16), flags=3)
        return _box(b"moov", _full(b"mvhd", _u32(0, 0, TIMESCALE, length, 0x10000, 0x1000000, 0, 0), _MATRIX, bytes(24), _u32(2)), _box(b"trak", header, media))

    at = len(file_type) + len(movie(0)) + 8
    return file_type + movie(at) + _box(b"mdat", payload)


def walk(data: bytes):
    """(path, body start, body end) of every box, outer ones first; bodies are not copied."""
    open_ = [(0, len(data), ())]  # what is left of each box that is being walked
    while open_:
        start, end, path = open_.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError(f"{end - start} stray bytes after the boxes of {path}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"box {kind!r} at {start} is cut")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}")
        own = (*path, kind)
        if len(own) > MAX_DEPTH:
            raise ValueError(f"boxes nest deeper than {MAX_DEPTH}")
        yield own, start + head, start + size
        open_.append((start + size, end, path))
        if kind in CONTAINERS:
            open_.append((start + head, start + size, own))


def read_tracks(data: bytes) -> list[dict]:
    """codec, duration (seconds), n_samples, and (offset, size) of all samples and of keyframes of each track, in the file's order."""
    if not data:
        raise ValueError("no bytes")
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, lo, hi in walk(data):
        if path[-1] == b"trak":
            tracks.append({})
        elif b"trak" in path:
            tracks[-1].setdefault(path[-1], (lo, hi))
    if not tracks:
        raise ValueError("no box b'trak'")
    return [_Track(data, found).read() for found in tracks]


def read_container(data: bytes) -> dict:
    """The first track of ``read_tracks``."""
    return read_tracks(data)[0]


class _Track:
    """The sample tables of one track; every read is held against its box."""

    def __init__(self, data: bytes, found: dict):
        self.data, self.found = data, found

    def at(self, kind: bytes, offset: int, form: str) -> tuple:
        """Values at an offset in a box's body."""
        if kind not in self.found:
            raise ValueError(f"no box {kind!r}")
        lo, hi = self.found[kind]
        if lo + offset + struct.calcsize(form) > hi:
            raise ValueError(f"table {kind!r} is cut")
        return struct.unpack_from(form, self.data, lo + offset)

    def table(self, kind: bytes, width: int = 1, letter: str = "I") -> list:
        if kind not in self.found:
            return []
        n = self.at(kind, 4, ">I")[0] * width
        lo, hi = self.found[kind]
        if lo + 8 + n * struct.calcsize(f">{letter}") > hi:
            raise ValueError(f"table {kind!r} is cut")
        flat = self.at(kind, 8, f">{n}{letter}")
        return [flat[i : i + width] for i in range(0, n, width)] if width > 1 else list(flat)

    def sizes(self) -> list[int]:
        """Sample sizes, from ``stsz`` or the compact ``stz2``; times and chunks tell how many a fixed size has."""
        if b"stsz" in self.found:
            fixed, n = self.at(b"stsz", 4, ">II")
            if not fixed:
                lo, hi = self.found[b"stsz"]
                if lo + 12 + 4 * n > hi:
                    raise ValueError("table b'stsz' is cut")
                return list(self.at(b"stsz", 12, f">{n}I"))
            if n * fixed > len(self.data):
                raise ValueError(f"{n} samples of {fixed} bytes are more than the file")
            return [fixed] * n
        bits, n = self.at(b"stz2", 7, ">BI")
        if bits not in (4, 8, 16):
            raise ValueError(f"table b'stz2' has fields of {bits} bits")
        lo, hi = self.found[b"stz2"]
        if lo + 12 + -(-n * bits // 8) > hi:
            raise ValueError("table b'stz2' is cut")
        if bits == 4:
            return [self.data[lo + 12 + k // 2] >> (0 if k % 2 else 4) & 15 for k in range(n)]
        return list(self.at(b"stz2", 12, f">{n}{'B' if bits == 8 else 'H'}"))

    def samples(self, sizes: list[int]) -> list[tuple[int, int]]:
        offsets = self.table(b"stco") or self.table(b"co64", letter="Q")
        runs, out = self.table(b"stsc", 3), []
        for k, (first, per, _) in enumerate(runs):
            last = runs[k + 1][0] if k + 1 < len(runs) else len(offsets) + 1
            if not 1 <= first <= last <= len(offsets) + 1:
                raise ValueError(f"chunks {first} to {last - 1} of {len(offsets)}")
            for chunk in range(first, last):
                at = offsets[chunk - 1]
                for size in sizes[len(out) : len(out) + per]:
                    out.append((at, size))
                    at += size
        if len(out) != len(sizes):
            raise ValueError(f"chunks hold {len(out)} samples of {len(sizes)}")
        return out

    def read(self) -> dict:
        version = self.at(b"mdhd", 0, ">B")[0]
        scale, length = self.at(b"mdhd", 20, ">IQ") if version == 1 else self.at(b"mdhd", 12, ">II")
        codec = self.at(b"stsd", 12, ">4s")[0].decode("latin-1")
        samples = self.samples(self.sizes())
        n = len(samples)
        keys = self.table(b"stss") if b"stss" in self.found else range(1, n + 1)
        if bad := [k for k in keys if not 1 <= k <= n]:
            raise ValueError(f"keyframe {bad[0]} of {n} samples")
        ticks = sum(a * b for a, b in self.table(b"stts", 2))
        return {"codec": codec, "duration": length / scale if scale else 0.0, "ticks": ticks, "n_samples": n, "samples": samples, "keyframes": [samples[k - 1] for k in keys]}


def payload_of(text: str | None) -> bytes:
    """A text's UTF-8 with spaces up to a positive multiple of 192 bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * ((-len(raw)) % FRAME if raw else FRAME)


def _columns(batches):
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), ranges, pa.string(), pa.string()]
    names = ["id", "track", "codec", "duration", "n_samples", "keyframes", "status", "message"]
    for b in batches:
        out = []
        for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):  # one file at a time leaves the Arrow batch
            try:
                tracks = read_tracks(data.as_py() or b"")
            except ValueError as e:
                out.append((i, None, None, None, None, None, "empty" if not data.as_py() else "damaged", str(e)))
                continue
            for k, m in enumerate(tracks):
                out.append((i, k + 1, m["codec"], m["duration"], m["n_samples"], [{"offset": o, "size": s} for o, s in m["keyframes"]], "ok", None))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def media_columns(files: DataFrame, file_id: str, content: str) -> DataFrame:
    """id, track (1, 2, ... in the file's order), codec, duration, n_samples, keyframe byte ranges, status and message.

    One row a track of container bytes; one row for a file without any that can be read.
    """
    schema = "id long, track int, codec string, duration double, n_samples long, keyframes array<struct<offset:bigint,size:bigint>>, status string, message string"
    return in_arrow(files.select(F.col(file_id).cast("long"), F.col(content).cast("binary")), _columns, schema)


def _round_trip(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            media = write_container(payload_of(text))
            m = read_container(media)
            back = b"".join(media[o : o + s] for o, s in m["samples"])
            keys = zlib.crc32(",".join(f"{o}+{s}" for o, s in m["keyframes"]).encode())
            feature = f"{m['codec'].strip()} {m['duration']:.4f}s {m['n_samples']} samples {len(m['keyframes'])} keyframes {keys:08x} {zlib.crc32(back):08x}"
            rows.append((i, len((text or "").encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored in a container and read back: sizes, digests and the media columns as ``feature``."""
    return in_arrow(
        docs.select(F.col(doc_id).cast("long"), text), _round_trip, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
