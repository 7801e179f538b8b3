"""TIFF images: a BigTIFF writer of tiled planes with pyramids in SubIFDs, and a reader of TIFF and BigTIFF.

Planes are written one after the other; only one plane is held at a time. They can also be compressed
elsewhere, each into a file of its own, and put together by copying. Compression is none, LZW (written
here) or zstd; the reader takes deflate as well, either byte order, tiles or strips, and horizontal
differences.
"""

from __future__ import annotations

import io
import os
import shutil
import struct
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import zstandard

#: TIFF tags, field types and compression numbers.
NEW_SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, SAMPLES = 254, 256, 257, 258, 259, 262, 270, 277
STRIP_OFFSETS, ROWS_PER_STRIP, STRIP_COUNTS = 273, 278, 279
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SUB_IFDS, SAMPLE_FORMAT = 322, 323, 324, 325, 330, 339
PREDICTOR = 317
ASCII, SHORT, LONG, IFD, LONG8, IFD8 = 2, 3, 4, 13, 16, 18
SIZES = {1: 1, ASCII: 1, SHORT: 2, LONG: 4, IFD: 4, LONG8: 8, IFD8: 8, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 17: 8}
CODES = {1: "B", ASCII: "c", SHORT: "H", LONG: "I", IFD: "I", LONG8: "Q", IFD8: "Q"}
COMPRESSIONS = {"none": 1, "lzw": 5, "zstd": 50000}
DEFLATE = (8, 32946)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, the width growing one code early."""
    out, bits, held = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, following = 9, 258

    def put(code: int) -> None:
        nonlocal bits, held
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(table[word] if len(word) > 1 else word[0])
        table[longer] = following
        following += 1
        if following == 4095:
            put(256)
            table.clear()
            width, following = 9, 258
        elif following in (511, 1023, 2047):
            width += 1
        word = data[k : k + 1]
    if word:
        put(table[word] if len(word) > 1 else word[0])
        following += 1
        if following in (511, 1023, 2047):
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, table, width, last = bytearray(), [], 9, b""
    held = bits = 0
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 256:
            table, width, last = [], 9, b""
            continue
        if code == 257:
            break
        if code < 256:
            word = bytes([code])
        elif code - 258 < len(table):
            word = table[code - 258]
        elif code - 258 == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("damaged LZW data")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        # The writer's table is one entry ahead of this one.
        width = 9 + sum(len(table) + 259 >= n for n in (511, 1023, 2047)) if len(table) + 259 < 4096 else 12
    return bytes(out)


def compress(data: bytes, compression: str) -> bytes:
    if compression == "zstd":
        return zstandard.ZstdCompressor(level=3).compress(data)
    return lzw_encode(data) if compression == "lzw" else data


def decompress(data: bytes, code: int) -> bytes:
    if code == COMPRESSIONS["zstd"]:
        return zstandard.ZstdDecompressor().decompress(data)
    if code == COMPRESSIONS["lzw"]:
        return lzw_decode(data)
    if code in DEFLATE:
        return zlib.decompress(data)
    if code != COMPRESSIONS["none"]:
        raise ValueError(f"compression {code} is not supported")
    return data


def compression_name(name: str | None) -> str:
    key = (name or "none").lower()
    if key not in COMPRESSIONS:
        raise ValueError(f"compression must be zstd, LZW or None, not {name!r}")
    return key


def blocks(plane: np.ndarray, compression: str, tile: int | None) -> Iterator[bytes]:
    """The compressed tiles of a plane, or the plane as one strip."""
    plane = np.ascontiguousarray(plane.astype(plane.dtype.newbyteorder("<")))
    if not tile:
        yield compress(plane.tobytes(), compression)
        return
    for y in range(0, max(1, plane.shape[0]), tile):
        for x in range(0, max(1, plane.shape[1]), tile):
            block = np.zeros((tile, tile), plane.dtype)
            part = plane[y : y + tile, x : x + tile]
            block[: part.shape[0], : part.shape[1]] = part
            yield compress(block.tobytes(), compression)


class BigTiffWriter:
    """Appends planes to a file; links each directory from the one before."""

    def __init__(self, file: io.BufferedIOBase, compression: str = "zstd", tile: int | None = 256):
        self.file, self.compression, self.tile = file, compression_name(compression), tile
        file.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        self.link = 8

    def _directory(self, shape, dtype: np.dtype, offsets: list[int], counts: list[int], description: str | None, reduced: bool, subs: list[int]) -> int:
        """Writes a directory; gives its offset."""
        tags = {
            NEW_SUBFILE: (LONG, [int(reduced)]), WIDTH: (LONG, [shape[1]]), HEIGHT: (LONG, [shape[0]]), BITS: (SHORT, [8 * dtype.itemsize]), COMPRESSION: (SHORT, [COMPRESSIONS[self.compression]]),
            PHOTOMETRIC: (SHORT, [1]), SAMPLES: (SHORT, [1]), SAMPLE_FORMAT: (SHORT, [3 if dtype.kind == "f" else 1]),
        }
        if self.tile:
            tags |= {TILE_WIDTH: (LONG, [self.tile]), TILE_HEIGHT: (LONG, [self.tile]), TILE_OFFSETS: (LONG8, offsets), TILE_COUNTS: (LONG8, counts)}
        else:
            tags |= {STRIP_OFFSETS: (LONG8, offsets), ROWS_PER_STRIP: (LONG, [shape[0]]), STRIP_COUNTS: (LONG8, counts)}
        if description is not None:
            tags[DESCRIPTION] = (ASCII, description.encode("utf-8") + b"\0")
        if subs:
            tags[SUB_IFDS] = (IFD8, subs)
        entries = []
        for tag in sorted(tags):
            kind, values = tags[tag]
            raw = values if kind == ASCII else struct.pack(f"<{len(values)}{CODES[kind]}", *values)
            if len(raw) > 8:
                self.file.write(b"\0" * (-self.file.tell() % 8))
                at = self.file.tell()
                self.file.write(raw)
                raw = struct.pack("<Q", at)
            entries.append(struct.pack("<HHQ", tag, kind, len(values)) + raw.ljust(8, b"\0"))
        self.file.write(b"\0" * (-self.file.tell() % 8))
        start = self.file.tell()
        self.file.write(struct.pack("<Q", len(entries)) + b"".join(entries) + struct.pack("<Q", 0))
        return start

    def append(self, levels: list[tuple[tuple[int, int], list[int]]], dtype: np.dtype, source: io.BufferedIOBase, description: str | None = None) -> None:
        """One plane with its smaller levels, which become SubIFDs: (shape, sizes of its blocks) of each, and the blocks one after the other."""
        at = self.file.tell()
        shutil.copyfileobj(source, self.file, 1 << 20)
        ends = at + np.cumsum([n for _, counts in levels for n in counts])
        offsets, k = [], 0
        for _, counts in levels:
            offsets.append([int(e) - n for e, n in zip(ends[k : k + len(counts)], counts, strict=True)])
            k += len(counts)
        subs = [self._directory(shape, dtype, own, counts, None, True, []) for (shape, counts), own in zip(levels[1:], offsets[1:], strict=True)]
        start = self._directory(levels[0][0], dtype, offsets[0], levels[0][1], description, False, subs)
        end = self.file.tell()
        self.file.seek(self.link)
        self.file.write(struct.pack("<Q", start))
        self.file.seek(end)
        self.link = end - 8


def write_blocks(levels: list[np.ndarray], file: io.BufferedIOBase, compression: str, tile: int | None = 256) -> list[tuple[tuple[int, int], list[int]]]:
    """Compresses a plane and its levels into a file of their blocks alone; gives what ``append`` takes."""
    out = []
    for p in levels:
        counts = []
        for data in blocks(p, compression_name(compression), tile):
            counts.append(len(data))
            file.write(data)
        out.append((p.shape, counts))
    return out


def strided_levels(plane: np.ndarray, levels: int) -> list[np.ndarray]:
    return [plane[:: 1 << k, :: 1 << k] for k in range(levels)]


def write_tiff(path: str, planes: Iterable[np.ndarray], description: str, compression: str = "zstd", levels: int = 1, tile: int | None = 256) -> None:
    """Writes beside ``path`` and renames, so that a lost task leaves no half file."""
    part = f"{path}.part-{os.getpid()}"
    try:
        with open(part, "wb") as f:
            writer = BigTiffWriter(f, compression, tile)
            for k, plane in enumerate(planes):
                with tempfile.SpooledTemporaryFile(64 << 20) as held:
                    made = write_blocks(strided_levels(plane, levels), held, compression, tile)
                    held.seek(0)
                    writer.append(made, plane.dtype, held, description if k == 0 else None)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


@dataclass
class Page:
    tags: dict
    data: io.BufferedIOBase
    order: str = "<"
    subs: list = field(default_factory=list)

    @property
    def shape(self) -> tuple[int, int]:
        return self.tags[HEIGHT][0], self.tags[WIDTH][0]

    @property
    def dtype(self) -> np.dtype:
        letter = {1: "u", 2: "i", 3: "f"}[self.tags.get(SAMPLE_FORMAT, [1])[0]]
        return np.dtype(f"{self.order}{letter}{self.tags[BITS][0] // 8}")

    @property
    def description(self) -> str | None:
        raw = self.tags.get(DESCRIPTION)
        return raw.rstrip(b"\0").decode("utf-8") if raw is not None else None

    def asarray(self) -> np.ndarray:
        height, width = self.shape
        if self.tags.get(SAMPLES, [1])[0] != 1:
            raise ValueError("only planes of one sample a pixel are read")
        tiled = TILE_OFFSETS in self.tags
        offsets, counts = self.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], self.tags[TILE_COUNTS if tiled else STRIP_COUNTS]
        th, tw = (self.tags[TILE_HEIGHT][0], self.tags[TILE_WIDTH][0]) if tiled else (min(height, self.tags.get(ROWS_PER_STRIP, [height])[0]), width)
        differences = self.tags.get(PREDICTOR, [1])[0]
        if differences not in (1, 2):
            raise ValueError(f"predictor {differences} is not supported")
        out, across = np.zeros((height, width), self.dtype), -(-width // tw)
        for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
            self.data.seek(at)
            y, x = k // across * th, k % across * tw
            rows = th if tiled else min(th, height - y)
            raw = np.frombuffer(decompress(self.data.read(n), self.tags.get(COMPRESSION, [1])[0]), self.dtype)[: rows * tw].reshape(rows, tw)
            if differences == 2:
                raw = np.cumsum(raw, axis=1, dtype=self.dtype.newbyteorder("="))
            out[y : y + rows, x : x + tw] = raw[: height - y, : width - x]
        return out


def read_pages(f: io.BufferedIOBase) -> list[Page]:
    """Directories of a TIFF or BigTIFF, with their SubIFDs; pixels are read on demand."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order and len(head) >= 8 else 0
    if version not in (42, 43) or (version == 43 and len(head) < 16):
        raise ValueError("no TIFF")
    big = version == 43
    offset, number, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    inline = struct.calcsize(offset)

    def page(at: int) -> tuple[Page, int]:
        f.seek(at)
        n = struct.unpack(order + number, f.read(struct.calcsize(number)))[0]
        raw = f.read(entry * n + inline)
        tags: dict = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HH{offset}", raw, entry * k)
            size = SIZES.get(kind, 1) * count
            value = raw[entry * (k + 1) - inline : entry * (k + 1)]
            if size > inline:
                f.seek(struct.unpack(order + offset, value)[0])
                value = f.read(size)
            tags[tag] = list(struct.unpack(f"{order}{count}{CODES[kind]}", value[:size])) if kind in CODES and kind not in (1, ASCII) else value[:size]
        own = Page(tags, f, order)
        own.subs = [page(s)[0] for s in tags.get(SUB_IFDS, [])]
        return own, struct.unpack_from(order + offset, raw, entry * n)[0]

    out, seen, at = [], set(), struct.unpack_from(order + offset, head, 8 if big else 4)[0]
    while at and at not in seen:
        seen.add(at)
        own, at = page(at)
        out.append(own)
    return out
