"""PNG files: written from 8-bit arrays, sizes from the header, and region outlines drawn on top."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(image: np.ndarray) -> bytes:
    """8-bit grey, grey and alpha, RGB or RGBA, by the last axis."""
    image = np.ascontiguousarray(image, np.uint8)
    if image.ndim == 2:
        image = image[:, :, None]
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[image.shape[2]]
    height, width, depth = image.shape
    rows = np.zeros((height, 1 + width * depth), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_size(data: bytes) -> tuple[int, int] | None:
    return struct.unpack(">II", data[16:24]) if data[:8] == SIGNATURE and len(data) >= 24 else None


def _unfilter(rows: np.ndarray, depth: int) -> np.ndarray:
    """Undoes the five row filters; ``rows`` have the filter's number first."""
    out = rows[:, 1:].copy()
    above = np.zeros(out.shape[1], np.uint8)
    for kind, row in zip(rows[:, 0].tolist(), out, strict=True):
        if kind == 1:
            row[:] = np.cumsum(row.reshape(-1, depth), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            have, up = row.tolist(), above.tolist()
            for x in range(len(have)):
                left = have[x - depth] if x >= depth else 0
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    corner = up[x - depth] if x >= depth else 0
                    near = [(abs(up[x] - corner), 0, left), (abs(left - corner), 1, up[x]), (abs(left + up[x] - 2 * corner), 2, corner)]
                    guess = min(near)[2]
                have[x] = have[x] + guess & 255
            row[:] = have
        elif kind:
            raise ValueError(f"row filter {kind} is not known")
        above = row
    return out


def read_png(data: bytes) -> np.ndarray:
    """Arrays (height, width, 1 to 4) from files of 8 bits without interlace: grey, grey and alpha, RGB, RGBA, palette (as RGB)."""
    if png_size(data) is None:
        raise ValueError("no PNG signature")
    at, parts = 8, {b"IHDR": b"", b"PLTE": b"", b"IDAT": b""}
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind in parts:
            parts[kind] += data[at + 8 : at + 8 + size]
        at += 12 + size
    width, height, bits, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if bits != 8 or depth is None or interlace:
        raise ValueError("only 8-bit PNGs without interlace are read")
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, 1 + width * depth)
    image = _unfilter(rows, depth).reshape(height, width, depth)
    return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[image[:, :, 0]] if colour == 3 else image


def draw_line(image: np.ndarray, start, end, colour, width: int) -> None:
    steps = int(max(abs(end[0] - start[0]), abs(end[1] - start[1]), 1)) + 1
    xs, ys = (np.rint(np.linspace(a, b, steps)).astype(int) for a, b in zip(start, end, strict=True))
    for dy in range(-(width // 2), width - width // 2):
        for dx in range(-(width // 2), width - width // 2):
            x, y = xs + dx, ys + dy
            ok = (x >= 0) & (y >= 0) & (x < image.shape[1]) & (y < image.shape[0])
            image[y[ok], x[ok], :3] = colour


def draw_overlay(image: np.ndarray, regions: list[dict]) -> np.ndarray:
    """Outlines and filled label boxes: dicts with points, colour, line_width, font_size, centre and name.

    There is no font here: a box is as wide as its name would be, and names go to a label table.
    """
    out = (np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] < 3 else image).copy()
    for r in regions:
        colour = [int(r["colour"][k : k + 2], 16) for k in (1, 3, 5)]
        for a, b in zip(r["points"], [*r["points"][1:], *r["points"][:1]], strict=True):
            draw_line(out, a, b, colour, r["line_width"])
        w, h = 0.6 * r["font_size"] * len(r["name"]) / 2 + 4, r["font_size"] / 2 + 4
        x0, x1, y0, y1 = (max(0, int(v)) for v in (r["centre"][0] - w, r["centre"][0] + w, r["centre"][1] - h, r["centre"][1] + h))
        out[y0 : y1 + 1, x0 : x1 + 1, :3] = colour
    return out
