"""Raster images of the PNG format, 8 bits a channel and not interlaced, as arrays and back."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type (fixed values of the format).
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at:at + 8])
        yield kind, data[at + 8:at + 8 + size]
        at += size + 12


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of unsigned bytes; ValueError for what is no such image."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    head, packed = None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("only images of 8 bits a channel that are not interlaced")
    width, height, channels = head[0], head[1], CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (1 + width * channels):
        raise ValueError("an image that is not whole")
    rows = raw.reshape(height, -1)
    return unfiltered(rows[:, 0], rows[:, 1:].reshape(height, width, channels))


def unfiltered(filters: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the five row filters. A byte needs those to its left, above, and above left: all of one diagonal need only
    the two diagonals before, so a diagonal at a time is worked out, rows of every filter at once."""
    if filters.max(initial=0) > 4:
        raise ValueError("an unknown row filter")
    height, width, channels = rows.shape
    out = np.zeros((height + 1, width + 1, channels), np.int32)  # a row and a column of zeros in front
    if (filters <= 2).all() and not (filters == 1).any():  # none or up: sums of rows
        start = np.flatnonzero(filters == 0)
        for a, b in zip([0, *start], [*start, height], strict=True):
            out[a + 1:b + 1, 1:] = np.cumsum(rows[a:b], axis=0, dtype=np.int32) & 255
        return out[1:, 1:].astype(np.uint8)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        f = filters[y][:, None]
        guess = left + up - corner
        a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[y + 1, x + 1] = (rows[y, x] + np.select([f == 1, f == 2, f == 3, f == 4], [left, up, (left + up) >> 1, paeth], 0)) & 255
    return out[1:, 1:].astype(np.uint8)


def encode(pixels: np.ndarray, filters: list[int] | None = None) -> bytes:
    """A PNG file of (height, width, 1 to 4 channels), each row under its filter (none by default)."""
    height, width, channels = pixels.shape
    p = pixels.astype(np.int32)
    left, up, corner = np.zeros_like(p), np.zeros_like(p), np.zeros_like(p)
    left[:, 1:], up[1:], corner[1:, 1:] = p[:, :-1], p[:-1], p[:-1, :-1]
    guess = left + up - corner
    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
    by = [np.zeros_like(p), left, up, (left + up) >> 1, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))]
    filters = filters or [0] * height
    raw = b"".join(bytes([f]) + ((p[y] - by[f][y]) & 255).astype(np.uint8).tobytes() for y, f in enumerate(filters))
    kind = {n: t for t, n in CHANNELS.items()}[channels]
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
