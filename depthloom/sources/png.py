"""Gray PNG files without an imaging library: 8 and 16 bits, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def decode(data: bytes) -> np.ndarray:
    """Rows by columns, uint8 or uint16. ValueError where the file is not such an image."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, header, packed = 8, None, []
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("truncated PNG file")
        at += 12 + size
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    if header is None:
        raise ValueError("PNG file without a header")
    width, height, bits, colour, _, _, interlaced = header
    if colour != 0 or bits not in (8, 16) or interlaced:
        raise ValueError(f"only plain gray PNG of 8 or 16 bits is supported (colour type {colour}, {bits} bits)")
    step = bits // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as error:
        raise ValueError(f"damaged PNG data: {error}") from error
    if len(raw) != height * (width * step + 1):
        raise ValueError("PNG data of the wrong length")
    lines = raw.reshape(height, width * step + 1)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for row in range(height):
        above = out[row] = _unfiltered(int(lines[row, 0]), lines[row, 1:], above, step)
    return out.reshape(height, width) if step == 1 else out.view(">u2").astype(np.uint16).reshape(height, width)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:  # each byte adds the one before it: a running sum per byte of the pixel
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError(f"unknown PNG filter {kind}")
    out, up, given = [0] * len(line), above.tolist(), line.tolist()
    for i, x in enumerate(given):
        left = out[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up[i]) >> 1
        else:
            corner = up[i - step] if i >= step else 0
            near = left + up[i] - corner
            guess = min((abs(near - left), 0, left), (abs(near - up[i]), 1, up[i]), (abs(near - corner), 2, corner))[2]
        out[i] = (x + guess) & 255
    return np.array(out, np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    """PNG of a gray (rows, columns) uint8 or uint16 array, or of an RGB (rows, columns, 3) uint8 one."""
    height, width = pixels.shape[:2]
    bits, colour = (16, 0) if pixels.dtype == np.uint16 else (8, 2 if pixels.ndim == 3 else 0)
    rows = (pixels.astype(">u2") if bits == 16 else pixels.astype(np.uint8)).reshape(height, -1).view(np.uint8)
    body = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")
