"""Images by their bytes: format, size, and a perceptual hash of grey values."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.scratch import ready_workers

# Side of the hashed image and of the frequencies kept; largest file and least sides.
HASH_SIDE, HASH_KEPT = 32, 8
MOST_BYTES, LEAST_SIDE = 10 << 20, 200


def header(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) of a PNG, JPEG or WEBP file, or None."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return ("PNG", *struct.unpack(">II", data[16:24]))
        if data[:2] == b"\xff\xd8":
            at = 2
            while data[at] == 0xFF:
                kind = data[at + 1]
                if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 1:  # fill bytes and markers without a segment
                    at += 1 if kind == 0xFF else 2
                    continue
                size = struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "JPEG", width, height
                at += 2 + size
            return None
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if len(data) < {b"VP8X": 30, b"VP8L": 25}.get(kind, 30):
                return None
            if kind == b"VP8X":
                return "WEBP", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if kind == b"VP8L" and data[20] == 0x2F:
                bits = int.from_bytes(data[21:25], "little")
                return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
                width, height = struct.unpack("<HH", data[26:30])
                return "WEBP", width & 0x3FFF, height & 0x3FFF
    except (IndexError, struct.error):
        pass
    return None


def png_grey(data: bytes) -> np.ndarray | None:
    """Grey values of an 8-bit PNG that isn't interlaced; None for others and damaged ones."""
    try:
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        if depth != 8 or interlaced:
            return None
        body, palette, at = [], None, 8
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"IDAT":
                body.append(data[at + 8 : at + 8 + size])
            elif kind == b"PLTE":
                palette = np.frombuffer(data[at + 8 : at + 8 + size], np.uint8).reshape(-1, 3)
            at += 12 + size
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * channels)
    except (KeyError, ValueError, struct.error, zlib.error):
        return None
    out = np.zeros((height, width * channels), np.uint8)
    before = np.zeros(width * channels, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 2:
            line = line + before
        elif kind == 1:
            line = np.add.accumulate(line.reshape(width, channels), axis=0, dtype=np.uint8).ravel()
        elif kind in (3, 4):
            line = _unfilter(kind, line.tolist(), before.tolist(), channels)
        out[y] = before = line
    if colour == 3:
        if palette is None or out.max() >= len(palette):
            return None
        rgb = palette[out].astype(float)
    else:
        rgb = out.reshape(height, width, channels).astype(float)
        if channels < 3:
            return rgb[..., 0]
    return rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114


def _unfilter(kind: int, line: list[int], before: list[int], step: int) -> np.ndarray:
    """The filters whose bytes depend on their left neighbours in a way that has no running sum."""
    for i in range(len(line)):
        left, up, corner = (line[i - step], before[i], before[i - step]) if i >= step else (0, before[i], 0)
        if kind == 3:
            guess = (left + up) // 2
        else:
            far = [(abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner)]
            guess = min(far)[2]
        line[i] = line[i] + guess & 0xFF
    return np.array(line, np.uint8)


def phash(grey: np.ndarray) -> str:
    """16 hexadecimal digits: of the lowest 8 x 8 cosine frequencies of the image at 32 x 32, which lie above their median."""
    rows, columns = (np.linspace(0, n, HASH_SIDE + 1) for n in grey.shape)

    def areas(n: int, edges: np.ndarray) -> np.ndarray:
        cover = np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n))
        cover = np.maximum(cover, 0)
        return cover / cover.sum(axis=1, keepdims=True)

    small = areas(grey.shape[0], rows) @ grey @ areas(grey.shape[1], columns).T
    k, x = np.arange(HASH_KEPT)[:, None], np.arange(HASH_SIDE)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / (2 * HASH_SIDE))
    low = (basis @ small @ basis.T).ravel()
    bits = low > np.median(low)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def valid_images(files: DataFrame, most: int = MOST_BYTES, least: int = LEAST_SIDE, grey: Callable[[bytes], np.ndarray | None] = png_grey) -> DataFrame:
    """Files (content, ...) that are PNG, JPEG or WEBP, of at most ``most`` bytes and at least ``least`` pixels a side; adds format, width, height and phash.

    ``grey`` decodes the pixels; what it can't decode has a null phash, so decoders for more formats may be plugged in.
    """
    ready_workers(files.sparkSession)

    @F.pandas_udf("format string, width int, height int, phash string")
    def look(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for data in contents:
            found = header(bytes(data)) if data is not None else None
            pixels = grey(bytes(data)) if found and min(found[1:]) >= least else None
            rows.append((*(found or (None, None, None)), phash(pixels) if pixels is not None else None))
        return pd.DataFrame(rows, columns=["format", "width", "height", "phash"]).astype({"width": "Int32", "height": "Int32"})

    rows = files.where(F.octet_length("content") <= most).withColumn("found", look("content"))
    return rows.where((F.col("found.width") >= least) & (F.col("found.height") >= least)).select(*files.columns, "found.*")
