"""Drawn pages as arrays of pixels: read from PNG, cleaned for recognition, and looked over for plain areas."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.runtime import map_arrow
from pagemill.sources.pdf import _predicted

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def read_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a PNG picture of 8 bits a channel that is not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG picture")
    width, height, depth, kind, _, _, woven = struct.unpack(">IIBBBBB", data[16:29])
    if depth != 8 or woven or kind not in _CHANNELS:
        raise ValueError("a kind of PNG picture that is not read")
    packed, at = b"", 8
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        packed += data[at + 8 : at + 8 + size] if name == b"IDAT" else b""
        at += 12 + size
    channels = _CHANNELS[kind]
    raw = _predicted(zlib.decompress(packed), {"Predictor": 15, "Colors": channels, "Columns": width})
    return np.frombuffer(raw, np.uint8).reshape(height, width, channels)


def write_png(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    kind = {1: 0, 3: 2, 2: 4, 4: 6}[channels]
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def masked(pixels: np.ndarray, boxes: list[tuple[float, float, float, float]], page: tuple[float, float], margin: float = 1.0) -> np.ndarray:
    """Pixels with white over boxes (x, y, width, height in points) of text that need not be recognised, a point wider on each side."""
    out = pixels.copy()
    sx, sy = pixels.shape[1] / page[0], pixels.shape[0] / page[1]
    for x, y, w, h in boxes:
        x0, y0 = max(0, int(np.floor((x - margin) * sx))), max(0, int(np.floor((y - margin) * sy)))
        out[y0 : max(y0, int(np.ceil((y + h + margin) * sy))), x0 : max(x0, int(np.ceil((x + w + margin) * sx)))] = 255
    return out


def despeckled(pixels: np.ndarray) -> np.ndarray:
    """Pixels with single dark or light dots replaced by the median of their neighbourhood of nine."""
    wide = np.pad(pixels, ((1, 1), (1, 1), (0, 0)), "edge")
    height, width = pixels.shape[:2]
    around = np.stack([wide[i : i + height, j : j + width] for i in range(3) for j in range(3)])
    middle = np.median(around, 0).astype(np.uint8)
    others = np.delete(around, 4, 0).astype(np.int16)
    alone = (np.abs(others - pixels) > 96).all(0)
    return np.where(alone, middle, pixels)


def plain_rectangles(pixels: np.ndarray, least: int = 24) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of areas of one colour other than the page's most common one, at least so many pixels on each side: equal
    runs of rows that lie one below the other."""
    code = np.zeros(pixels.shape[:2], np.int64)
    for c in range(pixels.shape[2]):
        code = code << 8 | pixels[:, :, c]
    values, counts = np.unique(code, return_counts=True)
    ground = values[counts.argmax()]
    held: dict[tuple[int, int, int], int] = {}
    out = []
    for y in range(len(code) + 1):
        runs = set()
        if y < len(code):
            row = code[y]
            edges = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)]])
            runs = {(a, b, int(row[a])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b - a >= least and row[a] != ground}
        for run, top in list(held.items()):
            if run not in runs:
                if y - top >= least:
                    out.append((run[0], top, run[1] - run[0], y - top))
                del held[run]
        for run in runs:
            held.setdefault(run, y)
    return sorted(out, key=lambda r: (r[1], r[0]))


def page_rasters(images: DataFrame) -> DataFrame:
    """(doc_id, page, width, height, solid, rectangles, error) of drawn pages (doc_id, page, content): whether a page is one colour, and its
    plain rectangles as [x, y, width, height]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(2).to_pylist():
                try:
                    pixels = read_png(content or b"")
                    solid = bool((pixels == pixels[0, 0]).all())
                    rows.append((pixels.shape[1], pixels.shape[0], solid, [list(r) for r in plain_rectangles(pixels)], None))
                except Exception as e:  # noqa: BLE001 - a picture's failure is its own
                    rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.list_(pa.int32())), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "page", "width", "height", "solid", "rectangles", "error"])

    return map_arrow(images.select("doc_id", "page", "content"), run, "doc_id long, page int, width int, height int, solid boolean, rectangles array<array<int>>, error string")
