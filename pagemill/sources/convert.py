"""Other formats as PDF: pictures are wrapped here, office files by an external program."""

from __future__ import annotations

import os
import shutil
import struct
import subprocess
import tempfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import map_arrow

#: Resolution of pictures that don't say theirs.
DPI = 150.0


def picture_size(data: bytes) -> tuple[int, int, float, float]:
    """Pixels and resolution across and down of a JPEG or PNG picture."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        width, height = struct.unpack(">II", data[16:24])
        at = data.find(b"pHYs", 8, 1 << 16)
        if at > 0 and data[at + 12] == 1:
            return width, height, *(v * 0.0254 for v in struct.unpack(">II", data[at + 4 : at + 12]))
        return width, height, DPI, DPI
    if data[:2] == b"\xff\xd8":
        at, across, down = 2, DPI, DPI
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if kind == 0xE0 and data[at + 4 : at + 9] == b"JFIF\0":
                unit, x, y = data[at + 11], *struct.unpack(">HH", data[at + 12 : at + 16])
                if unit in (1, 2) and x and y:
                    across, down = (x, y) if unit == 1 else (x * 2.54, y * 2.54)
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height, float(across), float(down)
            at += 2 + size
    raise ValueError("no JPEG or PNG picture")


def _image(data: bytes) -> tuple[bytes, bytes]:
    """Facts and bytes of a picture as a stream of a PDF file."""
    width, height, _, _ = picture_size(data)
    if data[:2] == b"\xff\xd8":
        at = 2
        while data[at + 1] not in (0xC0, 0xC1, 0xC2):
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        space = {1: b"/DeviceGray", 3: b"/DeviceRGB", 4: b"/DeviceCMYK"}[data[at + 9]]
        return b"/Width %d /Height %d /BitsPerComponent 8 /ColorSpace %s /Filter /DCTDecode" % (width, height, space), data
    depth, kind, _, _, woven = data[24:29]
    if kind not in (0, 2) or woven or depth != 8:
        raise ValueError("only plain gray and colour PNG pictures of 8 bits can be wrapped")
    packed, at = b"", 8
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        packed += data[at + 8 : at + 8 + size] if name == b"IDAT" else b""
        at += 12 + size
    colors = 3 if kind == 2 else 1
    space = b"/DeviceRGB" if kind == 2 else b"/DeviceGray"
    return b"/Width %d /Height %d /BitsPerComponent 8 /ColorSpace %s /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors %d /Columns %d >>" % (width, height, space, colors, width), packed


def assembled(objects: Sequence[bytes]) -> bytes:
    """A PDF file of its objects, the first of which is the catalogue."""
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def wrapped_picture(data: bytes) -> bytes:
    """A PDF file of one page that the picture fills, as large as its resolution says."""
    width, height, across, down = picture_size(data)
    w, h = width * 72 / across, height * 72 / down
    facts, raw = _image(data)
    draw = b"q %.4f 0 0 %.4f 0 0 cm /Im Do Q" % (w, h)
    return assembled([
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.4f %.4f] /Resources << /XObject << /Im 5 0 R >> >> /Contents 4 0 R >>" % (w, h),
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw), b"<< /Type /XObject /Subtype /Image %s /Length %d >>\nstream\n%s\nendstream" % (facts, len(raw), raw),
    ])


def text_pdf(text: str, lines: int = 50, size: float = 11.0) -> bytes:
    """A PDF file of the lines of a text, so many on a page; characters beyond Latin-1's printable ones are '?'."""
    rows = text.split("\n")
    pages = [rows[i : i + lines] for i in range(0, len(rows), lines)] or [[]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding /FirstChar 0 /Widths [" + b"600 " * 256 + b"] >>"]
    kids = []
    for own in pages:
        shown = bytearray(b"BT /F %.1f Tf 14 TL 36 %.1f Td" % (size, 792 - 50))
        for row in own:
            raw = "".join(c if c.isprintable() else "?" for c in row).encode("cp1252", "replace")
            shown += b" (" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*"
        packed = zlib.compress(bytes(shown + b" ET"))
        kids.append(len(objects) + 1)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F 3 0 R >> >> /Contents %d 0 R >>" % (len(objects) + 2))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    return assembled(objects)


def _converted(df: DataFrame, convert) -> DataFrame:
    """Files (path, content) through a function from a name and bytes to bytes: (path, content, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out.append((path, convert(path or "", content or b""), None))
                except Exception as e:  # noqa: BLE001 - a file's failure is its own
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            if out:
                paths, contents, errors = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], ["path", "content", "error"])

    return map_arrow(df.select("path", "content"), run, "path string, content binary, error string")


def wrap_pictures(files: DataFrame) -> DataFrame:
    """JPEG and PNG pictures as PDF files of one page each: (path, content, error)."""
    return _converted(files, lambda path, data: wrapped_picture(data))


def convert_files(files: DataFrame, command: Sequence[str], seconds: float = 120.0) -> DataFrame:
    """Files through an external program that writes a PDF: (path, content, error).

    In `command`, '{input}' and '{folder}' stand for a file with the input and a folder for the output, which are of the one
    executor and deleted after the call. A program that ends badly, writes nothing or takes longer gives the file's error.
    """

    def convert(path: str, data: bytes) -> bytes:
        folder = tempfile.mkdtemp(prefix="pagemill-convert-")
        try:
            source = os.path.join(folder, "input" + os.path.splitext(path)[1])
            with open(source, "wb") as f:
                f.write(data)
            target = os.path.join(folder, "out")
            os.mkdir(target)
            subprocess.run([c.format(input=source, folder=target) for c in command], check=True, timeout=seconds, capture_output=True)
            made = sorted(os.listdir(target))
            if not made:
                raise ValueError("nothing was written")
            with open(os.path.join(target, made[0]), "rb") as f:
                return f.read()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return _converted(files, convert)


def page_points(pixels: str, dpi: str):
    """Size in points of so many pixels; 150 an inch where the resolution is null or 0."""
    return F.col(pixels) * 72 / F.coalesce(F.nullif(F.col(dpi), F.lit(0.0)), F.lit(DPI))
