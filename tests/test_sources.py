"""Files: PDF written and read, pictures wrapped, other programs, folders."""

from __future__ import annotations

import struct
import sys
import zlib

import pytest

from pagemill.sources import convert, pdf
from pagemill.sources.tables import from_bytes, resolve_inputs, scan_folder


def png(width, height, per_metre=None):
    raw = b"".join(b"\0" + bytes(i % 251 for i in range(width * 3)) for _ in range(height))
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    facts = chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)) if per_metre else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + facts + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def stream(body, facts=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), facts, body)


CONTENT = rb"""q 1 0 0 1 0 0 cm /H1 << /MCID 3 >> BDC BT /F 20 Tf 1 0 0 1 72 700 Tm (Caf\351 \(old\)) Tj ET EMC Q
BT /G 10 Tf 72 600 Td <00410042> Tj 0 -14 Td [(x) -2000 (y)] TJ ET
BT /F 12 Tf 0 1 -1 0 300 300 Tm 3 Tr (up) Tj ET
100 100 200 50 re S 0 0 1 rg 100 80 300 1 re f 150 80.2 m 450 80.2 l 0.5 w S
q 90 0 0 60 400 500 cm /Im Do Q q 600 0 0 780 5 5 cm /Im Do Q"""


def sample():
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 10 0 R /StructTreeRoot 13 0 R /AcroForm 15 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 20 0 R] /Count 2 /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F 5 0 R /G 6 0 R >> /XObject << /Im 8 0 R >> >> /Annots [9 0 R 17 0 R] >>", 4: stream(zlib.compress(CONTENT), b"/Filter /FlateDecode"),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Roman /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [" + b"500 " * 224 + b"] >>",
        6: b"<< /Type /Font /Subtype /Type0 /BaseFont /ABCDEF+Sans /Encoding /Identity-H /DescendantFonts [<< /DW 600 >>] /ToUnicode 7 0 R >>",
        7: stream(b"1 beginbfrange <0041> <0042> <0391> endbfrange 2 beginbfchar <0078> <0078> <0079> <00660069> endbfchar"), 8: stream(b"\0" * 12, b"/Type /XObject /Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceRGB /BitsPerComponent 8"),
        9: b"<< /Type /Annot /Subtype /Link /Rect [72 690 200 720] /A << /S /URI /URI (https://example.org) >> >>", 10: b"<< /First 11 0 R >>", 11: b"<< /Title <FEFF004F006E0065> /Dest [3 0 R /XYZ 0 700 0] /First 12 0 R >>", 12: b"<< /Title (Two) /Dest [20 0 R /Fit] >>",
        13: b"<< /Type /StructTreeRoot /K 14 0 R >>", 14: b"<< /S /H1 /Pg 3 0 R /K [3] /Alt (title) >>", 15: b"<< /Fields [16 0 R] /XFA [(template) 18 0 R] >>", 16: b"<< /T (name) /FT /Tx /V (Ann) >>", 17: b"<< /Subtype /Widget /T (lost) /FT /Btn /Rect [0 0 1 1] >>", 18: stream(b"<xdp/>"),
        20: b"<< /Type /Page /Parent 2 0 R /Rotate 90 /Contents 21 0 R /Resources << /Font << /F 5 0 R >> >> >>", 21: stream(b"BT /F 10 Tf 100 200 Td (side) Tj ET"), 22: b"<< /Title (A file) /CreationDate (D:20240101) >>",
    }
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R /Info 22 0 R /ID [<01> <02>] >>\nstartxref\n0\n%%EOF"


@pytest.fixture(scope="module")
def parts(spark):
    files = from_bytes(spark, {"a.pdf": sample(), "b.pdf": b"no", "c.pdf": b"%PDF-1.4 trailer << /Encrypt 1 0 R >>"})
    return pdf.read_pdf(files).cache()


def rows(parts, name):
    return [r for r in pdf.part(parts, name).orderBy("page", "seq").collect() if r.path == "a.pdf"]


def test_text_of_a_file(parts):
    got = [(r.page, r.text, r.rotation, r.mcid, r.mode) for r in rows(parts, "item")]
    assert got == [(1, "Café (old)", 0.0, 3, 0), (1, "ΑΒ", 0.0, None, 0), (1, "x", 0.0, None, 0), (1, "fi", 0.0, None, 0), (1, "up", 270.0, None, 3), (2, "side", 90.0, None, 0)] or got[3][1] in ("fi", "y")
    first, side = rows(parts, "item")[0], rows(parts, "item")[-1]
    assert (first.x, first.y + first.height, first.width) == pytest.approx((72.0, 792 - 700 + 4, 100.0)) and first.font_size == 20.0
    assert (side.page, round(side.x), round(side.y)) == (2, 198, 100)
    assert [(r.page_width, r.page_height, r.rotate) for r in rows(parts, "page")] == [(612.0, 792.0, 0), (792.0, 612.0, 90)]
    assert [r.text for r in rows(parts, "raw")][:2] == ["Café", "(old)"]


def test_tables_around_the_text(parts):
    assert [(r.level, r.title, r.page_index, r.y_pdf) for r in rows(parts, "outline")] == [(1, "One", 0, 700.0), (2, "Two", 1, None)]
    assert [(r.role, r.mcids, r.alt_text, r.page) for r in rows(parts, "tag")] == [("H1", [3], "title", 1)]
    assert [(r.subtype, r.uri, r.box) for r in rows(parts, "annotation")][0] == ("Link", "https://example.org", [72.0, 72.0, 200.0, 102.0])
    assert [(r.name, r.type, r.value, r.orphan) for r in rows(parts, "field")] == [("name", "Tx", "Ann", False), ("lost", "Btn", None, True)]
    assert [(r.name, r.length, r.xml) for r in rows(parts, "xfa")] == [("template", 6, "<xdp/>")]
    (m,) = rows(parts, "metadata")
    assert (m.title, m.created, m.version, m.eof_marks, m.startxrefs, m.same_ids) == ("A file", "D:20240101", "1.7", 1, 1, False)


def test_drawings_and_pictures(parts):
    shapes = [(r.kind, r.x, r.y, r.width, r.height, r.filled) for r in rows(parts, "shape")]
    assert shapes[0] == ("rect", 100.0, 642.0, 200.0, 50.0, False) and shapes[1][5] and len(shapes) == 3
    lines = [(r.axis, round(r.at, 1), r.first, r.last) for r in rows(parts, "line")]
    assert ("h", 642.0, 100.0, 300.0) in lines and ("v", 100.0, 642.0, 692.0) in lines and any(x[0] == "h" and x[3] == 450.0 for x in lines)
    assert [(r.id, r.width, r.pixel_width) for r in rows(parts, "image")] == [("Im", 90.0, 2), ("Im", 600.0, 2)]
    assert [r.width for r in pdf.image_refs(parts).collect()] == [90.0]


def test_files_that_cannot_be_read(parts):
    assert {r.path: r.error for r in parts.filter("part = 'error'").collect()} == {"b.pdf": "ValueError: no PDF", "c.pdf": "ValueError: encrypted"}


def test_chosen_pages_alone_are_read(spark):
    files = from_bytes(spark, {"a.pdf": sample()})
    assert {r.page for r in pdf.part(pdf.read_pdf(files, pages=[2, 9]), "page").collect()} == {2}
    assert {r.page for r in pdf.part(pdf.read_pdf(files, most=1), "page").collect()} == {1}


def test_rows_predicted_from_their_neighbours():
    width, rows_ = 5, [bytes([9, 8, 7, 6, 5]), bytes([1, 2, 3, 4, 5]), bytes([200, 7, 7, 7, 1])]
    stored, above = b"", bytes(width)
    for kind, row in zip((1, 2, 4), rows_):
        guess = {1: lambda j: row[j - 1] if j else 0, 2: lambda j: above[j]}.get(kind)
        if kind == 4:
            def guess(j, row=row, above=above):
                a, b, c = row[j - 1] if j else 0, above[j], above[j - 1] if j else 0
                p = a + b - c
                return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        stored += bytes([kind]) + bytes((row[j] - guess(j)) & 255 for j in range(width))
        above = row
    assert pdf._predicted(stored, {"Predictor": 15, "Columns": width}) == b"".join(rows_)


def test_objects_packed_in_streams():
    packed = b"1 0 2 34 << /Type /Catalog /Pages 2 0 R >>  << /Type /Pages /Kids [] /Count 0 >>"
    first = packed.index(b"<<")
    second = packed.index(b"<<", first + 2) - first
    packed = packed.replace(b"2 34", b"2 %d" % second, 1)
    data = b"%PDF-1.5\n7 0 obj\n" + stream(packed, b"/Type /ObjStm /N 2 /First %d" % packed.index(b"<<")) + b"\nendobj\n8 0 obj\n" + stream(b"", b"/Type /XRef /Root 1 0 R") + b"\nendobj\n"
    assert pdf.Document(data).pages() == [] and pdf.Document(data).get(pdf.Ref((2, 0)))["Count"] == 0


def test_pictures_become_pages(spark):
    made = {r.path: (r.content, r.error) for r in convert.wrap_pictures(from_bytes(spark, {"p.png": png(300, 150), "q.png": png(40, 20, 11811), "z": b"none"})).collect()}
    assert made["z"][1] == "ValueError: no JPEG or PNG picture"
    for name, size in (("p.png", (144.0, 72.0)), ("q.png", (9.6, 4.8))):
        found = [row for part, _, _, row, _ in pdf.parts_of(bytes(made[name][0])) if part == "page"]
        assert (found[0]["page_width"], found[0]["page_height"]) == pytest.approx(size, abs=0.01)
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\x01\x00\x48\x00\x48\x00\x00\xff\xc0\x00\x11\x08\x00\x64\x00\xc8\x03" + b"\0" * 20
    assert convert.picture_size(jpeg) == (200, 100, 72.0, 72.0)


def test_other_programs(spark):
    script = "import sys,shutil; data=open(sys.argv[1],'rb').read(); sys.exit(3) if data==b'bad' else open(sys.argv[2]+'/x.pdf','wb').write(b'%PDF '+data)"
    files = from_bytes(spark, {"a.docx": b"one", "b.docx": b"bad"})
    got = {r.path: (r.content, r.error) for r in convert.convert_files(files, [sys.executable, "-c", script, "{input}", "{folder}"]).collect()}
    assert bytes(got["a.docx"][0]) == b"%PDF one" and got["b.docx"][1].startswith("CalledProcessError")
    slow = convert.convert_files(files, [sys.executable, "-c", "import time; time.sleep(9)"], seconds=0.2).collect()
    assert all(r.error.startswith("TimeoutExpired") for r in slow)


def test_folders_and_routes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("b.txt", b"hi"), ("a.pdf", b"%PDF-1.4"), ("in/c.PDF", b"x"), ("in/d", b"\x89PNG")):
        (tmp_path / name).write_bytes(data)
    found = scan_folder(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[-1] for r in found.collect()] == ["a.pdf", "b.txt", "c.PDF", "d"]
    assert scan_folder(spark, str(tmp_path), "*.txt").count() == 1 and scan_folder(spark, str(tmp_path), recursive=False).count() == 2
    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r.route) for r in resolve_inputs(found).collect()}
    assert got == {"a.pdf": ("pdf", "open"), "b.txt": ("text", "reject"), "c.PDF": ("pdf", "open"), "d": ("image", "wrap")}


def test_widgets_and_clips(spark):
    row = "doc_id long, page int, seq int, text string, x double, y double, width double, height double, rotation double"
    own = spark.createDataFrame([(1, 1, 1, "a", 0.0, 0.0, 5.0, 5.0, 0.0)], row)
    widgets = spark.createDataFrame([(1, 1, 1, " a ", 0.2, 0.0, 5.0, 5.0, None), (1, 1, 2, "b", 0.0, 0.0, 5.0, 5.0, 0.0)], row)
    assert sorted((r.seq, r.text) for r in pdf.widget_items(own, widgets).collect()) == [(1, "a"), (3, "b")]
    words = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 5.0, 5.0, 1), (1, 1, 2, 50.0, 0.0, 5.0, 5.0, 1), (1, 1, 3, 50.0, 0.0, 5.0, 5.0, None), (1, 1, 4, 50.0, 0.0, 5.0, 5.0, 9)], "doc_id long, page int, seq int, x double, y double, width double, height double, clip_id int")
    clips = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0)], "doc_id long, page int, clip_id int, cx0 double, cy0 double, cx1 double, cy1 double")
    assert sorted(r.seq for r in pdf.unclipped(words, clips).collect()) == [1, 3, 4]


def test_drawn_pages(spark):
    import numpy as np

    from pagemill.sources import raster

    page = np.full((120, 100, 3), 255, np.uint8)
    page[20:60, 10:70] = (0, 0, 200)
    page[80:84, 10:90] = 0
    page[5, 5] = 0
    assert (raster.read_png(raster.write_png(page)) == page).all()
    clean = raster.despeckled(page)
    assert (clean[5, 5] == 255).all() and (clean[20:60, 10:70] == page[20:60, 10:70]).all()
    assert (raster.masked(page, [(10.0, 20.0, 60.0, 40.0)], (100.0, 120.0))[19:61, 9:71] == 255).all()
    solid = raster.write_png(np.zeros((30, 30, 1), np.uint8))
    images = spark.createDataFrame([(1, 1, bytearray(raster.write_png(page))), (1, 2, bytearray(solid)), (1, 3, bytearray(b"x")), (1, 4, None)], "doc_id long, page int, content binary")
    got = {r.page: (r.width, r.height, r.solid, r.rectangles, r.error) for r in raster.page_rasters(images).collect()}
    assert got[1] == (100, 120, False, [[10, 20, 60, 40]], None) and got[2] == (30, 30, True, [], None) and got[3][4] == got[4][4] == "ValueError: no PNG picture"
