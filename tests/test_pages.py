"""Operators of pages on small tables with results worked out by hand."""

from __future__ import annotations

import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from pagemill.functions import bidi, tex
from pagemill.functions.glyphs import glyph_text, reverse_cmap
from pagemill.operators import blocks, folds, headings, projection, recognition, render, spatial, tables, triage
from pagemill.plans import pipeline
from pagemill.runtime import written
from pagemill.sources import plugins

ITEM = "doc_id long, page int, seq int, text string, x double, y double, width double, height double, font_size double"
FULL = ITEM + ", rotation double, font_name string, font_weight int, confidence double, math boolean, has_unicode_map_error boolean"


def items(spark, rows, doc=1, page=1):
    return spark.createDataFrame([(doc, page, i, t, float(x), float(y), float(w), float(h), 10.0) for i, (t, x, y, w, h) in enumerate(rows, 1)], ITEM)


def test_cut_prefers_the_wide_empty_valley():
    columns = [(0.0, 100.0, 10.0), (0.0, 90.0, 8.0), (160.0, 260.0, 10.0), (165.0, 250.0, 9.0)]
    score, at = folds.best_cut(columns, 8.0)
    assert 100 < at < 160 and score > 20
    assert folds.best_cut([(0.0, 100.0, 5.0), (104.0, 200.0, 5.0)], 8.0) is None and folds.best_cut([(3.0, 3.0, 1.0)], 8.0) is None


def test_columns_are_read_one_after_the_other(spark):
    left = [(f"l{i}", 50, 50 + 15 * i, 150, 10) for i in range(12)]
    right = [(f"r{i}", 300, 50 + 15 * i, 150, 10) for i in range(12)]
    mixed = [x for pair in zip(left, right) for x in pair]
    df = items(spark, mixed)
    got = folds.reading_order(df).join(df.select("seq", "text"), "seq").orderBy("position").collect()
    assert [r.text for r in got] == [t for t, *_ in left + right] and {r.axes for r in got} == {"V"}
    assert [r.columns for r in triage.column_counts(folds.reading_order(df)).collect()] == [2]


def test_search_takes_separators_as_they_are(spark):
    rows = [("zz", 0, 0, 10, 10), ("blue", 0, 40, 20, 10), ("berry jam", 20, 40, 40, 10), ("and", 100, 40, 15, 10), ("Blueberry", 0, 80, 40, 10)]
    df = items(spark, rows)
    got = [(r.seq, r.x, r.y, r.width, r.text) for r in folds.search(df, "blueberry jam").collect()]
    assert got == [(2, 0.0, 40.0, 60.0, "blueberry jam")]
    assert [r.seq for r in folds.search(df, "jam and").collect()] == [3] and folds.search(df, "jam  and").count() == 0
    assert [r.seq for r in folds.search(df, "Blueberry", case_sensitive=True).collect()] == [5] and folds.search(df, "").count() == 0


def grid_items(rows, x0=60, dx=100, y0=100, dy=16):
    return [(t, x0 + dx * c, y0 + dy * r, 6 * len(t), 10) for r, row in enumerate(rows) for c, t in enumerate(row) if t]


def test_table_without_lines(spark):
    rows = [["City", "Rain", "Days"], ["Lunden", "12.5", "4"], ["Morra", "9", "11"], ["Pelt", "", "2"], ["", "7", "8"]]
    prose = [("This is a line of running text that goes on over the whole width of the page", 60, 40, 400, 10)]
    found = tables.find_tables(items(spark, prose + grid_items(rows))).collect()
    got = {(r.row, r.col): r.text for r in found}
    assert {r.kind for r in found} == {"text"} and {r.table for r in found} == {1}
    assert [[got[r, c] for c in (1, 2, 3)] for r in range(1, 6)] == rows
    assert tables.find_tables(items(spark, prose * 4)).count() == 0
    assert tables.find_tables(items(spark, [(None, 0, 0, 1, 1)])).count() == 0


def test_ruled_table_and_prose_over_its_edges(spark):
    rows = [["Name", "Value"], ["alpha", "1"], ["beta", "2"]]
    h = spark.createDataFrame([(1, 1, 95.0 + 16 * i, 50.0, 250.0) for i in range(4)], "doc_id long, page int, y double, x1 double, x2 double")
    v = spark.createDataFrame([(1, 1, x, 95.0, 143.0) for x in (50.0, 150.0, 250.0)], "doc_id long, page int, vx double, v1 double, v2 double")
    found = tables.find_tables(items(spark, grid_items(rows)), h, v).collect()
    assert {r.kind for r in found} == {"ruled"} and [r.text for r in sorted(found, key=lambda r: (r.row, r.col))] == [t for r in rows for t in r]
    crossing = [("words that run over all of the columns", 60, 100 + 16 * i, 180, 10) for i in range(3)]
    assert tables.find_tables(items(spark, crossing), h, v).count() == 0
    other = items(spark, grid_items(rows), doc=2)
    assert tables.find_tables(other, h, v).filter("kind = 'ruled'").count() == 0  # rules of another document


def test_wrapped_cells_and_resolution():
    rows = [["Item", "Note"], ["pump", "needs a new"], ["", "seal this year"], ["pipe", "12"], ["", "13"]]
    assert tables.merge_continuations(rows) == [["Item", "Note"], ["pump", "needs a new seal this year"], ["pipe", "12"], ["", "13"]]
    assert tables.merge_continuations([["", "a"], ["", "b"], ["x", "c"]]) == [["", "a"], ["", "b"], ["x", "c"]]
    lined, plain = tables.Table("ruled", 0, 4, [["a"], ["b"]]), tables.Table("text", 2, 6, [["a", "b"]] * 3)
    assert tables.resolve([lined], [plain]) == [plain]
    wide = tables.Table("ruled", 0, 4, [["a", "b"]] * 3)
    assert tables.resolve([wide], [plain]) == [wide] and tables.variation([5, 5, 5]) == 0 and tables.merged_edges([1, 2, 9]) == [1.5, 9]


def test_description_list_and_sliced_table(spark):
    rows = [["Owner:", "The town council"], ["Built:", "1911"], ["State:", "fair"]]
    found = tables.find_tables(items(spark, [(t, 60 + 120 * c, 100 + 60 * r, 6 * len(t), 10) for r, row in enumerate(rows) for c, t in enumerate(row)])).collect()
    assert {r.kind for r in found} == {"list"} and len(found) == 6
    region = [(1, 1, k, 50.0 + 90 * k, 90.0 + 90 * k, 100.0 + 12 * i, 5) for k in (0, 1, 3) for i in range(5)] + [(1, 1, 7, 600.0, 700.0, 100.0 + 5 * i, 60) for i in range(5)]
    fused = tables.fused_regions(spark.createDataFrame(region, "doc_id long, page int, region int, x0 double, x1 double, y0 double, chars int"))
    assert {r.region: r.fused for r in fused.collect()} == {0: 0, 1: 0, 3: 0, 7: 7}


BLOCK = "doc_id long, page int, block int, kind string, text string, bold boolean, italic boolean"


def test_paragraphs_are_spliced(spark):
    rows = [("paragraph", "The old bri-"), ("paragraph", "dge stood and"), ("figure", "F"), ("paragraph", "was mended."), ("figure", "G"), ("paragraph", "it fell"), ("heading", "H"), ("paragraph", "end-"), ("paragraph", "Up")]
    df = spark.createDataFrame([(1, 1, i, k, t, False, None) for i, (k, t) in enumerate(rows)], BLOCK)
    got = [(r.kind, r.text) for r in blocks.splice_blocks(df).orderBy("block").collect()]
    assert got == [("paragraph", "The old bridge stood and was mended."), ("figure", "F"), ("figure", "G"), ("paragraph", "it fell"), ("heading", "H"), ("paragraph", "end-"), ("paragraph", "Up")]


def test_tables_are_taken_apart(spark):
    head = ["Year", "Town", "Rain"]
    rows = [head, ["1", "a", "2"], ["", "Second", ""], head, ["2", "b", "3"]]
    assert blocks.split_rows(rows) == [rows[:2], rows[2:]]
    beside = [[*head, "", *head], ["1", "a", "2", "", "3", "c", "4"]]
    assert blocks.split_rows(beside) == [[head, ["1", "a", "2"]], [head, ["3", "c", "4"]]]
    cells = spark.createDataFrame([(1, 1, 1, r, c, t) for r, row in enumerate(rows, 1) for c, t in enumerate(row, 1)], "doc_id long, page int, table int, row int, col int, text string")
    assert {(r.part, r.row) for r in blocks.split_tables(cells).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)}


def test_grid_of_characters():
    boxes = [(50.0, 10.0, 30.0, 10.0, "alpha"), (150.0, 10.0, 24.0, 10.0, "beta"), (50.0, 22.0, 120.0, 10.0, "a longer line at left"), (150.0, 34.0, 24.0, 10.0, "zeta"), (50.0, 90.0, 12.0, 10.0, "is")]
    rows = projection.cleaned_rows(projection.grid(boxes))
    assert rows[0].startswith("alpha") and rows[0].index("beta") == rows[2].index("zeta") and rows[1] == "a longer line at left" and rows[3:] == ["", "", "is"]
    assert projection.grid([]) == [] and projection.cleaned_rows(["", "  a\0b ", "    c", ""]) == ["a b", "  c"]
    sparse = ["x" + " " * 60 + "y"] * 10
    assert projection.cleaned_rows(sparse) == ["x  y"] * 10


def test_raised_and_lowered_items(spark):
    rows = [("Water H", 10, 100, 70, 10), ("2", 81, 107, 4, 5), ("O and x", 86, 100, 60, 10), ("2", 147, 97, 4, 5), ("wide", 170, 100, 40, 10), ("far", 300, 97, 10, 5)]
    df = items(spark, rows).withColumns({"line": F.lit(1), "confidence": F.lit(None).cast("double"), "math": F.lit(False)})
    assert {r.seq: r.script for r in projection.scripts(df).collect()} == {2: "sub", 4: "sup"}


def test_headings_wrap_up_to_a_length(spark):
    rows = [(1, 1, 1, 2, "On the"), (1, 1, 2, 2, "bridges"), (1, 1, 3, None, "text"), (1, 1, 4, 2, "x" * 100), (1, 1, 5, 2, "y" * 60), (1, 1, 6, 1, "Z")]
    got = headings.wrapped_headings(spark.createDataFrame(rows, "doc_id long, page int, seq int, level int, text string")).orderBy("seq").collect()
    assert [(r.seq, r.level, r.text[:14], r.lines) for r in got] == [(1, 2, "On the bridges", 2), (4, 2, "x" * 14, 1), (5, 2, "y" * 14, 1), (6, 1, "Z", 1)]


def test_level_of_a_heading_comes_from_the_first_source(spark):
    lines = [(1, 1, 1, "Tagged", 12.0, 2, None), (1, 1, 2, "Listed", 12.0, None, 3), (1, 1, 3, "Large", 15.9, None, None), (1, 1, 4, "Figure 3 Large", 16.0, None, None), (1, 2, 1, "Contents", 12.0, None, None), (1, 2, 2, "Large", 16.0, None, 4)]
    df = spark.createDataFrame(lines, "doc_id long, page int, seq int, text string, font_size double, tag_level int, outline_level int").withColumn("rotation", F.lit(0.0))
    sizes = spark.createDataFrame([(1, 16.0, 1)], "doc_id long, size double, level int")
    toc = spark.createDataFrame([(1, 2)], "doc_id long, page int")
    assert {(r.page, r.seq): r.level for r in headings.heading_levels(df, sizes, toc).collect()} == {(1, 1): 2, (1, 2): 3, (1, 3): 1, (1, 4): None, (2, 1): 1, (2, 2): None}


def test_figures_are_clusters(spark):
    box = "doc_id long, page int, seq int, x double, y double, width double, height double"
    shapes = [(1, 1, 1, 100.0, 100.0, 40.0, 40.0), (1, 1, 2, 148.0, 100.0, 40.0, 40.0), (1, 1, 3, 100.0, 149.0, 90.0, 20.0), (1, 1, 4, 50.0, 400.0, 500.0, 1.0), (1, 1, 5, 400.0, 600.0, 20.0, 20.0), (2, 1, 6, 100.0, 100.0, 40.0, 40.0), (1, 1, 7, 300.0, 300.0, 90.0, 90.0)]
    text = spark.createDataFrame([(1, 1, 1, 300.0, 300.0, 90.0, 60.0)], box)
    got = [tuple(r) for r in spatial.figure_clusters(spark.createDataFrame(shapes, box), text).collect()]
    assert got == [(1, 1, 1, 100.0, 100.0, 90.0, 69.0)]


def test_outcome_without_a_page_is_an_error(spark):
    pages = spark.createDataFrame([(1, 1)], "doc_id long, page int")
    outcomes = spark.createDataFrame([(1, 1, 2), (1, 1, 1)], "doc_id long, page int, seq int")
    assert [r.seq for r in recognition.matched_outcomes(outcomes, pages).collect()] == [1, 2]
    with pytest.raises(Exception, match="no page: 1/7"):
        recognition.matched_outcomes(spark.createDataFrame([(1, 7, 1)], outcomes.schema), pages).collect()


def test_skew_turns_boxes_back_and_forth(spark):
    boxes = items(spark, [("a", 100, 200, 50, 10)])
    skews = spark.createDataFrame([(1, 1, 3.0)], "doc_id long, page int, skew double")
    again = recognition.deskewed(recognition.deskewed(boxes, skews), skews, back=True).first()
    assert (again.x, again.y) == pytest.approx((100.0, 200.0))


def test_direction_of_short_lines(spark):
    texts = ["שורה עם USD 12.50", "plain 12", "مبلغ 4", "", "12:30", "café"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.r for r in df.select(bidi.is_rtl(F.col("t")).alias("r")).collect()] == [True, False, True, False, False, False]


def test_names_of_glyphs():
    known = {"A": "A", "eacute": "é", "Zcaron": "Ž", "uni00E900410": None, "uni00E90041": "éA", "u1F600": "😀", "f_i": "fi", "ffl": "ffl", "one.oldstyle": "1", "Omega": "Ω", "beta": "β", "germandbls": "ß", "space": " ", "quoteright": "’", "g23": None, "": None, "uniD800": None}
    assert {n: glyph_text(n) for n in known} == known


def test_character_map_of_a_font():
    import struct

    segments = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HHHHHHHHH", 0x42, 0xFFFF, 0, 0x41, 0xFFFF, (5 - 0x41) & 0xFFFF, 1, 0, 0)
    groups = struct.pack(">HHIII", 12, 0, 28, 0, 1) + struct.pack(">III", 0x1F600, 0x1F601, 9)
    cmap = struct.pack(">HHHHIHHI", 0, 2, 3, 1, 20, 3, 10, 20 + len(segments)) + segments + groups
    font = struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap
    assert reverse_cmap(font) == {9: 0x1F600, 10: 0x1F601}
    alone = cmap[:2] + b"\0\1" + cmap[4:12] + segments
    alone = alone[:8] + struct.pack(">I", 12) + segments
    font = struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(alone)) + alone
    assert reverse_cmap(font) == {5: 0x41, 6: 0x42} and reverse_cmap(b"none") is None


def glyphs(text, x=0.0, y=100.0, h=10.0, w=6.0):
    return [tex.Glyph(c, x + w * i, y, w - 0.5, h) for i, c in enumerate(text)]


def test_formulas():
    assert tex.tex(glyphs("x") + glyphs("2", 6, 96, 6, 4) + glyphs("+α", 12)) == r"x^2+\alpha"
    assert tex.tex(glyphs("a") + glyphs("ij", 6, 107, 6, 4) + glyphs("≤b", 20)) == r"a_{ij}\leq b"
    bar = [tex.Bar(20.0, 105.0, 14.0)]
    assert tex.tex(glyphs("y=", 0) + glyphs("ab", 21, 92) + glyphs("c", 24, 107), bar) == r"y=\frac{ab}{c}"
    assert tex.tex(glyphs("√", 0) + glyphs("pq", 7), [tex.Bar(6.0, 99.0, 12.0)]) == r"\sqrt{pq}"
    assert tex.tex([]) == "" and tex.command("Σ") == r"\Sigma" and tex.command("𝑥") == "x"


def test_stages_equal_the_whole(spark):
    from pagemill.sources.tables import items as read

    own = written(read(spark, "/root/testdata/sf0.001").filter("doc_id % 3 = 0"))
    config = pipeline.Config(most_pages=3)
    lines = written(pipeline.lined(written(pipeline.filtered(own, config)), config))
    staged = pipeline.rendered(pipeline.blocked(lines, config), lines)
    assert {tuple(r) for r in staged.collect()} == {tuple(r) for r in pipeline.parse_items(own, config).collect()}
    with pytest.raises(ValueError):
        pipeline.filtered(own, pipeline.Config(pages="3-1"))


def test_blocks_of_a_caller(spark):
    rows = [(1, 1, 1, "heading", "A", 2, None), (1, 1, 2, "rule", "", None, None), (1, 1, 3, "list", "one", 0, "-"), (1, 1, 4, "list", "two", 1, "1."), (1, 2, 1, "paragraph", "snake_case and _lead", None, None), (1, 3, 1, "code", "x = 1", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, page int, block int, kind string, text string, level int, marker string")
    assert {r.page: r.markdown for r in pipeline.parse_blocks(df, most_pages=2).collect()} == {1: "## A\n\n---\n\n- one\n  1. two", 2: r"snake_case and \_lead"}
    pages = spark.createDataFrame([(1, 1, "a", "t"), (1, 2, None, "plain")], "doc_id long, page int, markdown string, text string")
    assert "".join(r.markdown for r in render.document_markdown(pages).orderBy("page").collect()) == "a\n\n-----\n\n```\nplain\n```"


def test_pictures_are_written_once(spark, tmp_path):
    images = spark.createDataFrame([(1, 1, 1, bytearray(b"a")), (1, 2, 1, bytearray(b"a")), (1, 2, 2, bytearray(b"b"))], "doc_id long, page int, seq int, content binary")
    targets = render.write_images(images, str(tmp_path / "images"))
    assert {(r.page, r.seq): r.target for r in targets.collect()} == {(1, 1): "1/1/1", (2, 1): "1/1/1", (2, 2): "1/2/2"} and spark.read.parquet(str(tmp_path / "images")).count() == 2
    pages = spark.createDataFrame([(1, 2, "see ![x](image:2/1)"), (1, 3, "none")], "doc_id long, page int, markdown string")
    assert {r.page: r.markdown for r in render.rewritten(pages, targets).collect()} == {2: "see ![x](1/1/1)", 3: "none"}
    results = spark.createDataFrame([("a", None), ("b", "x")], "path string, error string")
    assert tuple(render.batch_report(results).first()) == (2, 1, False)


class Service(BaseHTTPRequestHandler):
    calls: list[bytes] = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        Service.calls.append(body)
        if len(Service.calls) == 1:
            self.send_error(503)
            return
        answer = json.dumps({"lines": [{"text": "hi", "score": 0.9, "box": [[1, 2], [5, 2], [5, 4], [1, 4]]}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(answer)

    def log_message(self, *args):
        pass


def test_recognition_by_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    engine = plugins.with_retries(plugins.http_recogniser(f"http://127.0.0.1:{server.server_port}/ocr", {"mode": "fast"}), sleep=lambda s: None)
    assert engine(b"PNG", "de") == [{"text": "hi", "confidence": 0.9, "bbox": [1.0, 2.0, 5.0, 4.0], "polygon": [[1.0, 2.0], [5.0, 2.0], [5.0, 4.0], [1.0, 4.0]]}]
    assert len(Service.calls) == 2 and b'name="language"\r\n\r\nde' in Service.calls[1] and b'name="mode"\r\n\r\nfast' in Service.calls[1] and b"PNG" in Service.calls[1]
    images = spark.createDataFrame([(1, 1, i, bytearray(b"x")) for i in range(3)], "doc_id long, page int, seq int, content binary")
    url = f"http://127.0.0.1:{server.server_port}/ocr"

    def remote(content, language):
        return plugins.http_recogniser(url)(content, language)

    got = plugins.recognise(images, remote, workers=2).orderBy("seq").collect()
    assert [(r.results[0].text, r.error) for r in got] == [("hi", None)] * 3
    server.shutdown()


def test_calls_are_doubled_kept_in_order_and_ended():
    calls = []

    def slow_once(content, language):
        calls.append(1)
        if len(calls) == 1:
            time.sleep(1.0)
        return [{"text": str(len(calls)), "confidence": 1.0, "bbox": []}]

    began = time.time()
    assert plugins.hedged(slow_once, after=0.05)(b"", "en") and time.time() - began < 0.9 and len(calls) == 2
    running, most, lock = [0], [0], threading.Lock()

    def job(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(random.random() / 50)
        with lock:
            running[0] -= 1
        if i == 5:
            raise ValueError("five")
        return i

    got = list(plugins.in_window([lambda i=i: job(i) for i in range(12)], 3))
    assert [r for r, e in got if e is None] == [i for i in range(12) if i != 5] and str(got[5][1]) == "five" and most[0] <= 3
    pool = plugins.Workers(lambda s: time.sleep(s) or s, 0.3)
    assert pool.call(0.0) == (0.0, None) and "TimeoutError" in pool.call(5.0)[1] and pool.call(0.01) == (0.01, None)
    pool.close()


def test_parsing_in_processes_and_providers(spark):
    def parse(content):
        if content == b"hang":
            time.sleep(30)
        if content == b"bad":
            raise ValueError("no")
        return content.decode().upper()

    files = spark.createDataFrame([(p, bytearray(p.encode())) for p in ("a", "hang", "bad", "b")], "path string, content binary").coalesce(1)
    got = {r.path: (r.result, r.error) for r in plugins.parse_pool(files, parse, 0.5).collect()}
    assert got["a"] == ("A", None) and got["b"] == ("B", None) and got["bad"] == (None, "ValueError: no") and "TimeoutError" in got["hang"][1]
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, question string")
    asked = {r.id: (r.result, r.error) for r in plugins.ask(rows, "upper", ["question"], lambda question: question.upper()).collect()}
    assert asked[1] == ("X", None) and asked[2][1].startswith("AttributeError")
    words = spark.createDataFrame([("a", 90.0), ("b", 20.0), (" ", 99.0)], "text string, conf double")
    assert [(r.text, r.confidence) for r in plugins.sure_words(words).collect()] == [("a", 0.9)]
