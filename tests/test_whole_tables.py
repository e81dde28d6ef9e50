"""Queries over the whole of text_items against brute force, and joins of boxes that must keep documents apart."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from pagemill.functions.text import NUMBERED
from pagemill.operators import folds, layout, render, spatial
from pagemill.plans import join_queries, layout_queries
from pagemill.sources.tables import items

SF = "/root/testdata/sf0.001"
QUERIES = layout_queries.QUERIES | join_queries.QUERIES
BOX = "doc_id long, page int, seq int, text string, x double, y double, width double, height double"


def rows_of(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def own(spark):
    return items(spark, SF).collect()


def boxed(r):
    return None not in (r.x, r.y, r.width, r.height)


def test_boxes_of_different_documents_do_not_meet(spark):
    results = spark.createDataFrame([(1, 1, 1, "a", 10.0, 10.0, 50.0, 10.0), (2, 1, 1, "b", 200.0, 10.0, 50.0, 10.0), (2, 2, 1, "z", 0.0, 0.0, 0.0, 5.0)], BOX)
    native = spark.createDataFrame([(2, 1, 9, "c", 10.0, 10.0, 50.0, 10.0), (1, 2, 9, "d", 200.0, 10.0, 50.0, 10.0)], BOX)
    assert {(r.doc_id, r.page) for r in spatial.without_native(results, native).collect()} == {(1, 1), (2, 1), (2, 2)}
    assert {(r.doc_id, r.page): r.covered for r in spatial.width_covered(results, native).collect()} == {(1, 1): 0.0, (2, 1): 0.0, (2, 2): 1.0}
    tracks = spark.createDataFrame([(2, 1, 7, 0.0, 60.0)], "doc_id long, page int, track int, lo double, hi double")
    assert {(r.doc_id, r.page): r.track for r in spatial.nearest_track(native, tracks).collect()} == {(2, 1): 7, (1, 2): None}
    links = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 300.0, 15.0, "u")], "doc_id long, page int, pos int, x1 double, y1 double, x2 double, y2 double, uri string")
    assert {(r.doc_id, r.page): r.uri for r in spatial.assign_links(results, links).collect()} == {(1, 1): "u", (2, 1): None, (2, 2): None}
    lines = spark.createDataFrame([(1, 1, 1, 0.0, 300.0, 14.0, 0.5)], "doc_id long, page int, pos int, x1 double, x2 double, sy double, thickness double")
    plain = results.selectExpr("*", "false AS math", "0.0D AS rotation")
    assert {r.doc_id for r in spatial.struck(plain, lines).collect()} == {1}
    under = spark.createDataFrame([(1, 1, 1, 10.0, 60.0, 20.0, 0.5)], lines.schema)
    assert {r.doc_id for r in spatial.underlined(plain, under).collect()} == {1}
    rules = spark.createDataFrame([(1, 1, 100.0, 0.0, 50.0), (2, 1, 120.0, 0.0, 50.0), (1, 1, 140.0, 0.0, 50.0)], "doc_id long, page int, y double, x1 double, x2 double")
    assert [tuple(r) for r in spatial.rule_bands(rules).collect()] == [(1, 1, 100.0, 140.0)]


@pytest.mark.parametrize("reach", [0.0, 10.0])
def test_pairs_of_boxes_against_brute_force(spark, reach):
    rng = random.Random(int(reach))
    boxes = [(d, 1, s, "t", rng.uniform(-900, 5200), rng.uniform(-50, 900), rng.choice([0.0, 5.0, 70.0, 700.0, -3.0]), rng.uniform(0, 150)) for d in (1, 2) for s in range(60)]
    boxes.append((1, 1, 99, None, None, 5.0, 5.0, 5.0))
    df = spark.createDataFrame(boxes, BOX)
    got = [(r.doc_id, r.seq, r.n_seq) for r in spatial.pairs(df, spatial.native_boxes(df), spatial.box(), spatial.box(*spatial.OTHER), reach).collect()]
    own = [b for b in boxes if None not in b[4:]]
    want = [
        (a[0], a[2], b[2]) for a in own for b in own if a[0] == b[0]
        and max(a[4] - reach, b[4]) <= min(a[4] + max(a[6], 0) + reach, b[4] + max(b[6], 0)) and max(a[5] - reach, b[5]) <= min(a[5] + a[7] + reach, b[5] + b[7])
    ]
    assert sorted(got) == sorted(want) and len(want) > len(own)


def test_pages_as_markdown(spark, own):
    blocks = defaultdict(list)
    for r in folds.classify_blocks(items(spark, SF)).collect():
        blocks[r.doc_id, r.page].append((r.block, r.kind, r.text))
    got = {k[:2]: k[2] for k in rows_of(spark, "markdown_render")}
    assert got.keys() == {k for k, b in blocks.items() if any(kind != "rule" for _, kind, _ in b)}
    for k, page in got.items():
        kinds = [(kind, t) for _, kind, t in sorted(blocks[k])]
        assert len(re.findall(r"^#{1,6} ", page, re.M)) >= sum(kind == "heading" for kind, _ in kinds)
        for kind, t in kinds:
            if kind == "list" and (m := re.match(NUMBERED, t)) and not re.search(r"[*_\\]", t):
                assert f"{m[1]} {m[2]}" in page
            elif kind in ("paragraph", "code") and not re.search(r"[*_\\]", t):
                assert t in page


def drawn(found):
    cells = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for r in found:
        if r.row_y is not None:
            cells[r.doc_id, r.page][r.row_y][r.cell].append((r.x, r.seq, r.text))
    want = {}
    for page, rows in cells.items():
        lines = [[" ".join(t.replace("|", "\\|") for _, _, t in sorted(c) if t is not None) for _, c in sorted(row.items())] for _, row in sorted(rows.items())]
        out = ["| " + " | ".join(line) + " |" for line in lines]
        want[page] = "\n".join([out[0], "|" + "|".join(" --- " for _ in lines[0]) + "|", *out[1:]])
    return want


def test_tables_of_rows(spark):
    want = drawn(layout.split_cells(items(spark, SF)).collect())
    assert len(want) > 50 and {k[:2]: k[2] for k in rows_of(spark, "table_render")} == want
    rows = [(d, 1, s, t, x, y, 20.0, 9.0, 9.0) for d in (1, 2) for s, (t, x, y) in enumerate([("Name", 0.0, 0.0), ("Rain", 90.0, 0.0), ("a|b", 0.0, 20.0), ("x", 22.0, 20.0), (None, 44.0, 20.0), ("12", 90.0, 20.0)])]
    cells = layout.split_cells(spark.createDataFrame(rows, BOX + ", font_size double"))
    got = {r.doc_id: r.markdown for r in render.pipe_table(render.row_cells(cells), ["doc_id", "page"]).collect()}
    assert got == {d: "| Name | Rain |\n| --- | --- |\n| a\\|b x | 12 |" for d in (1, 2)} and got[1] == drawn(cells.collect())[1, 1]
