from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.operators import evaluation, folds, layout, spatial
from pagemill.operators.snapshots import snapshot_changes, snapshot_values
from pagemill.sources import plugins
from pagemill.sources.tables import sniff
from pagemill.streaming import batches

ROW = "doc_id long, text string"
SCHEMA = "snap int, document string, page int, output_text string, snap_note string"


def brute(rows):
    held = defaultdict(lambda: defaultdict(set))
    for s, d, p, t, _ in rows:
        if s is not None:
            held[s][(d, p)].add(t)
    out = set()
    if held:
        for s in range(min(held) + 1, max(held) + 1):
            new, old = held[s], held[s - 1]
            for k in {*new, *old}:
                if k not in old:
                    out.add((s, *k, "added"))
                elif k not in new:
                    out.add((s, *k, "removed"))
                elif new[k] != old[k]:
                    out.add((s, *k, "changed"))
    return out


def test_snapshot_changes_against_brute_force(spark):
    rows = [(1, "a", 1, "x", ""), (1, "a", 1, "x", "again"), (1, "b", 1, None, ""), (1, None, 2, "n", ""), (2, "a", 1, "x", ""), (2, "b", 1, "", ""), (2, "c", 0, "y" * 9000, ""),
            (3, "a", 1, "X", ""), (3, "b", 1, "", ""), (3, None, 2, "n", ""), (5, "a", 1, "X", ""), (None, "z", 1, "q", "")]
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), "snap", ["document", "page"], ["output_text"]).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len({tuple(r) for r in got})


@pytest.mark.parametrize("few", [0, 1000])
def test_snapshot_values(spark, few):
    rows = [(1, "a", 1, "x", ""), (1, "b", 1, None, ""), (1, "c", 2, "gone", ""), (2, "a", 1, "y", ""), (2, "a", 1, "w", ""), (2, "b", 1, "", ""), (2, None, 0, "new", "")]
    got = {tuple(r) for r in snapshot_values(spark.createDataFrame(rows, SCHEMA), "snap", ["document", "page"], ["output_text"], bucket=2, few=few).collect()}
    assert got == {(2, "a", 1, "changed", "x", "w"), (2, "b", 1, "changed", None, ""), (2, "c", 2, "removed", "gone", None), (2, None, 0, "added", None, "new")}


def test_snapshot_changes_of_nothing(spark):
    assert snapshot_changes(spark.createDataFrame([], SCHEMA), "snap", ["document", "page"], ["output_text"]).count() == 0


def test_page_selection(spark):
    got = {r.spec: r.pages for r in layout.target_pages(spark.createDataFrame([("1-3,2",), ("0",), ("9-1",), ("",), ("7 - 8,3",)], "spec string")).collect()}
    assert got == {"1-3,2": [1, 2, 3], "0": None, "9-1": None, "": None, "7 - 8,3": [3, 7, 8]}


def test_shapes_of_long_lines_and_any_line_end(spark, tmp_path):
    import re

    from pagemill.functions import text as T
    from pagemill.plans.layout_queries import QUERIES

    long = "word " * 4000
    texts = ["• item one\r\n12) twelve\r2.1.3 Scope\nFigure 12: Rain\r\n", "Introduction " + ". " * 90 + "17", "- " + long, "3. " + long + "end 12", long, "9 " * 5000 + "9", None, "", "\r\r\n\n"]
    spark.createDataFrame(list(enumerate(texts)), ROW).write.parquet(str(tmp_path / "documents.parquet"))
    lines = {x for t in texts if t is not None for x in re.split(r"\r\n|\r|\n", t)}

    def shape(x):
        bullet, ordered, toc = re.match(T.BULLET, x), re.match(T.NUMBERED, x), re.search(r"^(.*[^0-9\s])[\s.]*\s([0-9]{1,4})$", x) if re.search(r"\s[0-9]{1,4}$", x) else None
        section, letters = re.match(T.SECTION, x), sum(map(str.isalpha, toc[1])) if toc else 0
        marker = "bullet" if bullet else "ordered" if ordered else None
        return x, marker, (bullet or ordered)[2] if marker else None, section[1] if section else "", bool(re.search(T.CAPTION, x)), int(toc[2]) if letters >= 8 else None

    got = [tuple(r) for r in QUERIES["document_line_shapes"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(map(shape, lines), key=str)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a int, b int")
    got = dict(spatial.components(spark.range(41).select(F.col("id").cast("int").alias("node")), chain).collect())
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(21, 41)} == {21}


ITEMS = "doc_id long, page int, seq int, text string, x double, y double, width double, height double, font_size double"


def test_band_takes_members_in(spark):
    items = spark.createDataFrame([(1, 1, i, "t", 10.0 * i, y, 5.0, 10.0, 10.0) for i, y in enumerate([0.0, 4.0, 8.0, 30.0])], ITEMS)
    assert [r.line for r in folds.band_lines(items).orderBy("seq").collect()] == [1, 1, 2, 3]


def test_list_runs(spark):
    texts = [("1. one", 0.0), ("a) x", 9.0), ("b) y", 9.0), ("2. two", 0.0), ("9. stray", 0.0), ("text", 0.0), ("3. far aside", 50.0)]
    lines = spark.createDataFrame([(1, 1, i, t, x) for i, (t, x) in enumerate(texts, 1)], "doc_id long, page int, line_no int, line string, x double")
    assert sorted((r.line_no, r.value) for r in folds.list_runs(lines).collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_outcomes_of_a_stream(spark, tmp_path):
    schema = "doc_id long, seq int, error string, sparse boolean"
    rows = [(1, 2, "late", True), (1, 1, "early", False), (2, 1, None, True), (2, 2, "x", True)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = batches.merge_outcomes(stream).writeStream.outputMode("update").format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    last = {}
    for r in spark.table("outcomes").collect():
        if r.doc_id not in last or r.tasks > last[r.doc_id].tasks:
            last[r.doc_id] = r
    whole = {r.doc_id: r for r in evaluation.recognition_failures(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r.tasks, r.failed, r.fatal, r.message) for k, r in last.items()} == {k: (r.tasks, r.failed, r.fatal, r.message) for k, r in whole.items()}


def test_batches_equal_the_whole(spark, tmp_path):
    items = spark.createDataFrame([(d, 1, s, "t", 0.0, 10.0 * s, 5.0, 9.0, 9.0) for d in (1, 2) for s in range(5)], ITEMS)
    for d in (1, 2):
        items.filter(F.col("doc_id") == d).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batches.by_batch(batches.read_pages(spark, str(tmp_path / "in"), items.schema), folds.band_lines, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(got.collect()) == sorted(folds.band_lines(items).collect())


def test_plugins(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"%PDF")), ("b.pdf", bytearray(b"bad"))], "path string, content binary")
    assert [r.k for r in files.orderBy("path").select(sniff("content").alias("k")).collect()] == ["pdf", None]

    def decoder(content, password):
        if content != b"%PDF":
            raise ValueError("no document")
        return [{"page": 1, "seq": 1, "text": "hi", "x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0}]

    got = {r.path: (r.text, r.error) for r in plugins.decode_documents(files, decoder).collect()}
    assert got == {"a.pdf": ("hi", None), "b.pdf": (None, "ValueError: no document")}
    calls = []

    def engine(content, language):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return []

    assert plugins.with_retries(engine, sleep=lambda s: None)(b"", "en") == [] and len(calls) == 3


def test_latency_leaves_out_nan(spark):
    runs = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("a", 3.0)], "provider string, v double")
    (r,) = evaluation.latency_summary(runs, ["provider"], "v").collect()
    assert (r.runs, r.total, r.deviation, r.least, r.greatest) == (2, 4.0, 1.0, 1.0, 3.0)


def test_entry_lists_queries_with_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "page_triage" in entry.queries() and "p5_found" in entry.queries()


def test_previews_of_a_stream(spark, tmp_path):
    items = spark.createDataFrame([(1, p, 1, f"page {p}", 0.0, 10.0, 40.0, 9.0, 9.0) for p in (1, 2)], ITEMS)
    items.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "seen")

    def keep(row):
        with open(f"{out}-{row['page']}", "w") as f:
            f.write(row["text"])

    batches.page_previews(batches.read_pages(spark, str(tmp_path / "in"), items.schema), keep, str(tmp_path / "c")).awaitTermination()
    assert [open(f"{out}-{p}").read() for p in (1, 2)] == ["page 1", "page 2"]


def test_features_are_chosen(spark):
    df = spark.range(1).selectExpr("id AS doc_id", "1 AS page", "1 AS seq", "'t' AS text", "0.0 AS x", "0.0 AS y", "1.0 AS width", "1.0 AS height", "7 AS mcid", "'#000' AS fill_color", "'#fff' AS stroke_color")
    assert layout.with_features(df, "tags").columns[-1] == "mcid" and len(layout.with_features(df).columns) == 8
    with pytest.raises(ValueError):
        layout.with_features(df, "smell")
