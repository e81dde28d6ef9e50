"""Every query over empty tables, and over tables of nulls."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest

from pagemill.llm import queries

SOURCE = "/root/testdata/sf0.001"
TABLES = ("documents", "text_items", "regression", "page_annotations", "qa_pairs", "qa_results", "qa_eval_results", "eval_passages")


def _folder(tmp_path, nulls: bool) -> str:
    import pyarrow as pa

    for name in TABLES:
        table = pq.read_table(f"{SOURCE}/{name}.parquet")
        if nulls:
            table = pa.table([pa.nulls(3, f.type) for f in table.schema], schema=pa.schema([f.with_nullable(True) for f in table.schema]))
        else:
            table = table.slice(0, 0)
        pq.write_table(table, tmp_path / f"{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    assert queries.queries()[name](spark, _folder(tmp_path, False)).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_percentiles", "p4_found", "p6_found", "p7_ids", "p8_found", "p9_found"])
def test_tables_of_nulls(spark, tmp_path, name):
    rows = queries.queries()[name](spark, _folder(tmp_path, True)).collect()
    assert len(rows) <= 4
