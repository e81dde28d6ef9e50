"""Roll-ups of evaluation runs and of recognition outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_summary(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, total, mean, least, greatest and population deviation of seconds; null and NaN are left out."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    known = runs.withColumn("_v", v).filter(F.col("_v").isNotNull())
    return known.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.round(F.sum("_v"), 3).alias("total"), F.round(F.avg("_v"), 4).alias("mean"), F.min("_v").alias("least"), F.max("_v").alias("greatest"), F.round(F.coalesce(F.stddev_pop("_v"), F.lit(0.0)), 4).alias("deviation")
    )


def pass_rates(results: DataFrame, key: str) -> DataFrame:
    """Question-weighted pass rates of each key and, with a null key, of all: a roll-up of rate times questions."""
    known = results.filter(F.col("total_questions").isNotNull() & F.col("llm_judge_pass_rate").isNotNull() & ~F.isnan("llm_judge_pass_rate"))
    return known.rollup(key).agg(F.sum("total_questions").alias("questions"), F.round(F.sum(F.col("llm_judge_pass_rate") * F.col("total_questions")) / F.nullif(F.sum("total_questions"), F.lit(0)), 4).alias("rate"))


def provider_cells(results: DataFrame, rows: str, column: str, value: str) -> DataFrame:
    """(`rows`, `column`, runs, mean): the cells of a table with the mean of a value, 'TOTAL' for all rows, 'AVG' for all columns.

    A cube with one row for each cell; it grows with the cells that occur, whatever the number of columns. Null keys are left
    out, null and NaN values count as runs without a value.
    """
    known = results.filter(F.col(rows).isNotNull() & F.col(column).isNotNull()).withColumn("_v", F.nanvl(F.col(value), F.lit(None).cast("double")))
    cells = known.cube(rows, column).agg(F.count("*").alias("runs"), F.round(F.avg("_v"), 9).alias("mean")).filter(F.col("runs") > 0)
    return cells.withColumn(rows, F.coalesce(rows, F.lit("TOTAL"))).withColumn(column, F.coalesce(column, F.lit("AVG")))


def provider_table(results: DataFrame, rows: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """The same as a table of a fixed list of columns, with a TOTAL row."""
    known = results.withColumn("_v", F.nanvl(F.col(value), F.lit(None).cast("double")))
    cells = [F.round(F.avg(F.when(F.col(column) == c, F.col("_v"))), 9).alias(c) for c in columns]
    return known.filter(F.col(rows).isNotNull()).rollup(rows).agg(*cells).withColumn(rows, F.coalesce(rows, F.lit("TOTAL")))


def recognition_failures(outcomes: DataFrame) -> DataFrame:
    """(doc_id, tasks, failed, fatal, message): fatal if all tasks failed and one on a sparse page; the first message counts."""
    failed = F.col("error").isNotNull()
    sums = outcomes.groupBy("doc_id").agg(F.count("*").alias("tasks"), F.count_if(failed).alias("failed"), F.max(failed & F.col("sparse")).alias("on_sparse"), F.min(F.when(failed, F.struct("seq", "error")))["error"].alias("first"))
    fatal = (F.col("failed") == F.col("tasks")) & F.col("on_sparse")
    return sums.select("doc_id", "tasks", "failed", fatal.alias("fatal"), F.when(fatal, F.col("first")).alias("message"))


def parse_recognition(responses: DataFrame, body: str = "body") -> DataFrame:
    """Detections of the two response shapes of a recognition service: (id, text, confidence, bbox)."""
    words = "array<struct<text:string,confidence:double,bbox:array<double>>>"
    parsed = F.coalesce(F.from_json(body, f"struct<results:{words}>")["results"], F.from_json(body, f"struct<lines:{words}>")["lines"])
    return responses.select("id", F.explode(parsed).alias("r")).select("id", "r.text", "r.confidence", "r.bbox").filter(F.col("confidence") > 0.1)


def match_ground_truth(documents: DataFrame, truth: DataFrame) -> DataFrame:
    """Documents with the truth of the same file stem; documents without one have matched false."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]+$", "")
    known = truth.select(stem(F.col("file")).alias("stem")).distinct().withColumn("matched", F.lit(True))
    return documents.withColumn("stem", stem(F.col("file_name"))).join(known, "stem", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
