"""Percentiles of large columns by deterministic buffer collapsing (problem 3).

A sketch has one buffer for each weight 1, 2, 4, ... Values enter the unsorted buffer of weight 1; when a buffer reaches
2k values it is sorted and every second value moves to the buffer of twice the weight, from the first or the second in turn.
All collapses at one weight w move at most n / (2 k w) buffers, each shifting ranks by at most w, so a tree of h levels
errs by at most h / (2 k) of n whatever the order of merging: under 0.8 % for k = 2048 and 2^31 * k values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.runtime import map_arrow

#: Size of a buffer, values that a task holds before it passes sketches on, and parts that a file's rows are spread over.
K, HELD, SALTS = 2048, 8_000_000, 8


class Sketch:
    """Mergeable quantile sketch of doubles."""

    def __init__(self, k: int = K):
        self.k = k
        self.levels: list[np.ndarray] = []
        self.turns: list[int] = []

    def _put(self, level: int, values: np.ndarray) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.zeros(0))
            self.turns.append(0)
        self.levels[level] = np.concatenate([self.levels[level], values])
        while len(self.levels[level]) >= 2 * self.k:
            buffer = np.sort(self.levels[level], kind="stable")
            whole = len(buffer) // 2 * 2
            self.levels[level] = buffer[whole:]
            passed = buffer[self.turns[level] : whole : 2]
            self.turns[level] ^= 1
            level += 1
            if len(self.levels) <= level:
                self.levels.append(np.zeros(0))
                self.turns.append(0)
            self.levels[level] = np.concatenate([self.levels[level], passed])

    def add(self, values: np.ndarray) -> None:
        for i in range(0, len(values), 2 * self.k):
            self._put(0, values[i : i + 2 * self.k])

    def merge(self, levels: Sequence[np.ndarray]) -> None:
        for level, values in enumerate(levels):
            for i in range(0, len(values), 2 * self.k):
                self._put(level, values[i : i + 2 * self.k])

    def count(self) -> int:
        return sum(len(v) << i for i, v in enumerate(self.levels))

    def quantiles(self, shares: Sequence[float]) -> list[float | None]:
        """For each share p the least kept value whose weight, with all before it, reaches p of the whole."""
        if not self.count():
            return [None] * len(shares)
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << i, np.int64) for i, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        upto = weights[order].cumsum()
        at = np.searchsorted(upto, np.ceil(np.array(shares) * upto[-1]).clip(1), "left")
        return values[order][np.minimum(at, len(values) - 1)].tolist()


def _rows(held: Iterable[tuple[tuple, Sketch]], names: Sequence[str], types: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Sketches as rows, a few at a time."""
    items = iter(held)
    while part := list(islice(items, 64)):
        keys = [pa.array([k[j] for k, _ in part], t) for j, t in enumerate(types)]
        sizes = [[len(v) for v in s.levels] for _, s in part]
        values = pa.array(np.concatenate([v for _, s in part for v in s.levels] or [np.zeros(0)]))
        inner = pa.ListArray.from_arrays(_offsets([n for own in sizes for n in own]), values)
        levels = pa.ListArray.from_arrays(_offsets([len(own) for own in sizes]), inner)
        yield pa.RecordBatch.from_arrays([*keys, levels], [*names, "levels"])


def _offsets(sizes: Sequence[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32))


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", levels array<array<double>>"


def build(df: DataFrame, keys: Sequence[str], values: str, k: int = K) -> DataFrame:
    """Sketches (*`keys`, levels) of an ARRAY<DOUBLE> column, at least one for each group and partition; nulls and NaN are left
    out.

    The first of the two aggregation steps: it runs where the rows are and shuffles nothing. A task that holds over HELD
    values, because it meets very many groups, passes its sketches on and starts anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        types: list[pa.DataType] = []
        size = 0
        for batch in batches:
            types = [c.type for c in batch.columns[:-1]]
            lists = batch.columns[-1]
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            codes = np.zeros(batch.num_rows, np.int64)
            encoded = [c.dictionary_encode(null_encoding="encode") for c in batch.columns[:-1]]
            for e in encoded:
                codes = codes * max(1, len(e.dictionary)) + e.indices.to_numpy(zero_copy_only=False)
            unique, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
            rows = batch.select(range(len(encoded))).take(pa.array(first)).to_pylist()
            which = np.repeat(inverse, sizes)
            good = ~np.isnan(flat)
            order = np.argsort(which[good], kind="stable")
            ordered = flat[good][order]
            bounds = np.searchsorted(which[good][order], np.arange(len(unique) + 1))
            for i, row in enumerate(rows):
                key = tuple(row.values())
                if key not in held:
                    held[key] = Sketch(k)
                    size += 64
                held[key].add(ordered[bounds[i] : bounds[i + 1]])
            size += len(ordered)
            if size > HELD:
                size = sum(64 + sum(map(len, s.levels)) for s in held.values())
                if size > HELD // 2:
                    yield from _rows(held.items(), list(keys), types)
                    held, size = {}, 0
        yield from _rows(held.items(), list(keys), types)

    return map_arrow(df.select(*keys, df[values].cast("array<double>").alias("values")), run, _schema(df, keys))


def _fold(batches: Iterator[pa.RecordBatch], keys: Sequence[str], k: int) -> Iterator[pa.RecordBatch]:
    """Merges the sketches of rows that follow each other with equal keys: one sketch is held at a time."""
    types: list[pa.DataType] = []

    def merged() -> Iterator[tuple[tuple, Sketch]]:
        now, own = None, Sketch(k)
        for batch in batches:
            types[:] = [c.type for c in batch.columns[: len(keys)]]
            for i, row in enumerate(batch.select(range(len(keys))).to_pylist()):
                key = tuple(row.values())
                if now is not None and key != now:
                    yield now, own
                    own = Sketch(k)
                now = key
                lists = batch.columns[-1][i].values
                if lists is not None:
                    own.merge([lists[j].values.to_numpy(zero_copy_only=False) if lists[j].values is not None else np.zeros(0) for j in range(len(lists))])
        if now is not None:
            yield now, own

    yield from _rows(merged(), list(keys), types)


def combine(sketches: DataFrame, keys: Sequence[str], k: int = K, fan_in: int = 64, whole: bool = True) -> DataFrame:
    """Merges sketches to one for each group, in a tree: first up to `fan_in` salted parts of a group, then these.

    Rows meet in the order of their keys, so a task holds one bounded sketch, however many groups or rows it has. Without
    `whole` the parts stay as they are: sketches of a group that can be combined later with others.
    """
    wanted = _schema(sketches, keys)
    salted = sketches.select(*keys, "levels").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    own = salted.repartition(*keys, "salt").sortWithinPartitions(*keys, "salt")
    parts = map_arrow(own.select(*keys, "levels"), lambda batches: _fold(batches, keys, k), wanted)
    if not whole:
        return parts
    return map_arrow(parts.repartition(*keys).sortWithinPartitions(*keys), lambda batches: _fold(batches, keys, k), wanted)


def percentiles(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The sketches' count `n` and, under `names`, their values at `shares`; null for a group without values."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sketches.select(*keys).schema)
    wanted = f"{types}, n bigint, " + ", ".join(f"`{n}` double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for levels in batch.columns[-1].to_pylist():
                s = Sketch()
                s.levels = [np.array(v, float) for v in levels or []]
                counts.append(s.count())
                found.append(s.quantiles(shares))
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), *columns], [*keys, "n", *names])

    return map_arrow(sketches.select(*keys, "levels"), run, wanted)


SHARES, NAMES = (0.5, 0.9, 0.95, 0.99), ("p50", "p90", "p95", "p99")


def daily_latency_sketches(results: DataFrame, annotations: DataFrame) -> DataFrame:
    """Sketches (document_type, provider, metric, day, levels) of parse latencies and of single latencies.

    Each eval_id counts once: of rows that repeat it within a file the least by content counts; rows without an eval_id
    count once for each content. Files without an annotation or with a null type come under a null document_type, a null
    provider under ''. A day can come in several sketches; they can be kept, and those of any days and loads combine in
    `latency_percentiles`.

    Rows with their arrays move once, by file and a salt of the eval_id: there they meet the file's type, and repeated rows
    meet each other. A file with a third of all rows is spread over SALTS parts.
    """
    types = annotations.filter(F.col("document_type").isNotNull()).groupBy("file").agg(F.min("document_type").alias("document_type"))
    facts = results.select("eval_id", "file", F.coalesce("provider", F.lit("")).alias("provider"), F.to_date("run_at").alias("day"), F.col("parse_latency_seconds").alias("parse"), "latencies")
    content = F.xxhash64("provider", "day", "parse", F.to_json("latencies"))
    placed = facts.withColumn("content", content).withColumn("own", F.coalesce("eval_id", "content")).withColumn("salt", F.pmod(F.xxhash64("own"), F.lit(SALTS)).cast("int"))
    same = Window.partitionBy("file", "salt", "own", F.col("eval_id").isNull()).orderBy("content")
    once = placed.repartition("file", "salt").withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    spread = types.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    typed = once.join(spread, ["file", "salt"], "left")
    both = typed.select(
        "document_type", "provider", "day",
        F.explode(F.array(
            F.struct(F.lit("parse_latency_seconds").alias("metric"), F.array("parse").alias("values")),
            F.struct(F.lit("latencies").alias("metric"), F.col("latencies").alias("values")),
        )).alias("m"),
    ).select("document_type", "provider", "m.metric", "day", "m.values")
    return combine(build(both, ["document_type", "provider", "metric", "day"], "values"), ["document_type", "provider", "metric", "day"], whole=False)


def latency_percentiles(daily: DataFrame) -> DataFrame:
    """Daily sketches combined to the percentiles of each document_type (provider '*') and of each provider in it."""
    keys = ["document_type", "provider", "metric"]
    levels = daily.select("document_type", F.explode(F.array("provider", F.lit("*"))).alias("provider"), "metric", "levels")
    return percentiles(combine(levels, keys), keys, SHARES, NAMES)
