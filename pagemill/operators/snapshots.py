"""What changed between consecutive full snapshots of a table.

Only hashes travel: each row becomes a 128-bit key hash and a 128-bit hash of the compared columns, equal rows are merged
before the shuffle, and the rows of a hash bucket meet as numpy arrays that are sorted and searched once for each pair of
consecutive snapshots. There are as many buckets as the number of rows asks for. Full values are fetched afterwards, for the
keys that differ only: where these are few, their hashes go to the rows and no other row moves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import map_arrow, written

_SCHEMA = "snap int, k1 bigint, k2 bigint, change_type string"


def _hash128(df: DataFrame, columns: Sequence[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of the columns' exact values; null, empty and neighbouring values stay apart."""
    values = [x for c in columns for x in (df[c].isNull(), df[c])]
    return F.xxhash64(F.lit(0x51ED27), *values), F.xxhash64(F.lit("second half"), *reversed(values))


def _pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    out = np.empty(len(high), [("a", np.int64), ("b", np.int64)])
    out["a"], out["b"] = high, low
    return out


def _rows_in(sought: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the sought values occur in the sorted array."""
    if not len(ordered):
        return np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(ordered, sought), len(ordered) - 1)
    return ordered[at] == sought


def _differ(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys of one snapshot, and for each a digest of its set of row hashes."""
    order = np.lexsort((rows["b"], rows["a"], keys["b"], keys["a"]))
    keys, rows = keys[order], rows[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(first)
    with np.errstate(over="ignore"):
        mixed = (rows["a"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ rows["b"].view(np.uint64)
        again = mixed * np.uint64(0xC2B2AE3D27D4EB4F) + rows["a"].view(np.uint64)
        digest = _pairs(np.add.reduceat(mixed, start).view(np.int64), np.add.reduceat(again, start).view(np.int64)) if len(start) else _pairs(mixed.view(np.int64), again.view(np.int64))
    return keys[start], digest


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    snap, k1, k2, r1, r2 = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    keys, rows = _pairs(k1, k2), _pairs(r1, r2)
    order = np.argsort(snap, kind="stable")
    snaps, starts = np.unique(snap[order], return_index=True)
    bounds = [*starts.tolist(), len(snap)]
    empty = (keys[:0], rows[:0])
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, s in enumerate(snaps.tolist()):
        own = order[bounds[i] : bounds[i + 1]]
        held[s] = _differ(keys[own], rows[own])
    later = sorted({s for s in held} | {s + 1 for s in held})
    for s in later:
        new, new_rows = held.get(s, empty)
        old, old_rows = held.get(s - 1, empty)
        kept = _rows_in(new, old)
        gone = old[~_rows_in(old, new)]
        at = np.searchsorted(old, new[kept]) if kept.any() else np.zeros(0, int)
        changed = new[kept][new_rows[kept] != old_rows[at]]
        for kind, found in (("added", new[~kept]), ("removed", gone), ("changed", changed)):
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), s, np.int32)), pa.array(found["a"].copy()), pa.array(found["b"].copy()), pa.array([kind] * len(found))],
                    ["snap", "k1", "k2", "change_type"],
                )


#: Rows of a bucket, and changes up to which their hashes are broadcast (two rows of about 140 bytes each: 56 MB at most).
BUCKET, FEW = 2_000_000, 200_000


def _changes(df: DataFrame, snapshot: str, keys: Sequence[str], compared: Sequence[str], bucket: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their hashes, and the changes (snap, k1, k2, change_type) as a written table."""
    k1, k2 = _hash128(df, keys)
    r1, r2 = _hash128(df, compared)
    base = df.filter(df[snapshot].isNotNull()).withColumns({"_snap": df[snapshot].cast("int"), "_k1": k1, "_k2": k2})
    compact = base.select(F.col("_snap").alias("snap"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), r1.alias("r1"), r2.alias("r2")).distinct()
    size, first, last = df.agg(F.count("*"), F.min(snapshot), F.max(snapshot)).first()
    found = map_arrow(compact.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // bucket)), "k1"), _compare, _SCHEMA)
    return base, written(found.filter((F.col("snap") > first) & (F.col("snap") <= last)) if size else found.limit(0))


def _met(changes: DataFrame, base: DataFrame, few: int) -> DataFrame:
    """The rows of changed keys in the snapshot of the change ('new') and in the one before ('old')."""
    asked = changes.select("k1", "k2", F.col("snap").alias("later"), "change_type", F.explode(F.array(F.col("snap"), F.col("snap") - 1)).alias("at"))
    own = F.broadcast(asked) if changes.count() <= few else asked
    return base.join(own, (base["_k1"] == asked["k1"]) & (base["_k2"] == asked["k2"]) & (base["_snap"] == asked["at"]))


def snapshot_changes(df: DataFrame, snapshot: str, keys: Sequence[str], compared: Sequence[str], bucket: int = BUCKET, few: int = FEW) -> DataFrame:
    """Changes from each snapshot to the next: (`snapshot`, *`keys`, change_type 'added' | 'removed' | 'changed').

    `snapshot` is an integer column; n is compared with n - 1 for each n after the first that occurs up to the last. A
    snapshot number without rows is an empty snapshot. Repeated rows count once; if a key has several different rows in one
    snapshot, their sets are compared. Nulls are values: a null key part equals a null, a null compared value differs from
    an empty one. Rows with a null snapshot belong to none and are left out. Other columns are not read. An empty table
    gives no rows.
    """
    base, changes = _changes(df.select(snapshot, *keys, *compared), snapshot, keys, compared, bucket)
    met = _met(changes, base.select("_snap", "_k1", "_k2", *keys), few)
    return met.select(F.col("later").alias(snapshot), *keys, "change_type").distinct()


def snapshot_values(df: DataFrame, snapshot: str, keys: Sequence[str], compared: Sequence[str], bucket: int = BUCKET, few: int = FEW) -> DataFrame:
    """The changes of `snapshot_changes` with old_ and new_ values of the compared columns.

    The old values of an added key and the new ones of a removed key are null; of several different rows of a key in one
    snapshot the least counts.
    """
    base, changes = _changes(df.select(snapshot, *keys, *compared), snapshot, keys, compared, bucket)
    met = _met(changes, base.select("_snap", "_k1", "_k2", *keys, *compared), few)
    row = F.struct(*[F.col(c) for c in compared])
    sides = met.groupBy("later", *keys, "change_type").agg(*[F.min(F.when(F.col("at") == F.col("later") - back, row)).alias(side) for side, back in (("new", 0), ("old", 1))])
    return sides.select(F.col("later").alias(snapshot), *keys, "change_type", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("old", "new") for c in compared])
