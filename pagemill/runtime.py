"""Session services every operator shares: tables, code shipping, checkpoints, Arrow partition functions."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROOT = Path(__file__).resolve().parent.parent
_lock = threading.Lock()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers; a no-op where PYTHONPATH already has it."""
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    with _lock:
        if str(ROOT) in paths or getattr(sc, "_pagemill_shipped", False):
            return
        package = ROOT / "pagemill"
        if not package.is_dir():
            return
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        # The driver serves this file to the executors over its own file server.
        target = Path(tempfile.mkdtemp(prefix="pagemill-code-")) / "pagemill.zip"
        target.write_bytes(buffer.getvalue())
        sc.addPyFile(str(target))
        sc._pagemill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors can read. Where it is unset, a local one serves a local master, as
    in tests; on a cluster that would lose data, so it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagemill-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder, read back: lineage is cut, nothing is computed twice.

    `clear_written` deletes these tables; it also runs when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(clear_written, spark)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


_tables: list[str] = []


def clear_written(spark: SparkSession) -> None:
    """Deletes the tables that `written` made. Results that still read them must have been stored before."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while _tables:
            path = jvm.org.apache.hadoop.fs.Path(_tables.pop())
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        _tables.clear()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with the package shipped to the workers."""
    ship_code(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[dict[str, list]], Iterable[tuple]], schema: str) -> DataFrame:
    """A function over each group's rows in order, for state that no window has.

    One exchange by the keys brings groups together and sorts them; then whole Arrow batches run through one Python call
    after the other, a group as lists by column. A task holds one group at a time. `fn` yields rows of the schema.
    """
    names = df.columns
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        now: tuple | None = None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            own = list(zip(*(columns[names.index(k)] for k in keys), strict=True))
            out: list[tuple] = []
            begin = 0
            for i in range(len(own) + 1):
                if i < len(own) and (own[i] == now):
                    continue
                for h, c in zip(held, columns, strict=True):
                    h += c[begin:i]
                begin = i
                if i < len(own):
                    if held[0]:
                        out += fn(dict(zip(names, held, strict=True)))
                    held, now = [[] for _ in names], own[i]
            if out:
                yield rows(out)
        if held[0] and (out := list(fn(dict(zip(names, held, strict=True))))):
            yield rows(out)

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys, *order), run, schema)
