"""Engines that are called on the executors: decoders of documents, recognition (by HTTP too), glyph tables, parsers and judges.

An engine is a function that is sent to the executors and called there. Calls can be tried again, doubled where one is slow, kept
to a number in flight, and ended after a time.
"""

from __future__ import annotations

import json
import multiprocessing
import random
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import map_arrow, ship_code

#: Engine of a document: bytes and a password (or None) to one dict for each item: page, seq, text, x, y, width, height.
Decoder = Callable[[bytes, str | None], list[dict]]
#: Engine of a picture: bytes and a language to dicts with text, confidence and bbox.
Recogniser = Callable[[bytes, str], list[dict]]


def decode_documents(files: DataFrame, decoder: Decoder, password: str | None = None) -> DataFrame:
    """Items of files (path, content), with a row of null geometry and an error for a file that cannot be decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [r | {"error": None} for r in decoder(content, password)]
                except Exception as e:  # noqa: BLE001 - whatever an engine raises belongs to its file
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                names = ("page", "seq", "text", "x", "y", "width", "height", "error")
                types = (pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.string())
                columns = [pa.array([path] * len(rows)), *(pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["path", *names])

    return map_arrow(files.select("path", "content"), run, "path string, page int, seq int, text string, x double, y double, width double, height double, error string")


def with_retries(engine: Recogniser, attempts: int = 10, first: float = 1.0, most: float = 10.0, fast: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Recogniser:
    """The engine tried again: once soon, then after growing pauses with jitter; the last error is raised."""

    def call(content: bytes, language: str) -> list[dict]:
        for i in range(attempts):
            try:
                return engine(content, language)
            except Exception:  # noqa: BLE001
                if i + 1 == attempts:
                    raise
                sleep(fast if i == 0 else min(most, first * 2 ** (i - 1)) * (0.5 + random.random() / 2))
        return []

    return call


def hedged(engine: Recogniser, after: float = 5.0, copies: int = 2) -> Recogniser:
    """The engine asked again while it has not answered, up to so many times at once; the first answer counts, an error only if all
    fail."""

    def call(content: bytes, language: str) -> list[dict]:
        pool = ThreadPoolExecutor(copies)
        try:
            running = {pool.submit(engine, content, language)}
            started, error = 1, None
            while running:
                done, running = wait(running, after if started < copies else None, FIRST_COMPLETED)
                for d in done:
                    if d.exception() is None:
                        return d.result()
                    error = d.exception()
                if not done and started < copies:
                    running.add(pool.submit(engine, content, language))
                    started += 1
            raise error
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return call


def http_recogniser(url: str, fields: dict[str, str] | None = None, seconds: float = 60.0) -> Recogniser:
    """An engine that posts a picture with its language and free fields to a service and reads either shape of its answers."""

    def call(content: bytes, language: str) -> list[dict]:
        edge = uuid.uuid4().hex
        parts = [f'--{edge}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in ({"language": language} | (fields or {})).items()]
        parts.append(f'--{edge}\r\nContent-Disposition: form-data; name="file"; filename="page.png"\r\nContent-Type: image/png\r\n\r\n'.encode() + content + f"\r\n--{edge}--\r\n".encode())
        request = urllib.request.Request(url, b"".join(parts), {"Content-Type": f"multipart/form-data; boundary={edge}"})
        with urllib.request.urlopen(request, timeout=seconds) as answer:  # noqa: S310 - the caller gives the address
            return read_answer(json.load(answer))

    return call


def read_answer(body: dict) -> list[dict]:
    """Detections of {"results": [...]} or {"lines": [...]}; a box of corners becomes its bounds, with the corners as polygon."""
    out = []
    for r in body.get("results") if body.get("results") is not None else body.get("lines") or []:
        box = r.get("bbox") or r.get("box") or []
        polygon = None
        if box and isinstance(box[0], list | tuple):
            polygon = [[float(v) for v in p] for p in box]
            box = [min(p[0] for p in polygon), min(p[1] for p in polygon), max(p[0] for p in polygon), max(p[1] for p in polygon)]
        out.append({"text": r.get("text") or "", "confidence": float(r.get("confidence", r.get("score", 1.0))), "bbox": [float(v) for v in box], "polygon": polygon})
    return out


def in_window(calls: Iterable[Callable[[], object]], most: int) -> Iterator[tuple[object, Exception | None]]:
    """(result, error) of calls in their order, at most so many of them running; the next begins when one ends."""
    with ThreadPoolExecutor(most) as pool:
        held: list = []
        todo = iter(calls)
        for call in todo:
            held.append(pool.submit(call))
            if len(held) >= most:
                break
        while held:
            first = held.pop(0)
            wait([first])
            if (call := next(todo, None)) is not None:
                held.append(pool.submit(call))
            yield (None, first.exception()) if first.exception() else (first.result(), None)


def recognise(images: DataFrame, engine: Recogniser, language: str = "en", workers: int = 1) -> DataFrame:
    """Outcome of each picture (doc_id, page, seq, content) in its order: (doc_id, page, seq, results, error); each task keeps `workers`
    pictures in flight."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            results, errors = [], []
            for found, error in in_window([lambda c=c: engine(c, language) for c in pdf["content"]], workers):
                rows = None if error else [{"text": r["text"], "confidence": float(r["confidence"]), "bbox": [float(v) for v in r["bbox"]]} for r in found]
                results.append(rows)
                errors.append(f"{type(error).__name__}: {error}" if error else None)
            yield pdf[["doc_id", "page", "seq"]].assign(results=results, error=errors)

    ship_code(images.sparkSession)
    return images.select("doc_id", "page", "seq", "content").mapInPandas(run, "doc_id long, page int, seq int, results array<struct<text:string,confidence:double,bbox:array<double>>>, error string")


def sure_words(words: DataFrame, least: float = 0.3) -> DataFrame:
    """Words of a built-in engine (text, conf in percent) that are sure enough and not blank, with their confidence from 0 to 1."""
    return words.withColumn("confidence", F.col("conf") / 100).filter((F.col("confidence") > least) & (F.trim("text") != "")).drop("conf")


def resolve_glyphs(glyphs: DataFrame, known: DataFrame) -> DataFrame:
    """Glyphs (outline_hash) with the text that a table (outline_hash, text) has for their outline."""
    return glyphs.join(known.groupBy("outline_hash").agg(F.min("text").alias("resolved")), "outline_hash", "left")


class Workers:
    """One process that calls a function and is killed and begun anew if a call takes too long."""

    def __init__(self, fn: Callable, seconds: float):
        self.fn, self.seconds = fn, seconds
        self.process = self.pipe = None

    def _begin(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, other = context.Pipe()
        self.process = context.Process(target=self._serve, args=(other,), daemon=True)
        self.process.start()

    def _serve(self, pipe) -> None:
        while True:
            try:
                pipe.send((self.fn(*pipe.recv()), None))
            except EOFError:
                return
            except Exception as e:  # noqa: BLE001 - sent back to the caller
                pipe.send((None, f"{type(e).__name__}: {e}"))

    def call(self, *args):
        """(result, error); the error of a call that took too long or whose process died is a text too."""
        if self.process is None or not self.process.is_alive():
            self._begin()
        self.pipe.send(args)
        try:
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            error = f"TimeoutError: over {self.seconds:g} seconds"
        except EOFError:
            error = "the process ended"
        self.close()
        return None, error

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
        self.process = None


def parse_pool(files: DataFrame, parse: Callable[[bytes], str], seconds: float) -> DataFrame:
    """(path, result, error) of files (path, content), each parsed in a process of its task that is ended after so many seconds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Workers(parse, seconds)
        try:
            for batch in batches:
                out = [(p, *pool.call(c)) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["path", "result", "error"])
        finally:
            pool.close()

    return map_arrow(files.select("path", "content"), run, "path string, result string, error string")


#: Parsers, answerers and judges of evaluations by name; a caller adds its own.
PROVIDERS: dict[str, Callable] = {}


def provider(name: str) -> Callable[[Callable], Callable]:
    def add(fn: Callable) -> Callable:
        PROVIDERS[name] = fn
        return fn

    return add


def ask(rows: DataFrame, name: str, columns: list[str], fn: Callable | None = None) -> DataFrame:
    """Rows with `result`, `seconds` and `error` of a provider called with the columns' values, one call a row."""
    own = fn or PROVIDERS[name]
    types = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, seconds, errors = [], [], []
            for row in batch.select(columns).to_pylist():
                began = time.perf_counter()
                try:
                    value, error = own(**row), None
                except Exception as e:  # noqa: BLE001 - a row's failure is its own
                    value, error = None, f"{type(e).__name__}: {e}"
                results.append(None if value is None else str(value))
                seconds.append(time.perf_counter() - began)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, pa.string()), pa.array(seconds, pa.float64()), pa.array(errors, pa.string())], [*batch.schema.names, "result", "seconds", "error"])

    wanted = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)
    return map_arrow(rows, run, f"{wanted}, result string, seconds double, error string")
