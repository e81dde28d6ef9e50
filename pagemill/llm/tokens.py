"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 7)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.bpe import Encoder, decode, read_ranks
from pagemill.runtime import map_arrow

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZERS = os.environ.get("PAGEMILL_TOKENIZERS", "/opt/tokenizers")
_encoders: dict[int, Encoder] = {}


def vocabulary(df: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The vocabulary file as a broadcast: under 1 MB, whatever the data."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encoder(ranks: bytes) -> Encoder:
    """The encoder of this Python worker, made once."""
    key = hash(ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(ranks))
    return _encoders[key]


def encode_texts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Token ids of every row's text: (`key`, ids ARRAY<INT>), one row for each input row.

    Null and empty texts get an empty list; blank texts are encoded like any other. Strings of special tokens in a text
    are ordinary text. Null keys and repeated rows come out as they come in; other columns are not read. One pass, no
    shuffle: the scan reads two columns and each Arrow batch is encoded in numpy.
    """
    ranks = vocabulary(df, tokenizer, folder)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks.value)
        for batch in batches:
            ids, counts = e.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], counts.cumsum()]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "ids"])

    out = map_arrow(df.select(df[key].alias("key"), df[text].alias("text")), run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def decode_texts(df: DataFrame, key: str, ids: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Texts of token ids: (`key`, text STRING), one row for each input row; null and empty lists give an empty text.

    An id that the vocabulary lacks raises an error; bytes that are no UTF-8 become U+FFFD. One pass, no shuffle.
    """
    ranks = vocabulary(df, tokenizer, folder)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(ranks.value).transducer.bytes_of
        for batch in batches:
            texts = [decode(own or (), known) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    out = map_arrow(df.select(df[key].alias("key"), df[ids].alias("ids")), run, f"key {kind}, text string")
    return out.withColumnRenamed("key", key)
