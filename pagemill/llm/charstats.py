"""Corpus statistics of adjacent characters, shared by the repair of garbled and of look-alike text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import map_arrow

#: Character classes: below 0x600 each character has its own, blanks and line ends share class 0, the rest goes by blocks.
CLASSES = 2048
#: How many times rarer than expected a pair must be to be improbable: its mutual information lies below -log2 of it.
FLOOR = 8.0
IMPROBABLE = -3.0
_BLANK = re.compile(r"\s")
#: Signs of text read with a wrong encoding; such texts are kept out of the statistics of sound text.
DOUBTFUL = re.compile(
    "[\u0080-\u009f�─-◿]|[¡-ÿ]{3}|[Â-ô][\u00a0-¿ƒˆ˜–-›€™]"
    "|[a-zß-öø-ÿ][À-ÖØ-ÞŠŒŽŸ]|[^\\W\\d_][‚„†‡ˆ‰‹›™˜•€¢£¤¥§¨«¶·¸»¿¡][^\\W\\d_]"
    "|[¢¤¦¨¬¯±´¶¸¹¼¾×÷ˆ-˝†‡‰∏∑√∫≈≠-≥◊][^\\W\\d_]|[^\\W\\d_][ˆ-˝†‡‰∏∑√∫≈≠-≥◊¢¤¦¨¯±´¶]|[^\\W\\d_]—[^\\W\\d_]"
)


@cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, 1905, np.int32)
    table[:0x600] = np.arange(0x600)
    table[0x600:0x1E00] = 1910 + (np.arange(0x600, 0x1E00) - 0x600) // 0x80
    table[0x1E00:0x2000] = 1536 + np.arange(0x200) // 8
    table[0x2000:0x2300] = 1600 + np.arange(0x300) // 4
    table[0x2300:0x2600] = 1792 + np.arange(0x300) // 16
    table[0x3000:0x3040] = 1902
    table[0x3040:0x3100] = 1900
    table[0x3400:0xA000] = 1901
    table[0xFF00:0xFFF0] = 1903
    table[0xFF61:0xFFA0] = 1907
    table[0xFB00:0xFB50] = 1904
    table[0xFFFD] = 1906
    for p in (*range(0x3001), 0x3000):
        if _BLANK.match(chr(p)) and not 0x80 <= p < 0xA0:
            table[p] = 0
    return table


def classes(text: str) -> np.ndarray:
    return class_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def pair_counts(df: DataFrame, text: str, sound: bool = False) -> DataFrame:
    """Counts (pair INT, n BIGINT) of adjacent character classes over all texts, each bounded by blanks; pair is first *
    CLASSES + second. `sound` leaves out texts with signs of a wrong encoding. Null texts count nothing.

    Each task counts in one array of CLASSES^2; what is shuffled is at most that many rows of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            if sound:
                texts = [t for t in texts if t.isascii() or not DOUBTFUL.search(t)]
            for i in range(0, len(texts), 2000):
                own = classes("\n" + "\n".join(texts[i : i + 2000]) + "\n")
                total += np.bincount(own[:-1] * CLASSES + own[1:], minlength=CLASSES * CLASSES)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["pair", "n"])

    return map_arrow(df.select(text), run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


class PairModel:
    """Log probabilities of adjacent characters. Its table has CLASSES^2 cells at any corpus size (16 MB)."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        table = np.zeros(CLASSES * CLASSES, np.float32)
        table[pairs] = counts
        self.seen = pairs, counts
        self.counts = table.reshape(CLASSES, CLASSES)
        capitals = np.array([p for p in range(0x41, 0x600) if chr(p).isupper() and len(chr(p).lower()) == 1 and ord(chr(p).lower()) < 0x600])
        small = np.array([ord(chr(p).lower()) for p in capitals])
        lower = self.counts[np.ix_(small, small)]
        self.counts[np.ix_(capitals, capitals)] += 0.2 * lower  # capitals are rarer than the pairs they stand for
        self.counts[0, capitals] += 0.1 * self.counts[0, small]
        self.counts[np.ix_(capitals, small)] += 0.02 * lower
        self.total = float(table.sum()) or 1.0
        self.firsts, self.seconds = self.counts.sum(1), self.counts.sum(0)
        self.joint = np.log2((self.counts + 0.3) / self.total)
        #: Bits of the second character given the first.
        self.given = np.log2((self.counts + 0.3) / (self.firsts[:, None] + 20))
        #: Least number of occurrences that sound text is expected to have of any pair.
        self.floor = FLOOR * max(2.0, 2e-6 * self.total)

    @classmethod
    def of(cls, counts: DataFrame) -> PairModel:
        """Collected on the driver: at most CLASSES^2 rows, whatever the corpus."""
        rows = counts.toPandas()
        return cls(rows["pair"].to_numpy(), rows["n"].to_numpy())

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        return self.seen

    def bits(self, text: str) -> np.ndarray:
        """Log probability of each adjacent pair of a text between two blanks."""
        own = classes(f" {text} ")
        return self.joint[own[:-1], own[1:]]

    def mutual(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Pointwise mutual information of pairs of classes, in bits. The expected count of a pair is `floor` at least: two
        rare characters that never meet are as telling as two frequent ones."""
        expected = self.firsts[first] * self.seconds[second] / self.total
        return np.log2((self.counts[first, second] + 0.05) / np.maximum(expected, self.floor))

    def information(self, text: str) -> np.ndarray:
        """Pointwise mutual information of each adjacent pair of a text between two blanks, in bits."""
        own = classes(f" {text} ")
        return self.mutual(own[:-1], own[1:])


_models: dict[int, PairModel] = {}


def model_of(sent) -> PairModel:
    """The model of a broadcast (pairs, counts), made once in each Python worker."""
    pairs, counts = sent.value
    key = hash((len(pairs), pairs.tobytes(), counts.tobytes()))
    if key not in _models:
        _models.clear()
        _models[key] = PairModel(pairs, counts)
    return _models[key]
