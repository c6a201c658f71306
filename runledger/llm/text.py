"""Shared pieces of the text operators: words, hashes, batches, stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only white space that the operators know.
SPACES = " \t\n\x0b\x0c\r"

#: Rows that are worked on at a time.
SLICE_ROWS = 500

#: Bytes of a text with A-Z lower-cased and every ASCII byte that is no letter or digit made a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def folded_words(data: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return data.translate(_FOLD).split()


class WordHashes(dict):
    """64-bit hashes of words, computed once per distinct word and forgotten when too many."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for every run of ``width`` words; one for the whole text if it has fewer, none if empty."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    last = len(hashes) - width + 1
    out = np.zeros(last, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + last]
    return mix(out + np.uint64(width))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null is an empty text."""
    return [data or b"" for data in column.cast(pa.binary()).to_pylist()]


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that an operator reads; others may have any name."""
    return docs.select("doc_id", "text")


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that few texts at a time become Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType
) -> DataFrame:
    """``work`` on every Arrow batch; ``work`` may hold caches, each task has its own copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield work(batch)

    return df.mapInArrow(run, schema)


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that names of an operator's own cannot clash."""
    return docs.select(F.struct("*").alias("row"))
