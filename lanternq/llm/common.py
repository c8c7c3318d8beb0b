"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_scratch, fresh_path, shared_dir, written  # noqa: F401

#: ASCII white space as the query contracts define it.
BLANKS = r"[\x20\x09-\x0D]+"

def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs written with a number for each row, and that column's name.

    Numbers from a scan depend on how its files are split, which changes with
    the executors at hand, so no later plan may derive them again.
    """
    number = unused(docs, "_row")
    return written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered"), number


def kept_rows(stored: DataFrame, number: str, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of a table made by ``numbered`` whose numbers are (left_anti:
    are not) in ``rows`` (column row), without the number."""
    out = stored.join(rows.select(F.col("row").alias(number)), number, how)
    return out.select(*(f"`{c}`" for c in stored.columns if c != number))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose values in a column of texts or bytes have about
    size bytes together, a longer value by itself."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0))
    start = held = 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def resting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; at the end of a task it gives freed memory back to
    the system, as the worker lives on while later stages need the room."""

    def rested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return rested


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable
    ones stand for themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Remembered(dict):
    """What ``make`` gives for each key met.

    Beyond ``megabytes`` of keys and values, those not met again since the last
    such turn are forgotten, which bounds the memory of a worker at twice that.
    Keys of more than ``longest`` characters are made anew each time.
    """

    def __init__(self, make: Callable[[str], object], megabytes: int, longest: int = sys.maxsize):
        self.make, self.limit, self.longest = make, megabytes << 20, longest
        self.older, self.held = {}, 0

    def __missing__(self, key: str) -> object:
        if len(key) > self.longest:
            return self.make(key)
        if self.held >= self.limit:
            self.older, self.held = dict(self), 0
            self.clear()
        value = self.older.get(key)
        self[key] = value = self.make(key) if value is None else value
        self.held += sys.getsizeof(key) + sys.getsizeof(value) + SLOT_BYTES
        return value

    def forget(self) -> None:
        self.clear()
        self.older, self.held = {}, 0


#: What a dictionary takes for an entry besides its key and value.
SLOT_BYTES = 104
