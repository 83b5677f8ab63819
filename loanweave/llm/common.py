"""Helpers that several operators share."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave.session import scratch_root

#: Bytes of text that a task looks at together; a longer text is looked at alone.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """The rows in the shared checkpoint folder: a lost executor costs no earlier stage, and the plan starts anew."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets the driver's JVM forget finished plans; Spark then deletes their shuffle files, which it keeps as long as a plan is held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query has ended; what it found must have been written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def emptied(spark: SparkSession, path: str) -> None:
    """Frees the space of a table of our own that is read no more."""
    spark.range(0).write.mode("overwrite").parquet(path)


#: A key with more than one in so many of the rows is hot; there are fewer hot keys than this.
HOT_SHARE = 1024


def joined_apart(rows: DataFrame, facts: DataFrame, key: str, times: str, total: int) -> DataFrame:
    """``rows`` with their key's row of ``facts`` (one for each key), which counts in ``times`` how many of the ``total`` rows have the key.

    Rows of hot keys stay where they are: the facts of these are sent to every task, fewer than ``HOT_SHARE`` rows. The others are joined.
    """
    hot = F.col(times) > total / HOT_SHARE
    few = F.broadcast(facts.filter(hot))
    others = rows.join(F.broadcast(facts.filter(hot).select(key)), key, "left_anti").join(facts.filter(~hot), key)
    return rows.join(few, key).unionByName(others).drop(times)


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, by remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column: first row, row after the last, their bytes end to end, and each text's offset in them.

    Null texts have no bytes. A slice has at most ``most`` bytes unless one text alone has more.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, after, data[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first]
        first = after


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = _INSIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word: bytes that ``word`` marks (by default all but white space); words end with their text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class SpanHash:
    """64-bit hashes of many byte ranges at once, from running sums of a polynomial modulo 2**64."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        self._grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[: len(data)], out=self.sums[1:])

    @classmethod
    def _grow(cls, size: int) -> None:
        if len(cls._powers) < size:
            size = max(size, 1 << 20)
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                values = np.full(size, base, np.uint64)
                values[0] = 1
                setattr(cls, name, np.multiply.accumulate(values))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self._inverses[starts]
        return mixed(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits, one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several hashes in their order."""
    total = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        total = mixed(total * np.uint64(0x9FB21C651E98DF25) + part)
    return total


#: Bits of a filter: so many for each key, between these powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 20, 28


class BitFilter:
    """Bits that all of some keys have set; others have them rarely, which costs time alone."""

    def __init__(self, bits: int, words: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - bits)
        self.data = np.zeros(1 << (bits - 6), np.uint64)
        self.data[words] = values

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for k in (keys, keys * np.uint64(0x9E3779B97F4A7C15)):
            place = k >> self.shift
            found &= (self.data[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def bit_filter(rows: DataFrame) -> BitFilter:
    """The filter of a table's ``key``, its words of 64 bits put together by grouping; at most 32 MB however many keys there are."""
    spark = rows.sparkSession
    n = rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["key"].to_numpy().view(np.uint64)
            at = np.concatenate([k >> np.uint64(64 - bits) for k in (keys, keys * np.uint64(0x9E3779B97F4A7C15))])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "value"])

    with shuffles_removed(spark):
        words = rows.select("key").mapInArrow(places, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    return BitFilter(bits, words["word"].to_numpy(), words["value"].to_numpy().view(np.uint64))
