"""What the operators share: scratch tables, and word and byte arrays over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundcast.session import scratch_path

#: Bytes of text that numpy looks at together; a longer text is looked at alone.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the copy: lineage ends, nothing runs twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the marks that ``parted`` broadcasts: 4 MB, however many keys there are.
MARK_BITS = 1 << 25


def parted(df: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``columns`` may be among ``keys``, and those that surely are not.

    So only the first have to meet ``keys`` in a shuffle. Every key sets one bit, so a key more than the bits can tell
    apart is a row too many in the first part, never one too few. ``keys`` is read for each part: a stored table.
    """
    bit = F.pmod(F.xxhash64(*columns), F.lit(MARK_BITS)) + 1
    at = F.bitmap_bit_position(bit)
    placed = keys.select(F.bitmap_bucket_number(bit).alias("__bucket"), at.alias("__at"))
    marks = placed.groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    # at most 1,024 rows of 4 KB
    met = df.withColumn("__bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(marks), "__bucket", "left")
    return met.where(found).select(*df.columns), met.where(~found).select(*df.columns)


def text_key(text: Column) -> Column:
    """Tells rows that share an id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the hash base and of its inverse, as far as asked for yet."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> Powers:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), CHUNK_BYTES + 1)
            self.up = np.full(size, BASE, np.uint64)
            self.down = np.full(size, INVERSE, np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self


POWERS = Powers()


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of codes times powers, so that the hash of any slice takes one subtraction."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * POWERS.to(len(codes) + 1).up[: len(codes)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * POWERS.down[start])


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first and last row, their bytes, and each text's first byte, with the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(last, first + 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words_of(data: np.ndarray, starts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each text's first word, with the end. letters: which bytes are in words."""
    inside = letters[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    begins = starts[:-1]
    if len(data):
        before[begins[begins < len(data)]] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    ends = starts[1:]
    if len(data):
        after[ends[ends > 0] - 1] = False
    first = np.flatnonzero(inside & ~before)
    return first, np.flatnonzero(inside & ~after) + 1, np.searchsorted(first, starts)


#: Bytes outside white space.
VISIBLE = np.ones(256, bool)
VISIBLE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, lower-case letters and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower case of A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
