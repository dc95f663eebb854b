"""Shared helpers of the corpus operators: scratch tables, Arrow slicing and vectorised word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Bytes or values that are hashed at once; one longer word is hashed on its own.
PIECE = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words of letters and digits: all ASCII that is neither.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="dealspark-")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark.sparkContext.applicationId)


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/dealspark-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    # shuffle files go once nothing refers to them and the driver has collected its garbage
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Empties scratch tables (of materialise) that nothing will read again."""
    for df in tables:
        if files := df.inputFiles():
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(share: Column | float, *keys: str) -> Column:
    """Whether a row is among the share (0 to 1) that a hash of keys picks, to a precision of 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) < (share if isinstance(share, Column) else F.lit(share)) * float(1 << 53)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse) modulo 2**64."""
    key = int(inverse)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, (int(n) - 1).bit_length())
        steps = np.full(size, _BASE_INV if inverse else _BASE, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= SLICE_BYTES * 4:
            _POWERS[key] = have
    return have[:n]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` values: a polynomial modulo 2**64, finalised; shorter input gives none."""
    out = np.empty(max(0, len(values) - width + 1), np.uint64)
    for at in range(0, len(out), PIECE):
        some = values[at : at + PIECE + width - 1]
        total = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some * powers(len(some)), dtype=np.uint64, out=total[1:])
        runs = len(some) - width + 1
        out[at : at + runs] = mix((total[width:] - total[:runs]) * powers(runs, inverse=True))
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text column of each piece has about `limit` bytes; null text is kept as null."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        width = np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


@dataclass
class Words:
    """Words (runs without ASCII white space) of a column: byte spans, and for each row the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, wherever it stands."""
        out, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(out):
            low = int(self.starts[at])
            end = max(at + 1, int(np.searchsorted(self.ends, low + PIECE, "right")))
            starts, ends = self.starts[at:end] - low, self.ends[at:end] - low
            data = self.data[low : low + int(ends[-1])]
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), dtype=np.uint64, out=total[1:])
            out[at:end] = mix((total[ends] - total[starts]) * powers(len(data), inverse=True)[starts] + (ends - starts).astype(np.uint64))
            at = end
        return out


def split_words(texts: pa.Array, between: np.ndarray = _SPACE) -> Words:
    """between: which bytes separate words."""
    data, offsets = buffers(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    space = between[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[inner] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
