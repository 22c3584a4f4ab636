"""What the operators share: the shared folder, written tables, Arrow text buffers and hashes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import session

#: Bytes of text that a numpy step looks at together; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20

#: Bytes of an Arrow batch between the JVM and Python; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20

_WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and keep Arrow batches small enough for several workers on an executor."""
    session.ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one on a single machine (tests), an error on a cluster."""
    return session.shared_folder(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, runs Python stages once.

    The driver's garbage is collected afterwards so that Spark drops the shuffle files behind the table.
    """
    spark = df.sparkSession
    path, schema = fresh_path(spark, name), df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() gave and that nothing reads any more."""
    path = df._written_at
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete what the operators of this process have written to the shared folder, once no result needs it any more."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def trim() -> None:
    """Give memory that is free in this process back to the machine, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run: Callable) -> Callable:
    """run for mapInArrow, whose worker keeps no free memory when its task is over: it may idle beside other stages' workers."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about `limit` bytes, each with its UTF-8 bytes in one array and its rows' offsets there."""
    for batch in batches:
        whole = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_binary())
        if not len(whole):
            continue
        lengths = pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < len(whole):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            part = whole.slice(start, stop - start)
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            raw = part.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            yield batch.slice(start, stop - start), data[offsets[0] : offsets[-1]], offsets - offsets[0]
            start = stop


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of runs in a sequence of values: hash = sum(value[j] * BASE**(j - start))."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(n, 2 * len(self.powers)) + 1
            with np.errstate(over="ignore"):
                one = np.ones(1, _U)
                self.powers = np.concatenate([one, np.cumprod(np.full(n, self.base, _U), dtype=_U)])
                self.inverses = np.concatenate([one, np.cumprod(np.full(n, self.inverse, _U), dtype=_U)])

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of values[starts[i]:ends[i]] for every i."""
        n = len(values)
        self._grow(n)
        sums = np.zeros(n + 1, _U)
        np.cumsum(values * self.powers[:n], dtype=_U, out=sums[1:])
        return (sums[ends] - sums[starts]) * self.inverses[starts]


_BYTES = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = Rolling(0xD1342543DE82EF97)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+ and, per document, where its words begin in them."""
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z as a-z if lower), over blocks of bounded size."""
    out, values = np.empty(len(starts), _U), _LOWER if lower else _BYTES
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 20))))
        base = starts[at]
        out[at:stop] = _WORD.runs(values[data[base : ends[stop - 1]]], starts[at:stop] - base, ends[at:stop] - base)
        at = stop
    return mix64(out + (ends - starts).astype(_U))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit words as Spark longs."""
    return np.ascontiguousarray(x).view(np.int64)
