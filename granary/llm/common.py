"""What the operators share: tables, the shared work folder, and numpy views of Arrow text columns."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step inside a task works on; a longer document is a step of its own.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; removed when the driver ends.

    Where the setting is absent the driver's temporary folder is used, if the session runs on one machine; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = f"file://{tempfile.gettempdir()}/granary-shared"
    path = f"{root.rstrip('/')}/granary-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before
        pass


def shared_table(df: DataFrame, path: str) -> DataFrame:
    """Write df below a shared folder and read it again: this cuts its lineage and survives lost executors."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile the shuffle files of each query are removed when it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of keys that are broadcast to drop or keep rows (some 30 bytes each); more of them are joined by a shuffle.
MOST_BROADCAST = 500_000


def without(docs: DataFrame, keys: DataFrame, condition: Column, work: str) -> DataFrame:
    """The rows of docs for which no row of keys fulfils the condition. keys is written first, so its size is known."""
    keys = shared_table(keys, f"{work}/without")
    return docs.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, condition, "left_anti")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as keep them apart from df's columns."""
    have = {c.lower() for c in df.columns}
    while any(n.lower() in have for n in names):
        names = tuple(f"_{n}" for n in names)
    return list(names)


def every_column(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Rows of an Arrow batch on its way to Python; texts are long, and a batch is held on both sides.
BATCH_ROWS = 1000


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering its session's limit of rows in an Arrow batch to BATCH_ROWS, unless it is lower."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def give_back() -> None:
    """Return memory that this process has freed to the system: a Python worker outlives its task, and what it keeps counts to its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with memory given back when the task's rows end."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def giving_back_each(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run, with memory given back after each group."""

    def wrapped(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            give_back()

    return wrapped


def text_column() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).alias("text")


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose column has about so many bytes."""
    if batch.num_rows == 0:
        return
    ends = text_bytes(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + budget, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text or binary column without nulls, and its n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def code_points(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, the documents' offsets in them, and the byte offset of each code point (one more at the end)."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.searchsorted(at, off), np.append(at, len(raw))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Longer tables of powers, for the longest texts, are not remembered.
MOST_POWERS = 1 << 23
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and those of its inverse."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both: list[np.ndarray] = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        have = tuple(both)
        if size <= MOST_POWERS:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


class Fingerprints:
    """64-bit fingerprints of any substrings of one sequence, from sums of prefix terms (modulo 2**64)."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        up, self.down = powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Of all windows of one size, by start."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size)) if n > 0 else np.zeros(0, np.uint64)


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+ of all documents, and each word's document."""
    inner = ~WHITE[raw]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    last = inner.copy()
    last[:-1] &= ~inner[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inner[cuts]  # a word never crosses into the next document
    last[cuts - 1] = inner[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1
