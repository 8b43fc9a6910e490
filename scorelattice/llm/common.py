"""What several operators share: vectorised word hashes, shared scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that part words: space and \x09-\x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
WORD = r"[^\x20\x09-\x0D]+"
#: A document without an id sorts after all others.
NO_ID = 2**63 - 1
#: Text that is hashed in one go: its arrays stay in the processor's cache.
CHUNK_BYTES = 400_000
#: Bounds of what an operator gets at a time, so that long texts don't add up in a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: A longer word is hashed by itself.
LONG_WORD = 256
#: Scratch tables that are still there, with their sessions.
_scratch: dict[str, SparkSession] = {}


# --- scratch tables -------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session without a cluster may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own_folder()
    return found.rstrip("/")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="scorelattice-")


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors.

    A table in a folder of the caller's own stays; others go with dropped() or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark) + '/scorelattice'}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if folder is None:
        out._scratch = path
        _scratch[path] = spark
    return out


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs within get Arrow batches of bounded size from the JVM too; afterwards the session is as it was."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k) for k in bounds}
    try:
        for k, v in bounds.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that written() made and that nothing reads any more."""
    for df in tables:
        path = df.__dict__.pop("_scratch", None)
        if path:
            _remove(_scratch.pop(path), path)


@atexit.register
def _remove_all() -> None:
    while _scratch:
        path, spark = _scratch.popitem()
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the cluster's own clean-up takes the folder
        pass


# --- keys -----------------------------------------------------------------


def crc_bucket(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def order_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID).cast("long"))


# --- Arrow ----------------------------------------------------------------


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow over batches of bounded size; a worker gives its memory back when a task ends.

    Arrow batches come as the session cuts them and are cut further here: its settings stay as they are.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(part for batch in batches for part in bounded(batch))
        release_memory()

    return df.mapInArrow(tidy, schema)


def bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most BATCH_ROWS rows and, but for single rows, about BATCH_BYTES bytes."""
    n = batch.num_rows
    rows = max(1, min(BATCH_ROWS, n * BATCH_BYTES // max(1, batch.nbytes)))
    if n <= rows:
        yield batch
        return
    for at in range(0, n, rows):
        yield batch.slice(at, rows)


def release_memory() -> None:
    """Freed memory goes back to the system: idle workers stay alive beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; a longer document is a range of its own."""
    n, at = len(offs) - 1, 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


# --- words and hashes -----------------------------------------------------


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) of the words of documents laid end to end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SEPARATOR[data]
    opens = np.empty(n, bool)
    opens[0] = True
    np.logical_not(solid[:-1], out=opens[1:])
    opens[offs[:-1][offs[:-1] < n]] = True
    closes = np.empty(n, bool)
    closes[-1] = True
    np.logical_not(solid[1:], out=closes[:-1])
    closes[offs[1:][offs[1:] > 0] - 1] = True
    starts = np.flatnonzero(solid & opens)
    ends = np.flatnonzero(solid & closes) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _mix_other(h: np.ndarray) -> np.ndarray:
    """Another finaliser, by other shifts and factors."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_MIXERS, _SEEDS = (mix, _mix_other), (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes: eight of them at a time go through a finaliser, all words side by side.

    Hashes of different `which` use different finalisers, so that together they are one of 128 bits.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    turn = _MIXERS[which]
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    size = (ends - starts).astype(np.uint64)
    h = turn(size + np.uint64(_SEEDS[which]))
    long = np.flatnonzero(size > LONG_WORD)
    left, at, own = size, starts, np.arange(len(starts))
    if len(long):
        keep = size <= LONG_WORD
        left, at, own = size[keep], starts[keep], own[keep]
        for k in long.tolist():
            digest = xxhash.xxh3_128_intdigest(data[starts[k] : ends[k]].tobytes())
            h[k] = (digest >> (64 * which)) & 0xFFFFFFFFFFFFFFFF
    while len(own):
        lane = eights[at].view("<u8").reshape(-1)
        short = np.minimum(left, np.uint64(8))
        lane = lane & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short))
        h[own] = turn(h[own] ^ lane)
        more = left > 8
        left, at, own = left[more] - np.uint64(8), at[more] + 8, own[more]
    return h


def fold(words: np.ndarray, offsets: tuple[int, ...] | range, count: int, which: int = 0) -> np.ndarray:
    """Hash of the words at i + each offset, for i below count."""
    h = np.full(count, 0x51ED270B9F4D6C35, np.uint64)
    for o in offsets:
        h = ((h << np.uint64(7)) | (h >> np.uint64(57))) ^ words[o : o + count]
        h *= np.uint64(0x9FB21C651E98DF25 if which == 0 else 0xA0761D6478BD642F)
        h ^= h >> np.uint64(29 if which == 0 else 32)
    return _MIXERS[which](h)
