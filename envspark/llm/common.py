"""Helpers shared by the training-data operators.

* ``shared_dir`` / ``materialize`` / ``release``: cut lineage through Parquet
  tables in the folder the cluster names in ``spark.checkpoint.dir``.
* ``small_batches``: bounds the Arrow batches handed to Python workers by
  bytes, so that very long texts do not pile up in one batch.
* ``key_runs``: streams a partition that is sorted by an integer key and yields
  one chunk per key, however the Arrow batches cut it.
* ``words_of``: positions and 64-bit hashes of all words of an Arrow text
  column, computed on the UTF-8 buffer without one Python object per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.session import record_path

BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where it is unset
    and the master is local (tests) a folder of our own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="envspark-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return record_path(spark, f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan runs once
    and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer used: its
    cleaner acts when the driver's JVM collects garbage.  The first round lets
    go of the JVM objects that Python held, the second finds them gone."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes (whole texts can be very long)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run):
    """``run`` (batches -> batches) that hands its memory back when a task
    ends: reused Python workers otherwise keep what they needed once."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):       # glibc only
                ctypes.CDLL("libc.so.6").malloc_trim(0)
    return tidied


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(*cols: str):
    """64-bit key of a row's content; used together with the id column."""
    return F.xxhash64(*[F.col(c) for c in cols])


def utf8_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    width = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, dtype=width, count=len(arr) + arr.offset + 1)[arr.offset:].astype(np.int64) \
        if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base, end = int(offs[0]), int(offs[-1])
    return raw[base:end], offs - base


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x5851F42D4C957F2D


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class _Powers:
    """Cached power tables of the byte base and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = powers(_P, size), powers(pow(_P, -1, 1 << 64), size)
        return self.up, self.down


_POW = _Powers()
_CHUNK = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the byte strings data[starts:ends) (ascending and not
    overlapping), by prefix sums of a polynomial whose terms are random per
    byte value.  Works through blocks of whole strings, so the tables stay small."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
        up, down = _POW.get(int(ends[j - 1]) - base + 1)
        part = data[base:int(ends[j - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        h = (sums[e] - sums[s]) * down[s]
        out[i:j] = mix64(h + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        i = j
    return out


def words_of(data: np.ndarray, offs: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs without the six ASCII white-space bytes, never
    across texts): (start, end, index of the first word of each text + total)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ink = ~_IS_SPACE[data] if space is None else ~space
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ink[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ink[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


BASE = 0xD6E8FEB86659FD93
OTHER_BASE = 0xA0761D6478BD642F      # of a second, independent window hash
OTHER = 0xE7037ED1A0B428DB           # xor-ed into the values that it reads


def window_hashes(values: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values (over all texts;
    the caller drops windows that cross a border)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = values[:n].copy()
    for j in range(1, width):
        acc *= np.uint64(base)
        acc += values[j:j + n]
    return mix64(acc)


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Start indices of windows of ``width`` items that lie in one text, given
    the index of each text's first item (+ total)."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    return ragged(first[:-1], counts)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ranges start, start+1, ... of the given lengths."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def text_batches(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """Groups Arrow batches into tables of at least ``limit`` bytes of text."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """(key, all its rows) for a partition sorted by an integer key."""
    held: list[pa.RecordBatch] = []
    current = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(k)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(k)], strict=True):
            if held and k[lo] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = k[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield current, pa.Table.from_batches(held)


def by_key(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Rows with equal keys together and in order, for ``key_runs``."""
    return df.repartition(n or n_partitions(df.sparkSession), key).sortWithinPartitions(key)
