"""What the operators of this subpackage share: the word rule, the shared folder and small numeric helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import os
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once: a lambda variable is evaluated once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set (tests, local mode)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


_turns = itertools.count(1)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more: it does so when the driver collects its garbage,
    which a driver that does little may not do during a whole job of many rounds. Python's references are given up by a thread that
    looks for them each second, so this waits for it (a few seconds at most; other threads may go on making such references)."""
    gc.collect()
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    end = time.monotonic() + 5
    while waiting and time.monotonic() < end:
        time.sleep(0.05)
    # Spark's event threads keep the last event that they handled, and the end of a query holds its plan: a query of one row takes its place.
    spark.range(1).collect()
    time.sleep(0.1)
    spark._jvm.System.gc()


def cut(df: DataFrame, let_go: bool = False, light: bool = False, small: bool = False) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it from there, so that lost executors cost no recomputation. ``let_go``
    releases what the step before left; otherwise each fourth cut does.

    Each partition makes a file, and files cost more than their bytes where partitions are small: after a shuffle a ``small`` frame (less
    than the texts) is written by a quarter of the partitions, though by as many as there are cores, a ``light`` one (a few bytes a
    document or less) by a sixteenth."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if next(_turns) % 4 == 0 or let_go:
        release(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if light:
        df = df.coalesce(max(1, partitions // 16))
    elif small:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, partitions // 4))
    return df.checkpoint(eager=True)


class Table:
    """A frame written as Parquet to the shared folder: smaller than a checkpoint where columns repeat or are null."""

    def __init__(self, df: DataFrame, name: str):
        self.path = shared_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = df.sparkSession.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames that ``cut`` made, once nothing that is still to run reads them."""
    for df in frames:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{spark._jvm.java.util.UUID.randomUUID()}")


_ARROW_ROWS, _DEFAULT_ROWS, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def small_batches(spark: SparkSession | None = None) -> None:
    """Texts go to Python a thousand rows at a time, unless the session has a size of its own: ten thousand rows of long texts, there and
    back, take hundreds of megabytes outside of the heap."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_ARROW_ROWS, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_ARROW_ROWS, _ROWS)


_kept: dict[object, object] = {}


def held(family: str, key: object = None, make: Callable[[], object] = lambda: None) -> object:
    """What a Python worker keeps for an operator from task to task. Workers serve many operators in turn, so what another family kept
    goes: an idle vocabulary would take the memory that the next stage needs."""
    if _kept.get("family") != family:
        _kept.clear()
        _kept["family"] = family
    if (family, key) not in _kept:
        _kept[family, key] = make()
    return _kept[family, key]


def tidy() -> None:
    """Hand memory that a batch used back to the system. Workers live on, and both allocators would keep the most that any batch took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system's C library can
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers (the well-known murmur constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately. Two generations bound the memory."""

    def __init__(self, seed: int = 0, most: int = 300_000):
        super().__init__()
        import xxhash

        self.seed, self.most, self.old = seed, most, {}
        self.digest = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self.old.get(word)
        if value is None:
            value = self.digest(word, self.seed)
        self[word] = value
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return out


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of k consecutive entries, by a wrapping polynomial and a finaliser."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    p = np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        out *= p
        out += hashes[i : i + n]
    return mix64(out)


def batched(rows: Iterator[dict], schema: pa.Schema, weigh: Callable[[dict], int], most_rows: int = 5_000, most: int = 24_000_000) -> Iterator[pa.RecordBatch]:
    """Group rows to Arrow batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if len(held) >= most_rows or size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
