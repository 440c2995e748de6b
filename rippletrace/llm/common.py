"""Helpers that several operators share: durable cuts of lineage, word splitting, packed blobs."""

from __future__ import annotations

import ctypes
import os
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import rippletrace

#: White space of every word rule: space and U+0009 to U+000D. bytes.split() splits at the same six bytes.
WS_CLASS = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only in local mode, where all share one disk, a folder of our own serves if none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def grouped(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """df.groupBy(key).agg(*aggregates), to be joined by the key.

    The rows are dealt by a struct of the key, which a join by the key can't use: it deals both sides anew, as two plain
    shuffles, and adaptive execution can split a hot key. (A side that comes straight from its aggregate can't be split.)"""
    return df.groupBy(F.struct(key).alias("of")).agg(*aggregates).withColumn(key, F.col(f"of.{key}")).drop("of")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(rippletrace.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ship"), "rippletrace_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)


ROWS = 512
_given = [0.0]


def give_back() -> None:
    """Freed memory of this worker goes to the system, twice a second at most; idle workers then hold little beside those that work."""
    now = time.monotonic()
    if now - _given[0] > 0.5:
        _given[0] = now
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(f, schema), but ``f`` gets at most ``ROWS`` rows at a time, so what it copies or holds of a batch stays small."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS))
        give_back()

    return df.mapInArrow(run, schema)


def byte_rows(column: pa.Array) -> tuple[bytes, list[int]]:
    """The UTF-8 bytes of a string or binary column and the n + 1 offsets of its rows in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return b"", [0]
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = data[int(at[0]) : int(at[-1])].to_pybytes() if data is not None else b""
    return raw, (at - at[0]).tolist()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


#: Young words of a worker's table; with the old ones it takes some 40 MB.
WORDS = 100_000


class Memo(dict):
    """word -> value, computed at the first look-up. At most ``most`` young and as many old entries are held: when the
    young ones are full they become the old ones, and a word that is met again becomes young again."""

    def __init__(self, make, most: int = WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value


_memo: dict[str, Memo] = {}


def shared_memo(name: str, make: Callable[[], Callable], most: int = WORDS) -> Memo:
    """The Memo of this worker process under that name; it outlives a task. One is kept at a time."""
    if name not in _memo:
        _memo.clear()
        _memo[name] = Memo(make(), most)
    return _memo[name]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply and xor-shift), so that sums of its values behave like random numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
