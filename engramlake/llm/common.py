"""What several operators share: durable intermediate tables and array-wise text hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache
from typing import TypeVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where none is configured and all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _watching:
        paths.append(path)
    return path


_watching: list[list[str]] = []


@contextmanager
def scratch_paths() -> Iterator[list[str]]:
    """The paths in the shared folder that are given out meanwhile."""
    _watching.append(paths := [])
    try:
        yield paths
    finally:
        _watching.pop()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and reread it: its lineage ends there.

    A lost executor then costs only the tasks that ran on it, not the jobs before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[str, tuple[object, object]] = {}


def kept_by_worker(name: str, key: object, make: Callable[[], T]) -> T:
    """What a worker process needs for one operator and would be slow to make for each task.

    Asked for under another name, it forgets the old: of all large tables a worker holds one."""
    if name not in _kept or _kept[name][0] != key:
        _kept.clear()
        _give_back()
        _kept[name] = (key, make())
    return _kept[name][1]


def _give_back() -> None:
    """What a worker has freed goes back to the system, where the C library knows how."""
    gc.collect()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches, few at a time so that long texts are not all decoded at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers, the same on every machine."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=1)
def word_chars() -> np.ndarray:
    """For each code point, whether it is a letter or digit (or an underscore)."""
    flags = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    flags[ord("_")] = True
    return flags


@lru_cache(maxsize=1)
def upper_chars() -> np.ndarray:
    """For each code point, whether it is an upper-case letter."""
    return np.fromiter((chr(i).isupper() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    return np.cumprod(np.concatenate(([1], np.full(63, 0x100000001B3))).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (run of letters, digits or underscores), lower case, in order."""
    codes = code_points(text.lower())
    inside = word_chars()[codes]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    value = (codes[at].astype(np.uint64) + np.uint64(1)) * _GOLDEN
    value = (value ^ (value >> np.uint64(29))) * _powers()[place & 63] + place.astype(np.uint64)
    return mix64(np.add.reduceat(mix64(value), first))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of runs of n words; a shorter text is one run, an empty one none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out = out * _GOLDEN + words[j : len(words) - n + 1 + j]
    return np.unique(mix64(out))
