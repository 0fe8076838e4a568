"""Shared plumbing: where intermediate tables live, and vectorised text primitives.

Text primitives work on the UTF-8 bytes of a whole Arrow batch at once, so that the cost
of Python is paid per batch and not per document. Word separators are the six ASCII
bytes 0x09-0x0D and 0x20; as UTF-8 never uses ASCII bytes inside a longer sequence,
splitting bytes and splitting characters give the same words.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)
#: Longer words are hashed one at a time instead of in eight-byte steps side by side.
_LONG_WORD = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set, and only
    if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="flowmill-")
        atexit.register(shutil.rmtree, base[7:], True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/flowmill/{name}-{uuid.uuid4().hex}"


#: While tables are written: drop shuffle files afterwards, and hand Python small batches, as
#: texts may be long.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}
_lock = threading.Lock()
_writing: dict[int, tuple[int, dict]] = {}
_local = threading.local()


class _settings:
    """The settings above, for as long as any thread writes in this session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        with _lock:
            n, was = _writing.get(id(self.spark), (0, {}))
            if not n:
                was = {k: self.spark.conf.get(k, None) for k in _WHILE_WRITING}
                for k, v in _WHILE_WRITING.items():
                    self.spark.conf.set(k, v)
            _writing[id(self.spark)] = n + 1, was

    def __exit__(self, *_) -> None:
        with _lock:
            n, was = _writing.pop(id(self.spark))
            if n > 1:
                _writing[id(self.spark)] = n - 1, was
                return
            for k, v in was.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def _scopes() -> list[list[DataFrame]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: later steps reuse the rows,
    and a lost executor costs only its own tasks. Its shuffle files go when it is written."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _settings(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._flowmill_path = path
    if _scopes():
        _scopes()[-1].append(out)
    return out


class scratch:
    """Tables that this thread materializes inside go at its end, except those kept."""

    def __enter__(self) -> scratch:
        self.kept: list[DataFrame] = []
        _scopes().append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __exit__(self, *_) -> None:
        mine = _scopes().pop()
        kept = [df for df in mine if any(df is k for k in self.kept)]
        discard(*[df for df in mine if not any(df is k for k in kept)])
        if _scopes():
            _scopes()[-1] += kept


def discard(*frames: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read any more."""
    for df in frames:
        spark, path = df.sparkSession, df._flowmill_path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (two multiply-xor rounds)."""
    h = (h ^ (h >> _S)) * _M2
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array end to end, and the n + 1 offsets; null: empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32, len(arr) + 1, arr.offset * (8 if wide else 4)).astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every document, and the n + 1 word offsets."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~_SEP[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    end[:-1] &= ~inside[1:] | first[1:n]
    ws, we = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return ws, we, np.searchsorted(ws, offs)


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    ln = we - ws
    h = mix(ln.astype(np.uint64) * _M1 + _M1)
    if not len(ws):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.lib.stride_tricks.sliding_window_view(padded, 8)
    todo = np.arange(len(ws)) if ln.max() <= _LONG_WORD else np.flatnonzero(ln <= _LONG_WORD)
    k = 0
    while len(todo):
        left = ln[todo] - 8 * k
        v = at8[ws[todo] + 8 * k].view("<u8").ravel() & _KEEP[np.minimum(left, 8)]
        x = (h[todo] ^ v) * _M1
        h[todo] = x ^ (x >> _S)
        todo, k = todo[left > 8], k + 1
    h = mix(h)
    if ln.max() > _LONG_WORD:
        import hashlib

        for i in np.flatnonzero(ln > _LONG_WORD):
            h[i] = int.from_bytes(hashlib.blake2b(data[ws[i] : we[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def window_hashes(h: np.ndarray, k: int, mult: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """A hash of each run of k consecutive values; entry i covers i .. i+k-1.

    A polynomial in an odd number modulo 2**64, put together from runs of 1, 2, 4, ...
    values: about 2 log2 k passes over the array.
    """
    if len(h) < k:
        return np.zeros(0, np.uint64)
    run, size, power = h, 1, mult % 2**64  # runs of `size` values; power: mult ** size
    out, done = None, 0
    while True:
        if k & size:
            m = len(h) - done - size + 1
            out = run if out is None else out[:m] * np.uint64(power) + run[done : done + m]
            done += size
        if done == k:
            return mix(out)
        m = len(h) - 2 * size + 1
        run = run[:m] * np.uint64(power) + run[size : size + m]
        size, power = 2 * size, power * power % 2**64


def batches(it, limit: int = 8 << 20, column: str = "text"):
    """Cut Arrow batches so that each piece holds about `limit` bytes of text, or one row."""
    for b in it:
        if not b.num_rows:
            continue
        arr = b.column(b.schema.get_field_index(column))
        _, offs = flat(arr)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def grouped(it, by: list[str], size: int = 0):
    """Tables of whole groups from batches sorted by `by`: each ends with the first group
    that brings it to `size` bytes, so only a single group larger than that exceeds it."""
    held: list[pa.RecordBatch] = []
    last, total = None, 0
    for b in it:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in by]
        new = np.any([np.diff(c) != 0 for c in cols], axis=0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        each = b.nbytes / b.num_rows
        begin = 0
        for a, z in zip(cuts, cuts[1:]):
            now = tuple(c[a] for c in cols)
            if total >= size and (held or a > begin) and now != last:
                if a > begin:
                    held.append(b.slice(begin, a - begin))
                yield pa.Table.from_batches(held)
                held, total, begin = [], 0, a
            total += each * (z - a)
            last = now
        held.append(b.slice(begin))
    if held:
        yield pa.Table.from_batches(held)
