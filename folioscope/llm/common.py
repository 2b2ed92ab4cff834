"""What the operators of this subpackage share: the shared folder, packed arrays, 64-bit hashing."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

np.seterr(over="ignore")
U64 = np.uint64


# --------------------------------------------------------------------------- tables and shared folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again. Survives the loss of any executor."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_scan(df: DataFrame) -> bool:
    """Whether df is a plain read of files, whose rows come in the same order and splits each time they are read."""
    plan = df._jdf.queryExecution().optimizedPlan()
    names = {line.lstrip(" +-:").split(" ")[0] for line in plan.toString().splitlines() if line.strip()}
    return plan.deterministic() and names <= {"Relation", "Project", "Filter"}


def stable(df: DataFrame, label: str) -> DataFrame:
    bounded(df)
    return df if is_scan(df) else stored(df, label)


def bounded(df: DataFrame) -> DataFrame:
    """df; from now on the session's Arrow batches are small, so that long texts don't pile up in one. Spark reads these
    settings when a query is run, after this function returned, so that they stay; they are lowered and never raised."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        held = conf.get(name).lower()
        if not held.isdigit() or not 0 < int(held) <= most:
            conf.set(name, most)
    return df


def col(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(taken: Iterable[str]) -> Callable[..., str]:
    """Gives names that no column has, in any spelling, and none twice."""
    held = {c.lower() for c in taken}

    def free(name: str, prefix: str = "fs_") -> str:
        name = prefix + name
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        return name

    return free


def text_or_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def crc_mod(col: str, mod: int):
    return F.crc32(F.col(col).cast("string")) % mod


# --------------------------------------------------------------------------- packing

_packer = zstandard.ZstdCompressor(level=3)
_unpacker = zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed value; unpack gives them back in order."""
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        kind = b"b" if isinstance(a, bytes) else a.dtype.str.encode()
        data = a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes()
        out += [len(kind).to_bytes(1, "little"), kind, len(data).to_bytes(8, "little"), data]
    return _packer.compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray | bytes]:
    raw = _unpacker.decompress(data)
    n, at, out = int.from_bytes(raw[:2], "little"), 2, []
    for _ in range(n):
        k = raw[at]
        kind, at = raw[at + 1 : at + 1 + k], at + 1 + k
        size, at = int.from_bytes(raw[at : at + 8], "little"), at + 8
        out.append(raw[at : at + size] if kind == b"b" else np.frombuffer(raw, np.dtype(kind.decode()), size // np.dtype(kind.decode()).itemsize, at))
        at += size
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds the values."""
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[k] .. starts[k] + lens[k] - 1 for each k, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total, dtype=np.int64)


# --------------------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = np.asarray(x, U64)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: Symbols that are hashed at a time, so that the 64-bit codes of a block aren't all held at once.
_CHUNK = 1 << 17


def span_hashes(symbols: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of symbols[start:end] for each span; the spans are in order and don't overlap. codes: a random
    64-bit code of each symbol. A symbol and its place in the span are hashed together, so that the hash is no polynomial,
    whose values coincide for words of two letters in Thue and Morse's order; whoever shares results by it still compares
    the symbols."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, first + _CHUNK, "right")))
        a, b = starts[at:upto] - first, ends[at:upto] - first
        size = int(b[-1])
        place = np.arange(size, dtype=np.int64) - np.repeat(a, np.diff(np.append(a, size)))
        values = mix(codes[symbols[first : first + size]] + (place.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
        sums = np.zeros(size + 1, U64)
        np.cumsum(values, out=sums[1:])
        out[at:upto] = mix(sums[b] - sums[a] + (b - a).astype(U64))
        at = upto
    return out


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


# --------------------------------------------------------------------------- Arrow batches


_libc = ctypes.CDLL(None)


def release() -> None:
    """Give freed memory back: Python workers live on between stages, and their heaps would add up in an executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = 1_000_000, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about so many characters at most; a longer text is a piece of its own."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch[text]).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        at, held = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if k > at and (held + size > chars or k - at >= rows):
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += size
        if at < len(sizes):
            yield batch.slice(at)
        release()


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    return [x or "" for x in batch[text].to_pylist()]


def task_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


__all__ = [n for n in dir() if not n.startswith("_")]
assert os.name == "posix"
