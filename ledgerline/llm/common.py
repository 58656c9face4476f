"""Shared pieces: scratch tables in the shared folder, and vectorised text kernels over Arrow buffers."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Where that is unset, a folder
    in the warehouse, which a cluster shares too; in local mode, where all run on one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="ledgerline-")
    return f"file://{_LOCAL[app]}"


class Scratch:
    """Tables written to the shared folder by one run of an operator.

    A written table cuts the lineage: a lost executor costs a re-read, not a recomputation. ``drop`` removes a
    table that nothing reads any more; what the result itself reads stays until the folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Written once in ``buckets`` files dealt by ``key``; later groupings by ``key`` read it without a shuffle."""
        table = f"t_{uuid.uuid4().hex}"
        writer = df.repartition(buckets, key).write.bucketBy(buckets, key).option("compression", "zstd")
        writer.option("path", self.path(name)).saveAsTable(table)
        out = self.spark.table(table)
        out.schema  # resolved before the name goes; the files stay
        self.spark.sql(f"DROP TABLE {table}")
        return out

    def _file(self, name: str):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        return path, path.getFileSystem(sc._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._file(name)
        return fs.exists(path)

    def make(self, name: str) -> None:
        """The folder of a table, if it is not there."""
        path, fs = self._file(name)
        fs.mkdirs(path)

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            path, fs = self._file(name)
            fs.delete(path, True)

    def release(self) -> None:
        """Has the driver forget jobs that are done, so that Spark's cleaner removes their shuffle files early."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the one figure that whoever runs it sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# ---- Arrow columns ----------------------------------------------------------------------------------------------


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (with 8 zero bytes after the end) and int64 offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_binary())  # before chunks are joined: 32-bit offsets end at 2 GiB
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), offs - offs[0]


try:  # glibc alone keeps what numpy has freed; elsewhere there is nothing to give back
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = None


def trim() -> None:
    """Gives a worker's freed memory back to the system, as workers live from task to task."""
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


def pieces(batches, limit: int):
    """Record batches cut into slices whose ``text`` holds about ``limit`` bytes (one document at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index("text")
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch
        trim()


# ---- words and hashes -------------------------------------------------------------------------------------------

#: [\x20\x09-\x0D] divides words; everything else is word.
BLANK = np.ones(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased: 0-9, a-z and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), in place."""
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word, and the index of each document's first word (one more at the end)."""
    w = is_word[data]
    w[len(data) - 8 :] = False
    edge = np.empty_like(w)
    edge[0] = w[0]
    np.greater(w[1:], w[:-1], out=edge[1:])
    inner = offs[(offs < len(data) - 8)]
    edge[inner] = w[inner]
    starts = np.flatnonzero(edge)
    stop = np.empty_like(w)
    stop[-1] = False
    np.greater(w[:-1], w[1:], out=stop[:-1])
    last = offs[offs > 0] - 1
    stop[last] = w[last]
    ends = np.flatnonzero(stop) + 1
    return starts, ends - starts, np.searchsorted(starts, offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span, eight bytes at a time; ``data`` ends with 8 spare bytes."""
    if not len(starts):
        return np.zeros(0, _U)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    h = lens.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(seed)
    h = mix(h ^ (eight[starts] & _MASKS[np.minimum(lens, 8)]))
    rest, k = np.flatnonzero((lens > 8) & (lens <= 512)), 8
    while rest.size:
        part = eight[starts[rest] + k] & _MASKS[np.minimum(lens[rest] - k, 8)]
        h[rest] = mix(h[rest] * _U(31) ^ part)
        k += 8
        rest = rest[lens[rest] > k]
    for i in np.flatnonzero(lens > 512):
        raw = data[starts[i] : starts[i] + lens[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a window from the hashes of its two halves."""
    return mix(left * _U(0x9E3779B97F4A7C15) + (right ^ _U(0xC2B2AE3D27D4EB4F)))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of ``length`` consecutive items (they may overlap a document's end: mask those)."""
    have, size = h, 1
    while size < length and len(have):
        step = min(size, length - size)
        have = join_hashes(have[: max(0, len(have) - step)], have[step:])
        size += step
    return have


def inside(first: np.ndarray, length: int, total: int) -> np.ndarray:
    """True for each of ``total`` items where a window of ``length`` items stays inside its document."""
    ok = np.ones(total, bool)
    for back in range(1, length):
        at = first[1:] - back
        ok[at[at >= first[:-1]]] = False
    return ok


def ids(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64), pa.int64())


CRLF = re.compile(r"[\x20\x09-\x0d]+")
