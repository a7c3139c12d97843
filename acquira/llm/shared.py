"""What several operators need: the shared folder, block tables, hashing of whole Arrow columns and packing of hashes.

The corpus-wide operators follow one plan, the *hash exchange*:

1. The documents are written once as a table bucketed by ``block``; later passes read a block's texts without a shuffle.
2. Each block sends, for each range of the hash space, one packed array of its *distinct* hashes. A passage, word or
   copy is sent once a block however often it occurs, and hashes spread evenly, so no key is hot.
3. Each range merges what the blocks sent and answers every block with one packed array, aligned with what it sent.
4. Each block reads its texts again beside the answers.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def _return_memory() -> None:
    """Lets arrays of 2 MB and more go back to the system when they are freed: workers live on, and what they keep adds up."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 2 << 20)  # from which size on memory is mapped
        libc.mallopt(-1, 4 << 20)  # how much may stay free at the end of the heap
    except (OSError, AttributeError):  # another C library
        return


_return_memory()
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240517)
#: Random values for the 256 bytes; a polynomial over them identifies a string.
BYTE_VALUES = _rng.integers(1, 2**63 - 1, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(4)
def _local_root(application: str) -> str:
    root = tempfile.mkdtemp(prefix="acquira-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return "file://" + root


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share (``spark.checkpoint.dir``).

    Where that is unset, a local session takes a folder that goes with the process; a cluster has none to take and raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the executors share")
        root = _local_root(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df in the shared folder and reads it again: later passes don't repeat its plan and survive lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables that one call writes for itself, as a context: they go at its end, failed or not."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables, self.number = spark, shared_folder(spark), [], 0
        self.named: dict[str, DataFrame] = {}  # tables of the way that a caller may look at

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self.drop()

    def _path(self) -> str:
        self.number += 1
        return f"{self.folder}/{self.number}"

    def write(self, df: DataFrame) -> DataFrame:
        path = self._path()
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def blocks(self, df: DataFrame, block: Column, number: int | None = None) -> DataFrame:
        """df with its ``block``, as a table bucketed by it: what groups or cogroups by ``block`` afterwards reads it in place."""
        n, name = number or shuffle_partitions(self.spark), f"llm_{uuid.uuid4().hex}"
        out = df.withColumn("block", block).repartition(n, "block").write.format("parquet").bucketBy(n, "block")
        out.option("path", self._path()).option("compression", "zstd").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def scratched(f):
    """f, whose tables go at its end, failed or not, when its result is written; the caller's ``scratch`` stays for the caller to drop."""

    @wraps(f)
    def run(df: DataFrame, *args, scratch: Scratch | None = None, **options):
        if scratch is not None:
            return f(df, *args, scratch=scratch, **options)
        with Scratch(df.sparkSession) as own:
            out = f(df, *args, scratch=own, **options)
            return out if out is None else materialize(out)

    return run


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Inside, Arrow batches have so many rows at most: whole texts make batches of the usual 10,000 rows too large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_ids(n: int) -> list[int]:
    """n ascending block numbers of which each falls into a bucket of its own, of n (Spark deals buckets by Murmur3 of the number)."""
    rotate = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    ids = np.arange(n * (int(np.log(n + 1)) + 12), dtype=np.uint32)
    h = rotate(rotate(ids * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    bucket = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
    have, first = np.unique(bucket, return_index=True)
    spare = np.setdiff1d(np.arange(len(ids)), first)[: n - len(have)]  # a bucket that none falls into stays empty
    return np.sort(ids[np.concatenate([first, spare])]).astype(int).tolist()


def block_of(place: Column, n: int) -> Column:
    """The number of the place-th block (from 0) of n."""
    return F.element_at(F.array(*[F.lit(i) for i in block_ids(n)]), place.cast("int") + 1)


def hashed_block(spark: SparkSession, key: str = "doc_id") -> Column:
    n = shuffle_partitions(spark)
    return block_of(F.pmod(F.xxhash64(F.col(key)), F.lit(n)), n)


# ---------------------------------------------------------------- Arrow columns as bytes


def column_bytes(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and its row offsets; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if big else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if col.null_count:
        ok = np.asarray(col.is_valid())
        size = np.where(ok, np.diff(offsets), 0)
        if (np.diff(offsets)[~ok] == 0).all():
            return raw[offsets[0]:offsets[-1]], offsets - offsets[0]
        keep = np.repeat(ok, np.diff(offsets))
        return raw[offsets[0]:offsets[-1]][keep], np.concatenate([[0], np.cumsum(size)])
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(size, _BASE, _U), np.full(size, inverse, _U)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _powers["up"][:n], _powers["down"][:n]


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and start of every word ``[^\\x20\\x09-\\x0D]+`` of the rows, A-Z lower-cased."""
    hashes, owners, starts = [], [], []
    row, n_rows = 0, len(offsets) - 1
    while row < n_rows:  # slices of about 2 MB keep the temporary arrays small
        end = min(n_rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + (2 << 20), "right")) - 1))
        lo, hi = int(offsets[row]), int(offsets[end])
        if hi > lo:
            b = raw[lo:hi]
            inside = ~_SPACE[b]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            heads = offsets[row:end] - lo
            heads = heads[heads < hi - lo]
            first[heads] = inside[heads]
            last = inside.copy()
            last[:-1] &= ~inside[1:] | first[1:]
            tails = offsets[row + 1:end + 1] - lo - 1
            tails = tails[tails >= 0]
            last[tails] = inside[tails]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            if len(s):
                up, down = _power_table(len(b) + 1)
                value = BYTE_VALUES[_LOWER[b] if lower else b] * up[:-1]
                total = np.zeros(len(b) + 1, _U)
                np.cumsum(value, out=total[1:])
                h = (total[e] - total[s]) * down[s]
                hashes.append(mix(h + (e - s).astype(_U)))
                owners.append(np.searchsorted(offsets[row:end + 1], s + lo, "right") - 1 + row)
                starts.append(s + lo)
        row = end
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners), np.concatenate(starts)


# ---------------------------------------------------------------- keys of 48 bits in 32


def key_ranges(n: int) -> np.ndarray:
    """First of the 65,536 buckets (top 16 of 48 bits) of each of n ranges; n + 1 places."""
    return (np.arange(n + 1, dtype=np.int64) * 65536 + n - 1) // n


def pack_counts(c: np.ndarray) -> bytes:
    """Non-negative integers in the fewest of 1, 2, 4 or 8 bytes, after a byte that says which."""
    top = int(c.max()) if len(c) else 0
    width = 1 if top < 256 else 2 if top < 65536 else 4 if top < 2**32 else 8
    return bytes([width]) + c.astype(f"<u{width}").tobytes()


def unpack_counts(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = blob[at]
    return np.frombuffer(blob, f"<u{width}", n, at + 1).astype(np.int64), at + 1 + width * n


def pack_keys(keys: np.ndarray, first: int, last: int, *counts: np.ndarray) -> bytes:
    """Ascending 48-bit keys of buckets first to last as the buckets' sizes and the low 32 bits, then counts for each key."""
    sizes = np.bincount((keys >> _U(32)).astype(np.int64) - first, minlength=last - first)
    return b"".join([np.uint32(len(keys)).tobytes(), pack_counts(sizes), keys.astype("<u4").tobytes(), *map(pack_counts, counts)])


def unpack_keys(blob: bytes, first: int, last: int, n_counts: int) -> list[np.ndarray]:
    m = int(np.frombuffer(blob, "<u4", 1)[0])
    sizes, at = unpack_counts(blob, 4, last - first)
    keys = (np.repeat(np.arange(first, last, dtype=np.int64).astype(_U), sizes) << _U(32)) | np.frombuffer(blob, "<u4", m, at).astype(_U)
    at, out = at + 4 * m, [keys]
    for _ in range(n_counts):
        c, at = unpack_counts(blob, at, m)
        out.append(c)
    return out


def cut_keys(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n ranges' first buckets, and where each range starts in ascending keys (n + 1 places both)."""
    edges = key_ranges(n)
    return edges, np.searchsorted(keys, edges.astype(_U) << _U(32)).astype(np.int64)
