"""Shared machinery: Arrow text buffers as numpy bytes, words, and hashes of spans.

Texts are handled as UTF-8 bytes in chunks of about a megabyte, so that the working
arrays stay in cache and memory does not depend on the number of rows; a text that is
longer is a chunk of its own.  All byte classes used here treat every byte from 0x80 on
alike, so splitting bytes equals splitting code points.

Hashes are 64 bits wide.  A span of bytes is hashed in blocks of eight bytes, each mixed
into the state before the next one comes (blake2b from the 65th byte on); a run of words
is hashed as a tree over runs of 1, 2, 4, ... words with a mix at every node.  Neither is
a polynomial, so that no arrangement of repeated letters or words cancels out.  They are
not secret: where a coincidence would change a result, and the texts are at hand, callers
compare bytes (`same_spans`).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_fold = np.arange(256)
_fold[ord("A") : ord("Z") + 1] += 32
#: Lower case of A to Z, byte by byte
FOLD = _fold.astype(np.uint8)

#: Words between spaces and the controls tab to carriage return.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_LANES = 8


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, zeros after the end, as one number."""
    wide = np.zeros(len(data) + 16, np.uint8)
    wide[: len(data)] = data
    return np.ndarray((len(data) + 9,), "<u8", wide, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes; depends on its bytes and length only."""
    lanes, size = _lanes(data), ends - starts
    with np.errstate(over="ignore"):
        out = mix(size.astype(U) * U(0xA0761D6478BD642F) ^ U(0x2545F4914F6CDD1D))
        out = mix(out ^ (lanes[starts] & _MASKS[np.minimum(size, 8)]))
        left = np.flatnonzero(size > 8)
        for k in range(1, _LANES):
            if not len(left):
                return out
            n = size[left] - 8 * k
            out[left] = mix(out[left] ^ (lanes[starts[left] + 8 * k] & _MASKS[np.minimum(n, 8)]))
            left = left[n > 8]
    for i in left:  # at most one for 64 bytes
        digest = hashlib.blake2b(data[starts[i] + 8 * _LANES : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = mix(out[i : i + 1] ^ U(int.from_bytes(digest, "little")))[0]
    return out


def same_spans(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at[i] : at[i] + size[i]] equals b[to[i] : to[i] + size[i]], byte by byte."""
    x, y = _lanes(a), _lanes(b)
    out = np.ones(len(size), bool)
    left, k = np.flatnonzero(size > 0), 0
    while len(left) and k < _LANES:
        n = size[left] - 8 * k
        equal = (x[at[left] + 8 * k] ^ y[to[left] + 8 * k]) & _MASKS[np.minimum(n, 8)] == U(0)
        out[left[~equal]] = False
        left, k = left[equal & (n > 8)], k + 1
    for i in left:
        lo = 8 * k
        out[i] = bool((a[at[i] + lo : at[i] + size[i]] == b[to[i] + lo : to[i] + size[i]]).all())
    return out


class Runs:
    """Hashes of runs of 64-bit codes, out of those of runs of 1, 2, 4, ... codes."""

    def __init__(self, codes: np.ndarray):
        self.levels = [codes]

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * U(0x9FB21C651E98DF25) + b * U(0xD6E8FEB86659FD93))

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            with np.errstate(over="ignore"):
                self.levels.append(self._joined(last[: max(0, len(last) - half)], last[half:]))
        return self.levels[k]

    def hash(self, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """The hash of each run of `length` codes, at least one: its first and its last power of two."""
        length = np.broadcast_to(np.asarray(length, np.int64), starts.shape)
        out = np.zeros(len(starts), U)
        power = np.frexp(length)[1] - 1
        for k in np.unique(power):
            of = slice(None) if (power == k).all() else np.flatnonzero(power == k)
            n, part = length[of], self._level(int(k))
            with np.errstate(over="ignore"):
                ends = part[starts[of] + (n - (1 << int(k)))]
                out[of] = mix(self._joined(part[starts[of]], ends) ^ (n.astype(U) * U(0xA0761D6478BD642F)))
        return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows lo..hi of about `limit` bytes: (lo, hi, bytes, offsets from 0)."""
    data, off = raw(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 65536)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words; those of row i are first[i]..first[i+1]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = kind[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    return span_hashes(FOLD[data] if lower else data, starts, ends)


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` codes; run i starts at code i."""
    return Runs(codes).hash(np.arange(max(0, len(codes) - size + 1)), size)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of starts[i] .. starts[i] + lengths[i] - 1."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - at, lengths) + np.arange(total)


class Index:
    """Values by distinct 64-bit keys, in an open hash table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = U(64 - bits), np.int64((1 << bits) - 1)
        self.free = np.int64(-1)
        while (keys == self.free).any():
            self.free -= np.int64(1)
        self.keys, self.values = np.full(1 << bits, self.free), np.zeros(1 << bits, values.dtype)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            s = slot[left]
            open_ = self.keys[s] == self.free
            self.keys[s[open_]] = keys[left[open_]]
            won = self.keys[s] == keys[left]
            self.values[s[won]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = np.ascontiguousarray(keys).view(U) * U(0x9E3779B97F4A7C15)
            return ((x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; KeyError if a key is missing."""
        slot = self._slots(keys)
        left = np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            if (self.keys[slot[left]] == self.free).any():
                raise KeyError("a key is missing")
            slot[left] = (slot[left] + 1) & self.mask
            left = left[self.keys[slot[left]] != keys[left]]
        return self.values[slot]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's LONG."""
    return np.ascontiguousarray(x, U).view(np.int64)


def plain(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id and text alone, in fixed types, so that further columns cannot clash."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def row_id() -> Column:
    """Identity of a row by its id and text; equal rows share it, which is harmless."""
    return F.xxhash64("doc_id", "text")


def remainder(mod: int) -> Column:
    """crc32 of doc_id as text, modulo `mod`; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % F.lit(mod)


def batches(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())


def give_back() -> None:
    """Hands freed memory back to the system, which Arrow's pool and the C library keep otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(b: pa.RecordBatch, limit: int = 2 * CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in batches of about `limit` bytes, of one row at least."""
    step = max(1, limit * b.num_rows // max(1, b.nbytes))
    for lo in range(0, b.num_rows, step):
        yield b.slice(lo, step)


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that sends small batches and gives its memory back at the end.

    A worker stays for later tasks; what it kept would add to the memory of the JVM, which
    sorts and joins meanwhile.
    """

    def tidied(batches):
        try:
            for b in run(batches):
                yield from slices(b)
        finally:
            give_back()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """The same for applyInArrow, after groups of more than `CHUNK` bytes."""

    def tidied(key, t):
        try:
            return run(key, t)
        finally:
            if t.nbytes > CHUNK:
                give_back()

    return tidied


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, for sessions started without it on their path.

    The archive lies in the folder that all share.
    """
    import importlib
    import io
    import uuid
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(importlib.import_module("tidemark").__file__).parent
    if root.is_dir():  # else the package itself runs from such an archive
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        target = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}.zip")
        out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(data.getvalue()))
        out.close()
        target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)
        sc.addPyFile(target.toString())
    sc._tidemark_shipped = True


# -- lineage -------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a session on one machine (tests) may go without the setting; it gets a folder
    of this process.
    """
    from pathlib import Path

    here = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not here:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import atexit
        import shutil
        import tempfile

        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        here = Path(own).as_uri()
        spark.sparkContext.setCheckpointDir(here)
    return here


class Staged:
    """Tables written in the shared folder, which cut lineage and survive executors.

    Results are lazy and may read them at any time, so what no step drops goes when the
    session ends.
    """

    def __init__(self, spark: SparkSession):
        import uuid

        self.spark, self.top, self.count = spark, f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}", 0
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.top)
        self.files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(path)
        self.files.deleteOnExit(path)

    def write(self, df: DataFrame, share: int = 0) -> DataFrame:
        """The table, written and read again.

        Small tables go to fewer files: one for every `share` shuffle partitions.  They are
        dealt to these after they have been computed, so that the computing stage stays wide.
        """
        self.count += 1
        path = f"{self.top}/{self.count}"
        if share:
            df = df.repartition(max(2, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // share))
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Removes tables that no later step reads."""
        for t in tables:
            if t is not None and getattr(t, "_staged_path", None):
                self.files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._staged_path), True)


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], total: int) -> DataFrame:
    """`rows` joined with `values`, which has one row for each key and `held`, the rows that hold it.

    A key that holds more than a fair part of a task's rows is looked up in a broadcast
    list, where its rows are; there are at most `4 * shuffle partitions` such keys out of
    `total` rows.  All others meet by a shuffle.
    """
    share = total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    hot, rest = F.broadcast(values.where(F.col("held") > share).drop("held")), values.where(F.col("held") <= share).drop("held")
    cold = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(rest, keys))


def bitmap(column: DataFrame, most: int = 30) -> np.ndarray:
    """A bit for each value of a column of longs, with 16 bits a value and 2**`most` (128 MB) at most."""
    name = column.columns[0]
    bits = min(most, max(16, int(16 * column.count()).bit_length()))
    bit = column.select(F.pmod(name, F.lit(1 << bits)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(U)


def in_bitmap(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which longs may be among those of the bitmap; false hits are rare, misses are none."""
    k = (values % (len(held) << 6)).astype(np.int64)
    return (held[k >> 6] >> (k & 63).astype(U)) & U(1) == U(1)
