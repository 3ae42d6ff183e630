"""Shared pieces of the training-data operators: tables, scratch tables, text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

#: Rows and bytes that the JVM puts into one Arrow batch at most (one row may be larger).
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Bytes of texts that a worker looks at together; one longer text is looked at alone.
SLICE_BYTES = 1 << 20
#: Row groups of scratch tables: what a writer holds in the JVM's heap.
ROW_GROUP_BYTES = 16 << 20

Batches = Iterator[pa.RecordBatch]
_SCRATCH: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(setting: str) -> int:
    number, unit = setting.rstrip("bB"), 1
    for i, u in enumerate("kmgt"):
        if number[-1:].lower() == u:
            number, unit = number[:-1], 1 << 10 * (i + 1)
    return int(number) * unit


def small_batches(spark: SparkSession) -> None:
    """Let Python workers find this package, and keep Arrow batches small.

    The session's limits on rows and bytes of a batch are lowered, never raised, so that it
    does not matter which query is planned when.
    """
    ship(spark)
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not 0 < _bytes(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def _sliced(batch: pa.RecordBatch, most: int) -> Batches:
    """The batch in runs of rows whose strings and binaries have about ``most`` bytes."""
    if batch.nbytes <= most:
        yield batch
        return
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    turn = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def release() -> None:
    """Give memory that is not in use back to the machine: workers are used again by later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


#: What empties the tables that an operator keeps in a worker from task to task, and the operator that ran last.
_KEPT: list[Callable[[], None]] = []
_LATEST: list[str] = []


def begun(operator: str) -> None:
    """Drop what earlier operators kept in this worker, which Spark uses again for others."""
    if _LATEST != [operator]:
        for empty in _KEPT:
            empty()
        _LATEST[:] = [operator]
        gc.collect()
        release()


def worker(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for ``mapInArrow`` that gets slices of bounded size and leaves a small worker."""
    operator = run.__module__

    @functools.wraps(run)
    def bounded(batches: Batches) -> Batches:
        begun(operator)
        try:
            yield from run(part for batch in batches for part in _sliced(batch, SLICE_BYTES))
        finally:
            release()

    return bounded


def gathered(batches: Batches, rows: int) -> Batches:
    """Batches of narrow columns joined until they have so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset a folder is made on a single machine, as in tests; on a cluster that
    is an error, as executors would write to folders of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="auditgrid-")
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing reads any more."""
    for t in tables:
        delete_path(t.sparkSession, t.scratch_path)
        _SCRATCH[:] = [x for x in _SCRATCH if x[1] != t.scratch_path]


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        with contextlib.suppress(Exception):  # the session may have ended first
            delete_path(spark, path)


class Bloom:
    """A Bloom filter over 64-bit hashes: two bits a key, in 2**16 to ``most`` bits.

    It may let strangers pass but never stops a member, so it serves where an exact join or
    check follows; with more keys than it has room for, more strangers pass.
    """

    MOST = 1 << 26

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.int64, copy=False).view(np.uint64)
        out = np.ones(len(keys), bool)
        for x in (keys & self.mask, keys >> np.uint64(32) & self.mask):
            out &= (self.bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def bloom(keys: DataFrame, most: int = Bloom.MOST):
    """A broadcast ``Bloom`` of a table's only column of longs; ``most`` / 8 bytes at most.

    Spark makes the bitmaps and adds them up; the driver gets 4 KB for each 2**15 bits.
    """
    name = keys.columns[0]
    size = 1 << 16
    n = keys.count()
    while size < most and size < 16 * n:
        size *= 2
    places = [F.col(name).bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(name, 32).bitwiseAND(F.lit(size - 1))]
    at = keys.select(F.explode(F.array(*places)).alias("x")).select((F.col("x") + 1).alias("x"))
    rows = at.groupBy(F.bitmap_bucket_number("x").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    bits = np.zeros((size >> 15, 4096), np.uint8)
    for r in rows.toLocalIterator():
        bits[r["block"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(Bloom(bits.ravel()))


# ---------------------------------------------------------------- words of text batches

#: Bytes of a text that are looked at together; keeps the arrays below in the CPU's caches.
SEGMENT = 1 << 17
_MIX = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _MIX.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes of words: 0-9, a-z and every byte of a character outside ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; for 64-bit numbers sorting is faster than hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SEGMENT + 1)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_ODD, _INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_KEPT.append(_POWERS.__init__)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and n + 1 offsets; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments(is_word: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes which cut no word."""
    lo, n = 0, len(is_word)
    while lo < n:
        hi = min(n, lo + SEGMENT)
        if hi < n:
            at = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            if at > lo:
                hi = at
            else:
                while hi < n and is_word[hi]:
                    hi += 1
        yield lo, hi
        lo = hi


def word_hashes(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start bytes, end bytes) of all words, in order.

    ``offsets``: where texts (or other units) begin and end; no word crosses them.
    A word's 64-bit hash depends on its bytes alone.
    """
    is_word = WORD_BYTE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets if breaks is None else breaks] = True
    hashes, starts, ends = [], [], []
    for lo, hi in _segments(is_word, offsets):
        m, cut = is_word[lo:hi], first[lo : hi + 1]
        before, after = np.empty_like(m), np.empty_like(m)
        before[0], before[1:] = False, m[:-1]
        after[-1], after[:-1] = False, m[1:]
        s = np.flatnonzero(m & (~before | cut[:-1]))
        e = np.flatnonzero(m & (~after | cut[1:])) + 1
        up, down = _POWERS.get(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[raw[lo:hi]] * up[:-1], out=sums[1:])
            hashes.append(mixed((sums[e] - sums[s]) * down[s]))
        starts.append(s + lo)
        ends.append(e + lo)
    if not hashes:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
