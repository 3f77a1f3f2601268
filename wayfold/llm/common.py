"""Helpers shared by the text operators: durable tables, Arrow text slices, vectorised word spans and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; bounds a task's temporaries whatever the batch size is.
SLICE_BYTES = 2 << 20
#: A table is broadcast only when it was counted and has no more rows and key bytes than these.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 << 20

U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names. Where none is set, a local session (tests) gets one of its own; on
    a cluster that is an error, since executors don't see each other's folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayfold-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner delete shuffle files and checkpoints of tables that nothing refers to any more. It learns of
    them when the driver's heap is collected, which in a loop of small tables may not happen before the disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text mod 5; a null id counts as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def bounded_sample(df: DataFrame, key: str, bound: int, total: int, seed: str) -> DataFrame:
    """Rows whose hashed key falls under bound / total: about ``bound`` rows, the same ones on each run."""
    if total <= bound:
        return df
    share = int(2**31 * bound / total)
    return df.where(F.abs(F.xxhash64(F.lit(seed), F.col(key)) % F.lit(2**31)) < share)


#: Bits a key in a sieve, and in all: a fuller one lets more rows through.
SIEVE_BITS = 16
SIEVE_MOST = 1 << 27


def sieved(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key (a long or null) may be among ``keys`` (one such column): all that are, and about one in
    SIEVE_BITS of the others, by a broadcast bitmap of bounded size. Before a join it spares the shuffle of wide rows that meet none."""
    size = -(-min(SIEVE_MOST, max(1, keys.count()) * SIEVE_BITS) // 32768) * 32768
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(size))
    at = keys.select(slot(keys.columns[0]).alias("slot"))
    at = at.select(F.floor(F.col("slot") / 32768).alias("part"), (F.col("slot") % 32768).alias("bit")).repartition("part")
    bits = np.zeros(size // 8, np.uint8)
    for part, found in at.groupBy("part").agg(F.bitmap_construct_agg("bit")).collect():
        bits[part * 4096 : (part + 1) * 4096] = np.frombuffer(found, np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def look(slots: pa.Array) -> pa.Array:
        s = slots.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1)

    return df.where(F.arrow_udf(look, "boolean")(slot(key)))


_TRIM = None
with contextlib.suppress(OSError, AttributeError):  # glibc
    _TRIM = ctypes.CDLL(None).malloc_trim


def tidy() -> None:
    """Give back what a batch's temporaries leave in the allocators, so that reused workers don't grow from stage to
    stage. Called between batches."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_view(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length n + 1) of an Arrow string array without copying; nulls are empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def text_slices(data: np.ndarray, off: np.ndarray, limit: int = SLICE_BYTES):
    """Cut rows into runs of about ``limit`` bytes (one row at least): first row, end row, bytes, offsets."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def is_space(data: np.ndarray) -> np.ndarray:
    """The separators of words: blank and the controls 9 to 13."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the words before each row (length n + 1); no word crosses rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~is_space(data)
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = off[1:-1]
    cut = cut[cut < n]
    first[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = cut[cut > 0] - 1
    last[cut] = word[cut]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def _tables(seed: int) -> tuple[np.ndarray, int, int]:
    values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    return values, _PRIME, pow(_PRIME, -1, 2**64)


_VALUES, _P, _P_INV = _tables(20240601)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _P), ("down", _P_INV)):
            table = np.full(size, base, U64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"], _POWERS["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits (splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit hash of each byte span, by differences of a prefix polynomial; fold_case lower-cases A-Z."""
    out = np.zeros(len(starts), U64)
    values, lo = _FOLDED if fold_case else _VALUES, 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SLICE_BYTES)))
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(values[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(_PRIME)
        lo = hi
    return mix64(out)


def row_of(counts_before: np.ndarray) -> np.ndarray:
    """Row number of each item, from the items before each row."""
    return np.repeat(np.arange(len(counts_before) - 1), np.diff(counts_before))
