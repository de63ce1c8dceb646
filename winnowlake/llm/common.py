"""Helpers the operators share: shared-folder tables, Arrow text access, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step works on; a longer single text is a step of its own.
SLICE_BYTES = 2 << 20
#: Values that one running sum covers.
STEP = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER = _LOWER
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SPACE = _SPACE

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


# ---------------------------------------------------------------- Spark side
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set, local masters (tests) get a temporary one of this
    machine; on a cluster that is an error, as executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="winnowlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors. The
    folder goes with discard(), or when the driver's JVM ends in order."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialised_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the folders of materialised tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_materialised_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- Arrow side
def texts_of(col: pa.Array) -> pa.LargeStringArray:
    """The column as large_string without nulls (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; offsets start at 0."""
    col = texts_of(col)
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of rows of at most `limit` bytes, or one row."""
    data, offs = raw(col)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(keep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and one more) of the runs of kept bytes; runs end with their row."""
    n = len(keep)
    prev = np.zeros(n, bool)
    prev[1:] = keep[:-1]
    prev[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(keep & ~prev)
    nxt = np.zeros(n, bool)
    nxt[:-1] = keep[1:]
    last = offs[1:] - 1
    nxt[last[last >= 0]] = False
    ends = np.flatnonzero(keep & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offs)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, r in enumerate((_R, _RINV)):
            p = np.full(max(n, 1 << 20), r, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running sums from which span_hashes() gets the hash of any span, wherever it stands."""
    fwd, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * fwd[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts])


def hashed_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = STEP) -> np.ndarray:
    """span_hashes() of spans in ascending order of start and end, taken piece by piece: no running sum is
    longer than `step` values, so a long text needs no eight bytes for each of its own."""
    if len(values) <= step:
        return span_hashes(prefix_sums(values), starts, ends)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        hi = int(np.searchsorted(ends, base + step, "right"))
        if hi > at:
            out[at:hi] = span_hashes(prefix_sums(values[base : int(ends[hi - 1])]), starts[at:hi] - base, ends[at:hi] - base)
        else:  # one span longer than a step: its sum is put together from those of pieces
            hi, total = at + 1, 0
            for lo in range(base, int(ends[at]), step):
                part = prefix_sums(values[lo : min(lo + step, int(ends[at]))])
                total += int(part[-1]) * pow(_R, lo - base, 1 << 64)
            out[at] = mix(np.array([total & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
        at = hi
    return out


_claimed: list = [None, None]


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def claim(owner: object, clear: Callable[[], None]) -> None:
    """Say that owner's memory of things met is used in this worker now. Workers live on from stage to
    stage: what the owner before remembered is cleared, so that only one such memory stands."""
    if _claimed[0] is not owner:
        if _claimed[1] is not None:
            _claimed[1]()
        _claimed[:] = [owner, clear]
        pa.set_memory_pool(pa.system_memory_pool())  # the default pool keeps what it once had
        gc.collect()
        trim()


def release() -> None:
    """Clear what another operator remembers in this worker; for operators that remember nothing."""
    claim("", lambda: None)


#: Spark's setting for the bytes of a batch that goes to Python, its default, and what mapped() sets in its place.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: bool = False) -> DataFrame:
    """df.mapInArrow(run) in batches of bounded bytes (a single longer row is a batch), where the session has
    not set another bound. What other operators remember in a worker is cleared first, unless run claims its
    own memory (keeps); memory that run is done with goes back to the system."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, None) == BATCH_DEFAULT:
        conf.set(BATCH_KEY, BATCH_BYTES)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        yield from run(batches)
        if not keeps:
            gc.collect()
        trim()

    return df.mapInArrow(wrapped, schema)


class HashTable:
    """Open addressing in numpy: uint64 keys to values; plain arrays, so it pickles as such."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.6))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, bool)
        self.values = np.zeros(1 << bits, values.dtype)
        for lo in range(0, len(keys), 1 << 18):
            self._insert(keys[lo : lo + (1 << 18)], values[lo : lo + (1 << 18)])

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = ~self.used[s]
            s_free, t_free = s[free], todo[free]
            s_one, first = np.unique(s_free, return_index=True)
            t_one = t_free[first]
            self.keys[s_one], self.values[s_one], self.used[s_one] = keys[t_one], values[t_one], True
            done = np.zeros(len(keys), bool)
            done[t_one] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values); what isn't found has value 0."""
        slot = self._slot(keys)
        got, used = self.keys[slot], self.used[slot]
        found = used & (got == keys)
        values = np.where(found, self.values[slot], self.values.dtype.type(0))
        todo = np.flatnonzero(used & ~found)
        at = slot[todo]
        while len(todo):
            at = (at + 1) & self.mask
            used = self.used[at]
            hit = used & (self.keys[at] == keys[todo])
            found[todo[hit]] = True
            values[todo[hit]] = self.values[at[hit]]
            more = used & ~hit
            todo, at = todo[more], at[more]
        return found, values
