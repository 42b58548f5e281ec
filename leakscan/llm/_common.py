"""Helpers shared by the corpus operators: durable intermediate tables and vectorised text scanning.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (shared by all executors), as
Parquet: a lost executor only costs the tasks it was running.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

M64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only in local mode, where none is named, a temporary one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = getattr(spark, "_leakscan_shared", None) or "file://" + tempfile.mkdtemp(prefix="leakscan-")
        spark._leakscan_shared = where
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/leakscan-{name}-{uuid.uuid4().hex}"


#: With it, Spark deletes an execution's shuffle files when the execution ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str, swept: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executor loss.

    With ``swept``, the shuffle files of the write go when it ends, not whenever the driver collects its garbage."""
    path, conf = shared_path(df.sparkSession, name), df.sparkSession.conf
    had = conf.get(SWEEP, None)
    if swept:
        conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        if swept:
            conf.unset(SWEEP) if had is None else conf.set(SWEEP, had)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the stored tables of ours that ``df`` reads, when nothing else will read them; other files are left alone."""
    jvm, where = df.sparkSession.sparkContext._jvm, shared_dir(df.sparkSession)
    shared = jvm.org.apache.hadoop.fs.Path(where).toUri().getPath()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        if path.getName().startswith("leakscan-") and path.getParent().toUri().getPath() == shared:
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def freed(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of what has been stored: its cleaner follows the driver's garbage collection, every
    half hour if nothing else asks for it."""
    df.sparkSession.sparkContext._jvm.System.gc()


def tidy(f):
    """An Arrow function that gives what it has freed back to the system when a task ends: workers live on and are reused."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
            if trim is not None:
                trim(0)

    return run


def id_and(docs: DataFrame, ddl: str, *names: str) -> T.StructType:
    """The schema of ``docs``' doc_id (or the columns named), followed by the fields of ``ddl``."""
    return T.StructType([*docs.select(*(F.col(f"`{n}`") for n in names or ("doc_id",))).schema.fields, *T.StructType.fromDDL(ddl).fields])


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def partitions_for(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


# ---------------------------------------------------------------- vectorised scanning of Arrow text columns


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    d = np.frombuffer(data, dtype=np.uint8, count=int(o[-1]))[int(o[0]) :]
    return d, o - o[0]


def slices(offsets: np.ndarray, most: int):
    """Row ranges [a, b) whose texts have about ``most`` bytes together (a longer text stands alone)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sequence(seed: int, n: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


BYTE_CODE = _sequence(101, 256)
BASE = int(_sequence(202, 1)[0]) | 1
BASE_INV = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        if size <= 1 << 22:
            _powers[base] = have
    return have


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~space[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    cut = offsets[:-1][offsets[:-1] < n]
    begin[cut] = word[cut]
    cut = cut[cut > 0]
    end[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word [start, end) of ``data``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data))[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * powers(BASE_INV, len(data))[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


SHINGLE = _sequence(303, 6)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5):
    """Hashes of all ``k``-word windows in each text, and for each text the index of its first one.

    A text with fewer words, but any, has its whole sequence as the only window."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(at[-1], np.uint64)
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            h = h * SHINGLE[0] + words[i : len(words) - k + 1 + i] * SHINGLE[1]
        whole = np.flatnonzero(n >= k)
        if len(whole):
            take = np.repeat(first[:-1][whole] - at[:-1][whole], count[whole])
            to = np.repeat(n >= k, count)
            out[to] = h[take + np.flatnonzero(to)]
    for d in np.flatnonzero((n > 0) & (n < k)):
        h = int(n[d])
        for w in words[first[d] : first[d + 1]].tolist():
            h = (h * int(SHINGLE[2]) + w * int(SHINGLE[3])) & M64
        out[at[d]] = h
    return mix64(out), at
