"""What the operators of this subpackage share: shared-folder tables, batch bounds, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Rows of a document table handed to a Python worker at once; with long texts the byte bound is met first.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20
#: Bytes of a row group of a table in the shared folder: a writer holds one, and a reader a column of one.
ROW_GROUP = 16 << 20
#: Entries a worker's memo may hold before it is emptied.
MEMO_ENTRIES = 100_000

_owner: str | None = None
_held: dict[str, Callable[[], None]] = {}


def turn(owner: str, release: Callable[[], None] | None = None) -> None:
    """Called as a task begins. Spark uses a worker process for many tasks: what one operator keeps between its tasks is let go when another's begin."""
    global _owner
    if _owner not in (None, owner):
        while _held:
            _held.popitem()[1]()
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    _owner = owner
    if release:
        _held[owner] = release


_made: list[tuple[SparkSession, str]] = []


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold Arrow batches to `rows` rows and BATCH_BYTES bytes, so that a worker's memory follows neither row nor text counts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local one only where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of shared_folder()."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            discard(spark, path)
        except Exception:  # the JVM may be gone by now
            return


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and losing an executor costs no recomputation."""
    path = path or shared_folder(df.sparkSession)
    df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's bytes (file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, each: int = 64 << 20) -> int:
    """Shuffle partitions such that each holds about `each` bytes of df's files, at least as many as the session asks for."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(200_000, math.ceil(plan_bytes(df) / each)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: Bytes that are hashed at once.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.array([1] + [_BASE] * CHUNK, np.uint64), dtype=np.uint64)
_INVERSE = np.cumprod(np.array([1] + [pow(_BASE, -1, 1 << 64)] * CHUNK, np.uint64), dtype=np.uint64)


class Words:
    """64-bit hashes of the words of many texts at once. `fold` maps each byte to what it counts as, 32 for separators.

    A word's hash is a polynomial over random numbers of its bytes, taken as a difference of prefix sums: no word is cut out or memoised.
    """

    def __init__(self, fold: bytes):
        self.separates = np.frombuffer(fold, np.uint8) == 32
        self.values = odd_multipliers(256, 0x3017D)[np.frombuffer(fold, np.uint8)]

    def _chunk(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, starts) of the words of at most CHUNK bytes."""
        edges = np.flatnonzero(np.diff(self.separates[data], prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * _POWERS[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * _INVERSE[starts]), starts

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Hashes of a text of any length: pieces are cut between words; a word longer than a chunk is summed up."""
        out, at = [], 0
        while at < len(data):
            end = min(at + CHUNK, len(data))
            if end < len(data):
                cut = np.flatnonzero(self.separates[data[at:end]])
                if len(cut):
                    end = at + int(cut[-1]) + 1
                else:
                    total, scale = 0, 1
                    while at < len(data):
                        part = data[at : at + CHUNK]
                        stop = np.flatnonzero(self.separates[part])
                        part = part[: stop[0]] if len(stop) else part
                        total = (total + scale * int((self.values[part] * _POWERS[: len(part)]).sum(dtype=np.uint64))) & 0xFFFFFFFFFFFFFFFF
                        scale = scale * int(_POWERS[len(part)]) & 0xFFFFFFFFFFFFFFFF
                        at += len(part)
                        if len(stop):
                            break
                    out.append(mixed(np.array([total], np.uint64)))
                    continue
            out.append(self._chunk(data[at:end])[0])
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Hashes of the words of each text."""
        k = 0
        while k < len(texts):
            size, first = len(texts[k]), k
            if size >= CHUNK:
                yield self._long(np.frombuffer(texts[k], np.uint8))
                k += 1
                continue
            while k + 1 < len(texts) and size + 1 + len(texts[k + 1]) < CHUNK:
                k += 1
                size += 1 + len(texts[k])
            k += 1
            hashes, starts = self._chunk(np.frombuffer(b"\n".join(texts[first:k]), np.uint8))
            borders = np.cumsum([len(t) + 1 for t in texts[first:k]])
            yield from np.split(hashes, np.searchsorted(starts, borders[:-1]))


#: Words are what white space (space, tab to carriage return) leaves; A-Z is lowered.
BLANK_WORDS = Words(bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256)))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words: differences of prefix sums again."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = CHUNK - k
    for i in range(0, n, step):
        part = hashes[i : i + step + k - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POWERS[: len(part)], out=sums[1:])
        m = len(part) - k + 1
        out[i : i + m] = (sums[k:] - sums[:-k]) * _INVERSE[:m]
    return mixed(out + np.uint64(k))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter sequence is one shingle, an empty one none."""
    return np.unique(run_hashes(hashes, min(len(hashes), k))) if len(hashes) else np.empty(0, np.uint64)


def texts_of(batch, name: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]
