"""What the operators share: written intermediate tables, and texts as numpy arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked on in pieces of about so many bytes, so that temporary arrays stay small.
CHUNK_BYTES = 1 << 20
#: Rows go to Python in batches of about so many bytes; a longer row stands alone.
BATCH_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder in the place that driver and executors share (spark.checkpoint.dir).

    Where that is unset a temporary folder is set if all runs on one machine, as in tests; on a cluster this is an error, as executors wouldn't see each other's rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them again: lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone, and with it its way to the folder
            return


def in_batches(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow, with the session's batches held to BATCH_BYTES: JVM and Python both buffer whole batches outside the heap, in each task.

    What comes back has about the size of what went in. Its own limit (maxBytesPerOutputBatch) stays unset: with it, Spark 4.1 fails on a batch without rows.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df.mapInArrow(f, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- texts as arrays

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words up to so many bytes are hashed eight bytes at a time, all words at once.
_SHORT = 64
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], by their bytes alone. Every eight bytes are mixed before the next ones come in, so no regular pattern cancels out."""
    left = ends - starts
    out = mix(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    open_ = np.flatnonzero(left <= _SHORT)
    at = starts[open_]
    left = left[open_]
    while len(open_):
        out[open_] = mix(out[open_] ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(ends - starts > _SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), 11)
    return out


class Texts:
    """The UTF-8 bytes of some texts side by side: text i is data[at[i]:at[i + 1]]. Null is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        n, first = len(column), column.offset
        buffers = column.buffers()
        at = np.frombuffer(buffers[1], np.int64, n + 1, first * 8).copy() if n else np.zeros(1, np.int64)
        raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        if column.null_count:
            keep = ~np.asarray(column.is_null())
            sizes = np.diff(at) * keep
            parts = [raw[a : a + s] for a, s in zip(at[:-1], sizes, strict=True) if s]
            self.data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
            self.at = np.concatenate([[0], np.cumsum(sizes)])
        else:
            self.data, self.at = raw[at[0] : at[-1]], at - at[0]

    def __len__(self) -> int:
        return len(self.at) - 1

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words (no white space of ASCII inside), their hashes, and each text's first word."""
        data = _LOWER[self.data] if lower else self.data
        inside = ~_WHITE[data]
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
        filled = np.diff(self.at) > 0
        before[self.at[:-1][filled]] = False
        after[self.at[1:][filled] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, word_hashes(data, starts, ends), np.searchsorted(starts, self.at)


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES):
    """Slices of a batch whose texts have about `most` bytes together; a longer text stands alone."""
    texts = batch.column(column)
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    first = 0
    while first < batch.num_rows:
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(first, last - first)
        first = last
