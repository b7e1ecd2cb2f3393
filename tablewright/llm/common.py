"""What the corpus operators share: durable intermediates and batch-wise text handling."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import make_importable

#: Text bytes that one step of a Python worker holds in flat arrays at a time, and rows of one Arrow batch.
CHUNK_BYTES, BATCH_ROWS = 2 << 20, 2_000


_libc = ctypes.CDLL(name) if (name := ctypes.util.find_library("c")) else None
_libc = _libc if hasattr(_libc, "malloc_trim") else None

#: Rows of ids and numbers (8 to 24 bytes each) that are still broadcast, after they were counted.
BROADCAST_ROWS = 300_000


#: Rows under one key from which on it counts as hot where the other side of a join is not broadcast.
HOT_ROWS = 10_000


def few(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast while its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner", small: bool | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has each key once, so that no key of ``left`` loads one task.

    A small right side (counted, unless ``small`` says so) is broadcast. Else the keys that are hot on the left
    are joined by a broadcast of their own rows alone, of which there are few by their number of rows, and the others by a shuffle.
    """
    if right.count() <= BROADCAST_ROWS if small is None else small:
        return left.join(F.broadcast(right), key, how)
    hot, least = durable(left.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > HOT_ROWS)), HOT_ROWS
    while hot.count() > BROADCAST_ROWS:
        least *= 2
        hot = hot.filter(F.col("__rows") > least)
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(hot.select(key))
    rest = left.join(hot, key, "left_anti").join(right, key, how)
    return rest.unionByName(left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how))


def of(df: DataFrame, name: str) -> Column:
    """A column of ``df`` by its exact name, whatever characters it holds."""
    return df["`" + name.replace("`", "``") + "`"]


def digest_of(text: Column) -> Column:
    """64 bits of a text, which tell rows under one id apart."""
    return F.xxhash64(text.cast("string"))


def without_rows(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose id and text are not those of a row of ``gone`` (id, dig); null ids are equal."""
    gone = few(durable(gone.select(F.col("id").alias("__gone_id"), F.col("dig").alias("__gone_dig")).distinct()))
    same = of(df, id_col).eqNullSafe(gone["__gone_id"]) & (digest_of(of(df, text_col)) == gone["__gone_dig"])
    return df.join(gone, same, "left_anti")


def ready(spark: SparkSession) -> None:
    """What the operators ask of a session: workers that find this package, and Arrow batches of bounded size."""
    make_importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def trim() -> None:
    """Gives freed memory back to the system, as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a new one of this machine, for local sessions alone."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="tablewright-")
    return _own_dirs[context.applicationId]


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, its lineage cut; it survives lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def texts_of(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts of a batch, each of about CHUNK_BYTES; a null is an empty text."""
    array = batch.column(column)
    if not len(array):
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(array), 0).to_numpy(zero_copy_only=False), np.int64)
    groups = np.cumsum(sizes) // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(array)]
    for start, end in zip(edges, edges[1:], strict=False):
        yield start, [x or "" for x in array.slice(start, end - start).to_pylist()]
    trim()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_codes(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Dictionary codes of words, and the distinct words."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def word_hashes(codes: np.ndarray, distinct: list[bytes]) -> np.ndarray:
    """64-bit hashes of coded words."""
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) for w in distinct), np.uint64, len(distinct))
    return table[codes] if len(codes) else np.empty(0, np.uint64)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hashes of every ``width`` consecutive items of a flat array."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + hashes[k : k + n] + np.uint64(k + 1))
    return out


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)
