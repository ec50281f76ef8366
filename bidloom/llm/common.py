"""Shared helpers: text buffers as numpy arrays, word tables, and tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch; Spark's own default suits narrow rows, not whole texts.
BATCH_ROWS = "2000"

# Freed Arrow buffers go back to the system; workers are kept for other stages, and should be small then. Arrays over
# four megabytes are mapped by themselves (the C library would raise that limit as it goes), so they too go back at once.
pa.set_memory_pool(pa.system_memory_pool())
_libc = ctypes.CDLL(None)
if hasattr(_libc, "mallopt"):
    _libc.mallopt(-3, 1 << 22)

#: The white space of the word pattern [^\x20\x09-\x0D]+.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Texts are handled in slices of about this many bytes, so memory doesn't follow the batch size.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 8192


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs in one process (tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.bidloom.shared", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.bidloom.shared", found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Batches for whole texts, unless the job has set a size of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def trim() -> None:
    """Give freed memory back to the system, where its C library can."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function over batches that keeps no freed memory when its partition ends."""

    def held(batches):
        yield from run(batches)
        trim()

    return held


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` stored and nothing reads any more."""
    for table in tables:
        if path := table.__dict__.get("stored_at"):
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of one driver table."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def crc_bucket(column: str, n: int):
    """crc32(decimal text of the id) mod n; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0)) % n


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch by the bytes of one text column; a slice has one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.maximum((np.cumsum(sizes) - sizes) // limit, np.arange(batch.num_rows) // SLICE_ROWS)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and len + 1 offsets; null counts as empty."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text a mask marks."""
    upto = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=upto[1:])
    return np.diff(upto[offsets])


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, divided by the bytes that ``between`` marks: (first word of each text and the end, code of each word, distinct words as bytes)."""
    solid = ~between[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = solid[edge]
    starts = np.flatnonzero(first)
    of = np.searchsorted(starts, offsets)
    at = np.searchsorted(np.flatnonzero(solid), starts) if len(starts) else starts
    packed = data[solid]
    at = np.append(at, len(packed)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode()
    return of, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of distinct byte strings."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in distinct.to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser by multiplication and shifts)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(of: np.ndarray, word_hash: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, text by text, and len + 1 offsets. A text of 1 to n - 1 words has one, of the whole sequence."""
    count = np.diff(of)
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    total = int(at[-1])
    text = np.repeat(np.arange(len(count)), many)
    start = of[:-1][text] + np.arange(total) - at[:-1][text]
    size = np.minimum(count[text], n)
    out = size.astype(np.uint64)
    for i in range(n):
        live = size > i
        if live.all():
            out = mix(out * np.uint64(0xA0761D6478BD642F) + word_hash[start + i])
        else:
            out[live] = mix(out[live] * np.uint64(0xA0761D6478BD642F) + word_hash[start[live] + i])
    return out, at


def keyed(fn, df: DataFrame, schema: str) -> DataFrame:
    """mapInArrow over slices of (id, text): fn(slice) gives the columns after the id, as a list of arrays."""
    names = StructType.fromDDL(schema).names
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), *fn(part.column(1))], names=names)

    return df.mapInArrow(lean(run), schema)
