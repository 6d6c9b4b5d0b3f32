"""What the operators of this subpackage share: inputs, the shared folder, Arrow helpers.

Files of an operator's intermediate state go below the folder that the cluster names in
``spark.checkpoint.dir``; driver and executors all see it, so a task that is run again on
another executor finds what it needs. Only where that setting is unset and Spark runs in one
process, as in tests, a folder under the warehouse is used instead; a cluster must name one.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows in one Arrow batch; texts are of any length, so batches are kept small.
BATCH_ROWS = 128
#: Entries of a worker's cache of words; a full cache is emptied.
CACHE_ENTRIES = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as (doc_id long, text string), null texts empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Python workers get at most so many rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; it goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    uri = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    filesystem, path = open_fs(uri)
    filesystem.create_dir(path, recursive=True)
    atexit.register(_remove, uri)
    return uri


def _remove(uri: str) -> None:
    filesystem, path = open_fs(uri)
    if filesystem.get_file_info(path).type != fs.FileType.NotFound:
        filesystem.delete_dir(path)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put_bytes(uri: str, data: bytes | memoryview) -> None:
    """Write a whole file; a repeated task writes the same bytes, and readers see all or nothing.

    Some file systems refuse to move a file onto another: one of the same size that is there already is the same file, of
    an earlier attempt, and stays.
    """
    filesystem, path = open_fs(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}"
    with filesystem.open_output_stream(part) as out:
        out.write(data)
    try:
        filesystem.move(part, path)
    except OSError:
        there = filesystem.get_file_info(path)
        if there.type != fs.FileType.File or there.size != memoryview(data).nbytes:
            raise
        filesystem.delete_file(part)


def put_array(uri: str, values: np.ndarray) -> None:
    put_bytes(uri, np.ascontiguousarray(values).view(np.uint8).data)


def get_array(uri: str, dtype) -> np.ndarray:
    """A stored array, memory-mapped where the shared folder is a mounted one, else read."""
    filesystem, path = open_fs(uri)
    size = filesystem.get_file_info(path).size
    if size == 0:
        return np.empty(0, dtype)
    if isinstance(filesystem, fs.LocalFileSystem):
        return np.asarray(np.memmap(path, dtype=dtype, mode="r"))  # a plain view: the class costs time at each access
    with filesystem.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype)


def pack(values: np.ndarray) -> bytes:
    """Ascending or small integers in few bytes: differences, by byte plane, compressed."""
    a = np.asarray(values, np.int64)
    planes = np.diff(a, prepend=0).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def give_back() -> None:
    """Give what this worker has freed back to the system: workers live on, and the next task may be of another operator."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def keep(df: DataFrame, uri: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it again."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


#: Rows of a few columns that may be sent to every task; larger sides are joined by a shuffle.
SMALL_ROWS = 300_000


def small_side(df: DataFrame) -> DataFrame:
    """df, a written table of few narrow columns, with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def per_text(df: DataFrame, fields: str, work: Callable[[list], list], text_col: str = "text", arrow_texts: bool = False) -> DataFrame:
    """df with columns computed from each text in Python; columns named like a new one are replaced.

    work gets the texts of a batch, as a list or as an Arrow array, and returns one list of values
    per new field, in order. Only the text goes to the Python worker, and only the new values come back.
    """
    schema = StructType.fromDDL(fields)
    arrow = to_arrow_schema(schema)

    def run(texts: pa.Array) -> pa.Array:
        made = work(texts if arrow_texts else texts.to_pylist())
        columns = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, arrow.types, strict=True)]
        return pa.StructArray.from_arrays(columns, fields=list(arrow))

    # Not deterministic for the optimizer, so that a filter on a new column does not compute it twice.
    made = F.arrow_udf(run, schema).asNondeterministic()
    names = [c for c in df.columns if c not in schema.names]
    return df.select(*names, made(F.col(text_col)).alias("__made")).select(*names, "__made.*")


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of an id's text, mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))
