"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a vectorised step holds at once (a longer text is a block of its own).
BLOCK_BYTES = 4 << 20


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="contentsec-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a folder of this process if its executors run in it
    too; on a cluster, whose executors would each write to a disk of their own, an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{_own_folder()}"


#: Tables that this process has written and not yet removed.
_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: cuts the lineage, survives lost executors,
    and gives later plans a measured size (so Spark broadcasts only what is below its threshold). The table is needed for
    as long as a result that reads it; scratch() or remove_tables() ends that."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Removes tables that materialize() wrote, all or some; results that read them must be done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(_written if paths is None else paths):
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        _written.remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: list[str]) -> Iterator[None]:
    """Tables written inside are removed at its end, except the last one, whose path is added to keep."""
    before = len(_written)
    yield
    *rest, last = _written[before:]
    keep.append(last)
    remove_tables(spark, rest)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator uses, so extra columns can't clash; null text is empty."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values in one array, and where each value starts (one more offset than values); null is empty."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_table(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def string_column(strings: list[str]) -> pa.Array:
    return pa.array(strings, pa.string())
