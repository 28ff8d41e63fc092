"""Runs a stream over all that its source holds now, then stops."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own() -> str:
    path = tempfile.mkdtemp(prefix="contentsec-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of this process if its executors run in it too; on a
    cluster an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's result, written to the shared folder: appended rows, or the last complete result."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{at}/rows").outputMode(mode).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/rows")).outputMode(mode).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def drain_split(stream: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a stream for which `by` holds, and the others, each from a sink of its own. A batch that is written again
    after a failure replaces what it wrote before."""
    from contentsec.streaming.gates import split

    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    sink = lambda name: lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{at}/{name}/epoch={epoch}")
    stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(split(sink("good"), sink("bad"), by)).start().awaitTermination()
    read = lambda name: spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{at}/{name}")
    return read("good"), read("bad")
