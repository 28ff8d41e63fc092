"""Sources and sinks: content in, reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentsec.config import Config


def binary_files(spark: SparkSession, path: str, glob: str | None = None, config: Config = Config()) -> DataFrame:  # noqa: B008
    """(filename, data, length, refused) of documents or images. Files over the length limit are listed with the reason
    in refused; their data is null and never read, as the scan that lists them leaves the content out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1).alias("filename")
    read = reader.load(path).filter(F.col("length") <= config.content_length).select(name, F.col("content").alias("data"), "length", F.lit(None).cast("string").alias("refused"))
    over = reader.load(path).filter(F.col("length") > config.content_length).select(name, F.lit(None).cast("binary").alias("data"), "length", F.lit(f"over {config.content_length} bytes").alias("refused"))
    return read.unionByName(over)


def images(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:  # noqa: B008
    least, most = config.image_bytes
    return binary_files(spark, path, "*.{png,gif,jpg,jpeg,tif,tiff,bmp,webp}", config).filter(F.col("length").between(least, most))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(filename, body) of text or HTML files."""
    return spark.read.option("wholetext", "true").text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("body"))


def reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports that were written as JSON lines; the schema is given, never inferred."""
    return spark.read.schema(schema).json(path)


def write_reports(reported: DataFrame, path: str) -> None:
    """Parquet by trust tier, so that a reader of one tier opens its files only."""
    reported.write.mode("overwrite").partitionBy("trust_tier").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
