"""File listings as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_listing(spark: SparkSession, location: str, source: str = "") -> DataFrame:
    """One row per file below a folder: source, subfolder, path, modified (UTC) and length.

    Only the listing is read; the content column is pruned.
    """
    root = location.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    subfolder = F.regexp_extract("path", rf"\Q{root}\E/([^/]+)/", 1)
    modified = F.convert_timezone(None, F.lit("UTC"), F.col("modificationTime").cast("timestamp_ntz"))
    return files.select(
        F.lit(source).alias("source"),
        F.nullif(subfolder, F.lit("")).alias("subfolder"),
        "path",
        modified.alias("modified"),
        "length",
    )


def latest_per_subfolder(listing: DataFrame) -> DataFrame:
    return listing.groupBy("source", "subfolder").agg(
        F.max("modified").alias("latest_modified"),
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
    )
