"""Compaction of small files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 256 * 1024 * 1024


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``file, folder, length`` of every data file, from the listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "length")


def is_small(length: str | Column, target_bytes: int) -> Column:
    return F.col(length) * 2 < target_bytes


def plan_compaction(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """``file, bucket``: files under half the target, packed per folder by running size in the order of their names."""
    before = Window.partitionBy("folder").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("length").over(before), F.lit(0)) / target_bytes)
    return files.where(is_small("length", target_bytes)).select("file", F.concat_ws("#", "folder", part.cast("string")).alias("bucket"))


def compact(
    spark: SparkSession, path: str, out: str, partition_by: list[str] = (), target_bytes: int = TARGET_BYTES, schema: T.StructType | None = None
) -> DataFrame:
    """Rewrite a table to ``out`` with its small files joined to files of about ``target_bytes``, and return it.

    Whole files are dealt out, so rows keep their order inside a file, and a file that is large enough passes
    through without a shuffle. A bucket is at most one target and one small file. Partition values are text, as
    their folders say (``001`` stays ``001``), unless ``schema`` gives them a type.
    """
    if schema is None:
        found = spark.read.parquet(path).schema
        schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in partition_by else f for f in found])
    files = file_sizes(spark, path)
    plan = plan_compaction(files, target_bytes)
    rows = spark.read.schema(schema).parquet(path)
    small = is_small("_metadata.file_size", target_bytes)
    # the path of a listed file and of a read row differ in the form of their scheme only
    bare = lambda c: F.url_decode(F.regexp_replace(c, r"^[a-z0-9]+:/*", "/"))
    named = rows.where(small).withColumns({"_file": bare(F.col("_metadata.file_path")), "_row": F.col("_metadata.row_index")})
    buckets = plan.select(bare(F.col("file")).alias("_file"), F.col("bucket").alias("_bucket"))
    packed = named.join(buckets, "_file").repartition("_bucket").sortWithinPartitions("_bucket", "_file", "_row").select(*rows.columns)
    whole = rows.where(~small)
    kept_whole = not files.where(~is_small("length", target_bytes)).isEmpty()
    for part, mode in ((packed, "overwrite"), (whole, "append"))[: 2 if kept_whole else 1]:
        writer = part.write.mode(mode).option("partitionOverwriteMode", "static")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(out)
    return spark.read.schema(schema).parquet(out)
