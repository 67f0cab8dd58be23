"""Tables that change as a whole: data files beside the old ones, then one small file that names what is valid.

A write puts its files into a folder of its own under ``data/`` and then writes the list of all files of the table as
the next version under ``versions/``, a single file that Spark's commit moves into place at once. Readers take the
newest list. A write that fails before that leaves the table as it was, and a folder that no list names. Files are
never changed, so earlier versions stay readable. There may be one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakecheck.session import small_tasks
from lakecheck.sinks.merge import newest_written, upserted
from lakecheck.sinks.writers import overwrite

MANIFEST = "file string, schema string"
_BATCH = "batch"


def newest_version(spark: SparkSession, root: str) -> int | None:
    """The number of the valid version; None where nothing was written yet."""
    try:
        return _manifests(spark, root).agg(F.max("version")).first()[0]
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_version(df: DataFrame, root: str, partition_by: list[str] = ()) -> int:
    """Replace the whole table. Also for a frame that reads the table itself."""
    return _commit(df.sparkSession, root, _write_files(df, root, partition_by), df.schema)


def append_version(df: DataFrame, root: str, partition_by: list[str] = ()) -> int:
    """Add rows, by column name; the columns of the table must all be there."""
    files, schema = _files(df.sparkSession, root)
    added = _write_files(df.select(*schema.names).to(schema), root, partition_by)
    return _commit(df.sparkSession, root, files + added, schema)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as of its newest or of a given version."""
    files, schema = _files(spark, root, version)
    return _rows(spark, root, files, schema).drop("_file")


def version_files(spark: SparkSession, root: str, version: int | None = None) -> list[str]:
    return _files(spark, root, version)[0]


def restore_version(spark: SparkSession, root: str, version: int) -> int:
    """Make an earlier version the newest one again; only the list is written."""
    files, schema = _files(spark, root, version)
    return _commit(spark, root, files, schema)


def merge_version(
    spark: SparkSession,
    root: str,
    source: DataFrame,
    keys: list[str],
    update: list[str],
    latest_by: list[str | Column],
    set_values: dict[str, Column] | None = None,
    partition_by: list[str] = (),
) -> int:
    """Update matched and insert unmatched rows, as ``merge_upsert`` does, rewriting only files that hold a match.

    The newest source row per key is worked out once and written. Which files hold its keys is found by reading the
    key columns of the table. All matches lie in these files, so the merge is that of their rows with the source; all
    other files go into the next version as they are. What reaches the driver are names of files.
    """
    files, schema = _files(spark, root)
    table = _rows(spark, root, files, schema)
    n = table.count()
    fresh = newest_written(source, keys, latest_by, n)
    located = table.select(*keys, "_file")
    holding = located.join(fresh.select(*keys), keys, "left_semi").select("_file").distinct()
    known = {_bare(f): f for f in files}
    with small_tasks(spark, n + fresh.count()):
        touched = {known[_bare(unquote(r["_file"]))] for r in holding.collect()}
        old = _rows(spark, root, sorted(touched), schema).drop("_file")
        added = _write_files(upserted(old, fresh, keys, update, set_values), root, partition_by)
    return _commit(spark, root, [f for f in files if f not in touched] + added, schema)


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, version int").parquet(f"{root}/versions")


def _files(spark: SparkSession, root: str, version: int | None = None) -> tuple[list[str], T.StructType]:
    """The files of a version and the schema of the table. The driver lists them, as it does to read any table."""
    version = newest_version(spark, root) if version is None else version
    rows = _manifests(spark, root).where(F.col("version") == version).select("file", "schema").collect() if version else []
    if not rows:
        raise ValueError(f"no version {version or ''} of a table under {root}")
    schema = next(r["schema"] for r in rows if r["schema"])
    return [r["file"] for r in rows if r["file"]], T.StructType.fromJson(json.loads(schema))


def _rows(spark: SparkSession, root: str, files: list[str], schema: T.StructType) -> DataFrame:
    """The rows of the files, each with its file."""
    if not files:
        return spark.createDataFrame([], schema).withColumn("_file", F.lit(None).cast("string"))
    with_batch = T.StructType([*schema.fields, T.StructField(_BATCH, T.StringType())])
    read = spark.read.schema(with_batch).option("basePath", f"{root}/data").parquet(*files)
    return read.select(*schema.names, F.col("_metadata.file_path").alias("_file"))


def _write_files(df: DataFrame, root: str, partition_by: list[str]) -> list[str]:
    folder = f"{root}/data/{_BATCH}={uuid.uuid4().hex}"
    overwrite(df, folder, partition_by)
    return sorted(unquote(f) for f in df.sparkSession.read.schema(df.schema).parquet(folder).inputFiles())


def _commit(spark: SparkSession, root: str, files: list[str], schema: T.StructType) -> int:
    version = (newest_version(spark, root) or 0) + 1
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    rows = spark.createDataFrame([(None, schema.json()), *((f, None) for f in files)], MANIFEST)
    # what a failed write may have left under this number is not valid, and goes
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/versions/version={version}")
    return version


def _bare(path: str) -> str:
    """A file by its path alone: listed and read files differ in how the scheme is written."""
    return "/" + path.split(":", 1)[-1].lstrip("/")
