"""Audit tables kept as files under partition folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# how audit files are written and read
PIPE_OPTIONS = {"sep": "|", "escape": "\\", "header": True, "nullValue": "\\N"}
# the folder of a run below its date; the column itself is in the files
RUN_FOLDER = "run"


def read_audit(spark: SparkSession, root: str) -> DataFrame:
    """Pipe-delimited audit files under ``run_date=`` folders, with folders of runs below or without.

    Columns go by the names in the header, never by position. All stay text, ``run_date`` too; blank text
    is kept apart from NULL.
    """
    read = spark.read.options(**PIPE_OPTIONS).csv(root)
    return read.drop(RUN_FOLDER).withColumn("run_date", F.col("run_date").cast("string"))


def read_escaped_audit(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    r"""Audit files in which a pipe inside a value is written ``\|`` without quotes.

    ``columns`` is the header of the files; repeated header lines are dropped. Works line by line on
    splittable text.
    """
    cells = F.split("value", r"(?<!\\)\|")
    lines = spark.read.text(root).filter(F.col("value") != "|".join(columns))
    wanted = [F.replace(cells[i], F.lit("\\|"), F.lit("|")).alias(c) for i, c in enumerate(columns)]
    partitions = [c for c in lines.columns if c not in ("value", *columns)]
    return lines.select(*wanted, *partitions)


def read_rule_rows(spark: SparkSession, root: str, schema) -> DataFrame:
    """Rule results as JSON lines under ``dt=/run_id=`` folders; both are text, as they were written."""
    folders = [T.StructField(c, T.StringType()) for c in ("dt", "run_id")]
    fields = [f for f in schema if f.name not in ("dt", "run_id")]
    return spark.read.schema(T.StructType(fields + folders)).json(root)
