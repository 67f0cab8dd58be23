"""Reads of tables, landing trees and declared external files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Short type names of an ingestion config.
TYPE_NAMES = {
    "str": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
}
FORMATS = ("parquet", "orc", "json", "csv")


def schema_from_config(columns: dict[str, str]) -> T.StructType:
    """Nullable fields in the given order; an unknown type is an error."""
    fields = []
    for name, kind in columns.items():
        decimal = re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", kind)
        if decimal:
            type_ = T.DecimalType(int(decimal[1]), int(decimal[2]))
        elif kind in TYPE_NAMES:
            type_ = TYPE_NAMES[kind]
        else:
            raise ValueError(f"unsupported data type: {kind}")
        fields.append(T.StructField(name, type_, True))
    return T.StructType(fields)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table (``database.table``), or parquet files where the name is a path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_landing(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """All ``*.csv`` files under a folder tree, with header and declared schema."""
    return (
        spark.read.schema(schema_from_config(columns))
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(path)
    )


def read_landings(spark: SparkSession, jobs: list[dict]) -> dict[str, DataFrame]:
    """One frame per configured job: ``{"landing_table", "landing_loc", "dtype"}``."""
    return {job["landing_table"]: read_landing(spark, job["landing_loc"], job["dtype"]) for job in jobs}


def read_external(
    spark: SparkSession,
    location: str,
    format_: str,
    columns: list[dict],
    skip_header: bool = False,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Files with declared columns ``[{"name", "type"}]`` in SQL types."""
    kind = format_.lower()
    if kind not in FORMATS:
        raise ValueError(f"unsupported format: {format_}")
    ddl = ", ".join(f"`{c['name']}` {c['type']}" for c in columns)
    reader = spark.read.format(kind).schema(ddl).options(**(options or {}))
    if kind == "csv" and skip_header:
        reader = reader.option("header", True)
    return reader.load(location)


def staged_read(
    spark: SparkSession, location: str, format_: str, columns: list[dict], target: str, select_sql: str | None = None
) -> DataFrame:
    """Read external files, select from them as ``{source}``, write the result to ``target`` and read it back."""
    source = read_external(spark, location, format_, columns)
    picked = spark.sql(select_sql, source=source) if select_sql else source
    picked.write.mode("overwrite").parquet(target)
    return spark.read.schema(picked.schema).parquet(target)
