"""Tables that cut the lineage: written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lakecheck.session import scratch_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir`` (see ``scratch_folder``).

    A lost executor costs only the tasks it ran, and what follows starts from files that all machines see.
    """
    folder = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
