"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Bytes of files or of shuffled rows for one task of a job whose tasks sort all that they read, and rows of a shuffle partition.
SORT_BYTES = 16 << 20
SORT_ROWS = 500_000


def build_session(app: str = "lakecheck", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on.

    Shuffle partitions are left to adaptive coalescing: start high on a cluster and let Spark merge,
    or pass ``**{"spark.sql.shuffle.partitions": "8"}`` for a laptop.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def small_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside the block, jobs that sort about ``rows`` rows deal them out by ``SORT_BYTES`` and ``SORT_ROWS``.

    A task of a sort or merge join holds what it reads, so its memory follows the size of a partition. The session's
    own settings count where they are finer, and all come back at the end of the block. It is for jobs that run inside
    the block; others that the session starts meanwhile get smaller tasks too, and the same rows.
    """
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    finer = {key: f"{min(_bytes(spark.conf.get(key)), SORT_BYTES)}b" for key in sizes}
    number = "spark.sql.shuffle.partitions"
    finer[number] = str(max(int(spark.conf.get(number)), -(-rows // SORT_ROWS)))
    before = {key: spark.conf.get(key, None) for key in finer}
    try:
        for key, value in finer.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables.

    It lies under ``spark.checkpoint.dir``, which every executor can reach. Only where that is unset and the
    session runs in one process, as in tests, a local temporary folder is made; on a cluster it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master: {master})")
    return tempfile.mkdtemp(prefix=f"lakecheck-{name}-")
