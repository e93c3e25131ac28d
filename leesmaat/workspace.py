"""Tables between stages: written once to the folder all executors share, so that no later plan carries the work of earlier ones."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FINER = 8
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. A folder of our own is made only where that is unset and all tasks run on this very
    machine, as in local tests; on a cluster every executor would write to its own disk, so there it is an error."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leesmaat-"))
            current = spark.sparkContext.getCheckpointDir()
        own = current
    return own


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go as soon as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANED)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANED, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and go on from the written table; lost executors cost no recomputation. The shuffle files
    that made it go as soon as it is written."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"cut-{name}-{uuid.uuid4().hex}")
    with tidy(spark):
        df.write.parquet(path, compression="zstd")
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut has written and that nothing is read from any more."""
    for df in tables:
        spark = df.sparkSession
        known = _written.get(spark.sparkContext.applicationId, [])
        inside = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for path in [p for p in known if p and any(f.endswith(p.split(":", 1)[-1].lstrip("/")) for f in inside)]:
            _delete(spark, path)
            known[known.index(path)] = ""  # marks count on


def mark(spark: SparkSession) -> int:
    """How many tables were written so far, for release."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables written after a mark, once nothing is read from them any more; the number of tables deleted."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone, paths[since:] = [p for p in paths[since:] if p], []
    for path in gone:
        _delete(spark, path)
    return len(gone)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def by_document(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deal rows by document into FINER times as many tasks as a shuffle has. The number is given, because rows grow when they
    are taken apart: sized by what comes in, a task could hold far too much of what comes out, and its sorts would spill."""
    return df.repartition(FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
