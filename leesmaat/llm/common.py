"""What the operators of this package share: table access, task spreading, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leesmaat.workspace import cut, discard, shared_dir, tidy  # noqa: F401

#: A table is only sent to every executor when it was counted to have at most this many rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MOVING = re.compile(r"\b(?:Aggregate|Join|Window|Distinct|Deduplicate|Sort|Repartition|RepartitionByExpression)\b")


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Give Python work enough tasks; whole rows are dealt round-robin, so no key is hot.

    A scan is left alone if its files already make enough. What a shuffle made is dealt anew without looking: asking for its
    number of tasks would run it, and adaptive execution sizes tasks by bytes, not by the work on them."""
    want = df.sparkSession.sparkContext.defaultParallelism * factor
    if MOVING.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df.repartition(max(want, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table whose size the caller states as a parameter; more rows than that is an error, never a silent cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def latest(df: DataFrame, keys: Iterable[str], at: str) -> DataFrame:
    """One row per key, the one with the greatest `at`, of equal ones that with the greatest hash, so that every run takes the
    same; re-deliveries fold in a map-side partial aggregate."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(at).cast("string"), F.lit("")), F.xxhash64(*rest))).alias("_r")).select(*keys, "_r.*")


def words_column(text: Column) -> Column:
    """Runs of letters or digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def per_row(batches: Iterator[pa.RecordBatch], step, schema: pa.Schema, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Apply step(row tuple) -> iterable of output tuples to Arrow batches and hand the output on in bounded batches."""
    out: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.extend(step(*row))
            if len(out) >= rows:
                yield _batch(out, schema)
                out = []
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
