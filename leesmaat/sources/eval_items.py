"""Labelled evaluation items: reading, per-phenomenon counts, resumable results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leesmaat.workspace import cut

SCHEMA = "description string, items array<struct<id:string, should_suggest:boolean, phenomena:array<string>, must_not:array<string>, text:string>>"


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """id, should_suggest, phenomena, must_not, text, set_no of JSON files with an `items` array; set_no is the place of the file in the list."""
    out = None
    for n, p in enumerate(paths, 1):
        d = spark.read.schema(SCHEMA).json(p, multiLine=True).select(F.explode("items").alias("x")).select("x.*").withColumn("set_no", F.lit(n))
        out = d if out is None else out.unionByName(d)
    return out


def phenomena(items: DataFrame) -> DataFrame:
    """phenomenon, items, positive; items without phenomena count nowhere, null labels as not positive."""
    e = items.select("should_suggest", F.explode("phenomena").alias("phenomenon"))
    return e.groupBy("phenomenon").agg(F.count("*").alias("items"), F.count(F.when(F.col("should_suggest"), 1)).alias("positive"))


def pending(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items without a result yet."""
    return items.join(done.select("id").distinct(), "id", "left_anti")


def record(results: DataFrame, path: str) -> int:
    """Append results (with id) that the folder of tables doesn't hold yet; how many there were. A run that was broken off goes
    on where it stopped: pending(items, read back) are the ones left."""
    spark = results.sparkSession
    try:
        done = spark.read.parquet(path).select("id")
    except AnalysisException:  # nothing there yet
        done = spark.createDataFrame([], "id string")
    new = cut(pending(results, done), "results")
    new.write.mode("append").parquet(path)
    return new.count()
