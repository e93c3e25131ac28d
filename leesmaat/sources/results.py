"""Around an analysis service: request checks, language gate, content keys, results already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_LEAST, TEXT_MOST, SUGGESTIONS_MOST = 10, 20_000, 50
GATE_LEAST = 25  # characters; shorter texts say nothing about their language


def validated(requests: DataFrame) -> DataFrame:
    """requests with `valid`: text of 10 to 20,000 characters, 1 to 50 suggestions or null, a known format or null."""
    n = F.length("text")
    ok = n.between(TEXT_LEAST, TEXT_MOST) & (F.col("max_suggestions").isNull() | F.col("max_suggestions").between(1, SUGGESTIONS_MOST)) & F.coalesce(F.lower("format").isin("text", "markdown", "md"), F.lit(True))
    return requests.withColumn("valid", ok)


def language_gate(documents: DataFrame, languages: tuple[str, ...] = ("nl", "du")) -> DataFrame:
    """documents with `passes`: Dutch by its tag, untagged, or too short to tell."""
    tagged = F.substring(F.lower("lang"), 1, 2).isin(*languages)
    return documents.withColumn("passes", F.coalesce(tagged, F.lit(True)) | (F.length(F.trim("text")) < GATE_LEAST))


def content_key(version: str, model: str, fmt: Column, cap: Column, text: Column) -> Column:
    """Key of a result: hash of all that decides it; nulls count as empty."""
    return F.sha2(F.concat_ws(",", F.lit(version), F.lit(model), F.coalesce(fmt, F.lit("")), F.coalesce(cap.cast("string"), F.lit("")), text), 256)


def misses(keyed: DataFrame, stored: DataFrame, id_column: str) -> DataFrame:
    """id_column, key of each key that no stored result has, once per key (the smallest id)."""
    return keyed.join(stored.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min(id_column).alias(id_column)).select(id_column, "key")


def request_levels(analysis: DataFrame) -> DataFrame:
    """request_id, mean_score, graded, sentences of stored sentence results; a re-delivered sentence counts once, the latest."""
    order = F.struct(F.col("ingested_at").cast("string"), -F.coalesce("lint_score", F.lit(1e9)), -F.coalesce("difficulty_level", F.lit(99)))
    once = analysis.groupBy("request_id", "sentence_index").agg(F.max_by(F.struct("lint_score", "difficulty_level"), order).alias("r"))
    return once.groupBy("request_id").agg(F.round(F.avg("r.lint_score"), 6).alias("mean_score"), (F.count("r.difficulty_level") > 0).alias("graded"), F.count("*").alias("sentences"))
