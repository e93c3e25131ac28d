"""Figures for views of a corpus, and evaluation of detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def box(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """min, q1, median, q3, max of a column, nulls left out; exact quartiles."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.filter(F.col(column).isNotNull()).groupBy(*(by or [])).agg(F.min(column).alias("min"), q.alias("_q"), F.max(column).alias("max"))
    return g.select(*(by or []), "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "max")


def noun_counts(features: DataFrame) -> DataFrame:
    return features.filter(F.col("noun_class").isNotNull()).groupBy("noun_class").agg(F.count("*").alias("n"))


def dependency_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.filter(F.col("dep_length") > 0).groupBy("dep_length").agg(F.count("*").alias("n"))


def presence(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall of `produced` against `expected`; rows with a null in either are counted as unlabelled."""
    e, p = F.col("expected"), F.col("produced")
    n = lambda c: F.count(F.when(c, 1))
    g = items.groupBy(*(by or [])).agg(n(e & p).alias("tp"), n(~e & p).alias("fp"), n(e & ~p).alias("fn"), n(~e & ~p).alias("tn"), n(e.isNull() | p.isNull()).alias("unlabelled"))
    return g.select("*", F.expr("round(tp / nullif(tp + fp, 0), 6)").alias("precision"), F.expr("round(tp / nullif(tp + fn, 0), 6)").alias("recall"))


def shared_vocabulary(a: DataFrame, b: DataFrame, least: int = 5) -> DataFrame:
    """word: words of at least so many letters that both tables of words (column word) have."""
    long = lambda d: d.select("word").filter(F.length("word") >= least)
    return long(a).intersect(long(b))


def list_verdicts(suggestions: DataFrame, rewrites: tuple[str, ...]) -> DataFrame:
    """doc_id, sent_idx, verdict: what a sentence that should become a list got: missing (no list), unsuppressed (a full rewrite
    beside the list), or ok. suggestions: doc_id, sent_idx, type, one row at least for each sentence to judge (type null: none)."""
    g = suggestions.groupBy("doc_id", "sent_idx").agg(F.collect_set("type").alias("types"))
    both = F.arrays_overlap("types", F.array(*map(F.lit, rewrites)))
    return g.select("doc_id", "sent_idx", F.when(~F.array_contains("types", "enumeration"), "missing").when(both, "unsuppressed").otherwise("ok").alias("verdict"))


def tally(rows: DataFrame, by: list[str], verdict: str, verdicts: list[str]) -> DataFrame:
    """by..., one count for each verdict, every: how often each verdict was given; others count in every only."""
    return rows.groupBy(*by).agg(*[F.count(F.when(F.col(verdict) == v, 1)).alias(v) for v in verdicts], F.count("*").alias("every"))
