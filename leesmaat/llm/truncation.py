"""Problem 5: values cut off by a field limit or in transfer.

Length hazards, the share of the values of at least L characters that have exactly L, are computed with window functions
for each source. The number of values of a length is tested, with false-discovery control over all lengths of all sources,
against the number at risk there times the pooled hazard of the lengths around that aren't limits themselves. Since hazards
grow to 1 where a source's lengths end, limit or not, a length must stand out from the numbers around too: the larger of
both expectations counts. Lengths that stand out are field limits.

Two signals make a value truncated. At a limit: an ending that is incomplete by the lower bar of such lengths, where dots may
stand for what was lost. In transfer, which cuts at any length: an ending that is incomplete by the strict bar."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leesmaat.llm.common import cut, latest, table
from leesmaat.llm.endings import evidence, judged

NEIGHBOURS = 20  # lengths on either side whose numbers are the yardstick
FALSE_RATE = 0.01
LEAST = 5  # values of one length, for a limit


def hazards(values: DataFrame, source: list[str], column: str) -> DataFrame:
    """source..., length, n, at_risk, hazard: per source and length that occurs."""
    lengths = values.filter(F.length(column) > 0).groupBy(*source, F.length(column).alias("length")).agg(F.count("*").alias("n"))
    down = W.partitionBy(*source).orderBy(F.col("length").desc())
    return lengths.withColumn("at_risk", F.sum("n").over(down)).withColumn("hazard", F.col("n") / F.col("at_risk"))


def dispersion(source: list[str]) -> Column:
    """Variance over mean of the numbers of the lengths around that aren't limits, 1 at least: texts made by rule have lengths
    that come in bunches, and a bunch is no limit."""
    near = W.partitionBy(*source).orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    usual = F.when(F.col("limit"), 0).otherwise(F.col("n")).cast("double")
    mean = (F.sum(usual).over(near) - usual) / (2 * NEIGHBOURS)
    square = (F.sum(usual * usual).over(near) - usual * usual) / (2 * NEIGHBOURS)
    return F.when(mean > 0, F.greatest((square - mean * mean) / mean, F.lit(1.0))).otherwise(1.0)


def expected(source: list[str]) -> Column:
    """Number of values to expect of a length by the lengths around that aren't limits: at_risk times their pooled hazard, or
    their mean number if that is more. Lengths without values are at risk too, with those of the next length that has some."""
    near = W.partitionBy(*source).orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    usual = lambda c: F.when(F.col("limit"), 0).otherwise(F.col(c))
    limits_ = F.col("limit").cast("int")
    exposed = F.col("at_risk") * F.least(F.col("gap"), F.lit(NEIGHBOURS)) - F.when(F.col("limit"), F.col("at_risk")).otherwise(0)
    others = F.sum(usual("n")).over(near) - usual("n")
    at_risk = F.sum(exposed).over(near) - F.when(F.col("limit"), 0).otherwise(F.col("at_risk"))
    hazard = (others + 0.5) / (at_risk + 1.0)
    mean = others / F.greatest(2 * NEIGHBOURS - F.sum(limits_).over(near) + limits_, F.lit(1))
    return F.greatest(F.col("at_risk") * F.least(hazard, F.lit(1.0)), mean, F.lit(0.02))


@F.pandas_udf(T.DoubleType())  # a type, not its name: the module must load without a session
def poisson_tail(n: pd.Series, expected: pd.Series) -> pd.Series:
    """P(X >= n) of a Poisson variable; n is rounded down."""

    def tail(k: int, m: float) -> float:
        term = math.exp(-m + k * math.log(m) - math.lgamma(k + 1))
        total, i = 0.0, k
        while term > total * 1e-12 and i < k + 2000:
            total += term
            i += 1
            term *= m / i
        return min(1.0, total) if k > m else 0.5

    return pd.Series([tail(int(a), float(b)) for a, b in zip(n, expected, strict=True)])


def limits(values: DataFrame, source: list[str], column: str, rate: float = FALSE_RATE) -> DataFrame:
    """Hazards with expected, p_value and `limit`: whether the length stands out by the Benjamini-Hochberg rule over all of
    them. Limits that were found no longer count as neighbours, until no more are found: one limit doesn't hide another."""
    before_it = F.lag("length").over(W.partitionBy(*source).orderBy("length"))
    h = cut(hazards(values, source, column).withColumn("gap", F.col("length") - F.coalesce(before_it, F.col("length") - 1)).withColumn("limit", F.lit(False)), "hazards")
    tests, before, now = h.count(), -1, 0
    while now > before:
        h = cut(h.withColumn("expected", expected(source)).withColumn("_d", dispersion(source)).withColumn("p_value", poisson_tail(F.col("n") / F.col("_d"), F.col("expected") / F.col("_d"))).drop("_d"), "hazards")
        # no p-value above the rate can pass, so only the few below it are ranked in one window
        ranked = h.filter((F.col("n") >= LEAST) & (F.col("p_value") <= rate)).withColumn("rank", F.row_number().over(W.orderBy("p_value", "length", *source)))
        bound = ranked.filter(F.col("p_value") <= rate * F.col("rank") / F.lit(max(tests, 1))).agg(F.max("p_value")).first()[0]
        h = h.withColumn("limit", F.col("limit") | (F.col("n") >= LEAST) & F.coalesce(F.col("p_value") <= F.lit(bound), F.lit(False)))
        before, now = now, h.filter("limit").count()
    return h.select(*source, "length", "n", "at_risk", "hazard", "expected", "p_value", "limit")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_table, row_key, provider, model, value, original of both columns; a re-delivered row counts once."""
    r = latest(table(spark, sf_dir, "llm_responses").select("response_id", "provider", "model", "content", "ingested_at"), ["response_id"], "ingested_at")
    s = latest(table(spark, sf_dir, "suggestions").select("suggestion_id", "model", "suggested_text", "original_text", "ingested_at"), ["suggestion_id"], "ingested_at")
    model = F.lower(F.trim("model")).alias("model")
    none = F.lit(None).cast("string")
    return r.select(F.lit("llm_responses").alias("src_table"), F.col("response_id").cast("string").alias("row_key"), "provider", model, F.col("content").alias("value"), none.alias("original")).unionByName(
        s.select(F.lit("suggestions").alias("src_table"), F.col("suggestion_id").alias("row_key"), none.alias("provider"), model, F.col("suggested_text").alias("value"), F.col("original_text").alias("original"))
    )


SIGNALS = ("limit", "transfer")


def signalled(vals: DataFrame) -> DataFrame:
    """vals with `signal`: limit for an incomplete ending at a field limit of its source, transfer for one elsewhere, else
    null; null and blank values have none."""
    counts = cut(evidence(vals, "value"), "endings")
    source = ["src_table", "provider", "model"]
    at = limits(vals, source, "value").filter("limit").select(*source, "length")
    bare = F.length(F.regexp_replace("value", r"(?:\.\.\.|…)$", ""))  # dots that stand for what was cut
    lengths = vals.select("*", F.explode(F.array_distinct(F.array(F.length("value"), bare))).alias("_n"))
    same = (F.col("_n") == F.col("l.length")) & F.col("v.src_table").eqNullSafe(F.col("l.src_table")) & F.col("v.provider").eqNullSafe(F.col("l.provider")) & F.col("v.model").eqNullSafe(F.col("l.model"))
    hit = lengths.alias("v").join(at.alias("l"), same, "left_semi").select("src_table", "row_key").distinct().withColumn("_at", F.lit(True))
    flagged = vals.join(hit, ["src_table", "row_key"], "left").withColumn("_at", F.coalesce("_at", F.lit(False)))
    ends = judged(flagged, ["src_table", "row_key"], "value", "original", counts, at_limit="_at").filter("incomplete").select("src_table", "row_key").distinct().withColumn("_cut", F.lit(True))
    return flagged.join(ends, ["src_table", "row_key"], "left").withColumn("signal", F.when(F.col("_cut"), F.when(F.col("_at"), SIGNALS[0]).otherwise(SIGNALS[1]))).drop("_at", "_cut")


def truncated(vals: DataFrame) -> DataFrame:
    """vals with `truncated`: whether there is a signal."""
    return signalled(vals).withColumn("truncated", F.col("signal").isNotNull()).drop("signal")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(values(spark, sf_dir)).filter("truncated").select("src_table", "row_key")


def p5_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths per source with their hazards and whether they are field limits."""
    return limits(values(spark, sf_dir), ["src_table", "provider", "model"], "value")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, provider and model: values, truncated ones and their share."""
    n = F.count(F.when(F.length(F.trim("value")) > 0, 1))
    t = F.count(F.when(F.col("truncated"), 1))
    return truncated(values(spark, sf_dir)).groupBy("src_table", "provider", "model").agg(n.alias("n_values"), t.alias("n_truncated"), F.round(t / F.greatest(n, F.lit(1)), 6).alias("share"))


def p5_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, provider and model: truncated values at a field limit and in transfer."""
    n = [F.count(F.when(F.col("signal") == x, 1)).alias(f"n_{x}") for x in SIGNALS]
    return signalled(values(spark, sf_dir)).groupBy("src_table", "provider", "model").agg(*n)
