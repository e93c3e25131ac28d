"""Problem 3: one reading level for each Dutch text, from 1 (easy) to 4 (very hard).

Every word gets an acquisition grade, the mean of its distribution over the levels of graded texts, each level weighing
the same. Texts are graded by editors, or else, at half the weight, by the mean of the usable levels of their sentences.
A text's level is predicted from quantiles of the grades of its known words, calibrated on graded texts by multinomial
logistic regression. Words, counts and quantiles cover all texts; only the calibration uses a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leesmaat.llm import langid
from leesmaat.llm.common import BROADCAST_ROWS, bounded_rows, cut, latest, spread, table, words_column

LEVELS = 4
LEAST_CHARACTERS = 400
QUANTILES = [round(0.1 * i, 1) for i in range(1, 10)]
SAMPLE = 5_000  # texts the calibration is fitted on, graded ones first
LEAST_TEXTS = 3  # graded texts a known word stands in
SMOOTHING = 0.5
SHARPNESS = 0.5  # a known word has this share of its distribution on one level; "de" tells nothing
UNKNOWN = 2.5  # grade of a text without known words
EDITOR, SENTENCES = 1.0, 0.5  # weights of the two kinds of grade
CALIBRATION_WEAK = 0.2


def grades(requests: DataFrame, editors: DataFrame, sentences: DataFrame) -> DataFrame:
    """request_id, level, weight of every graded text: the editors' (rounded mean where several), else its sentences'.

    Sentence levels outside 1 to 4 and null ones are left out; a re-delivered sentence counts once."""
    ours = F.col("difficulty_level").between(1, LEVELS)
    e = editors.filter(ours).groupBy("request_id").agg(F.round(F.avg("difficulty_level")).cast("int").alias("editor"))
    once = latest(sentences.select("request_id", "sentence_index", "difficulty_level", "ingested_at"), ["request_id", "sentence_index"], "ingested_at")
    s = once.filter(ours).groupBy("request_id").agg(F.round(F.avg("difficulty_level")).cast("int").alias("sentence"))
    both = requests.select("request_id").join(e, "request_id", "left").join(s, "request_id", "left")
    return both.select("request_id", F.coalesce("editor", "sentence").alias("level"), F.when(F.col("editor").isNotNull(), EDITOR).otherwise(SENTENCES).alias("weight")).filter(F.col("level").isNotNull())


def word_grades(words: DataFrame, graded: DataFrame) -> DataFrame:
    """word, grade of every known word. words: request_id, word, n."""
    seen = words.join(graded, "request_id")
    counts = seen.groupBy("word").agg(F.sum("weight").alias("texts"), *[F.sum(F.when(F.col("level") == i, F.col("weight")).otherwise(0.0)).alias(f"n{i}") for i in range(1, LEVELS + 1)])
    totals = graded.agg(*[F.coalesce(F.sum(F.when(F.col("level") == i, F.col("weight"))), F.lit(0.0)).alias(f"t{i}") for i in range(1, LEVELS + 1)]).first()
    rate = [(F.col(f"n{i}") + SMOOTHING) / F.lit(float(totals[f"t{i}"]) + LEVELS * SMOOTHING) for i in range(1, LEVELS + 1)]
    whole = sum(rate[1:], rate[0])
    shares = counts.filter(F.col("texts") >= LEAST_TEXTS * SENTENCES).select("word", *[(r / whole).alias(f"p{i}") for i, r in enumerate(rate, 1)])
    mean = sum((F.col(f"p{i}") * i for i in range(2, LEVELS + 1)), F.col("p1"))
    return shares.filter(F.greatest(*[f"p{i}" for i in range(1, LEVELS + 1)]) >= SHARPNESS).select("word", F.round(mean, 3).alias("grade"))


def text_quantiles(words: DataFrame, known: DataFrame) -> DataFrame:
    """request_id, q: quantiles of the grades of the known words of each text that has any."""
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hits = words.join(F.broadcast(known) if small else known, "word").groupBy("request_id", "grade").agg(F.sum("n").alias("n"))
    return hits.groupBy("request_id").agg(F.percentile("grade", F.array(*[F.lit(q) for q in QUANTILES]), F.col("n")).alias("q"))


def calibrate(rows: list[tuple[list[float], int, float]]) -> np.ndarray:
    """Coefficients (quantiles + 1 by levels) of weighted multinomial logistic regression; without rows, the median decides."""
    if not rows:
        out = np.zeros((len(QUANTILES) + 1, LEVELS))
        for i in range(LEVELS):  # -(m - level)^2 without its common part
            out[len(QUANTILES) // 2, i], out[-1, i] = 2 * (i + 1), -((i + 1) ** 2)
        return out
    x = np.array([r[0] for r in rows])
    y = np.eye(LEVELS)[np.array([r[1] for r in rows]) - 1]
    w = np.array([r[2] for r in rows])[:, None]
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    b = np.zeros((z.shape[1], LEVELS))
    for _ in range(600):
        s = z @ b
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        b -= 0.5 * (z.T @ ((p - y) * w) / w.sum() + 1e-3 * b)
    out = np.vstack([b[:-1] / scale[:, None], b[-1:] - (mean / scale) @ b[:-1]])
    return out


def predict(q: Column, coefficients: np.ndarray) -> Column:
    """The level with the highest score, the lower one of equals."""
    scores = [sum((q[i] * F.lit(float(coefficients[i, k])) for i in range(len(QUANTILES))), F.lit(float(coefficients[-1, k]))) for k in range(LEVELS)]
    every = F.array(*scores)
    return F.array_position(every, F.array_max(every)).cast("int")


def dutch(texts: DataFrame, key: str, text: str, model: langid.Model) -> DataFrame:
    """key of the rows whose text is Dutch."""
    held = texts.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("key", pa.int64())])

    def pick(batches):
        for b in batches:
            keep = pa.array([held.value.language(t) == "nl" for t in b.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep)], schema=schema)

    return spread(texts.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).mapInArrow(pick, "key bigint").withColumnRenamed("key", key)


def levels(requests: DataFrame, editors: DataFrame, sentences: DataFrame, model: langid.Model) -> DataFrame:
    """request_id, difficulty_level of every Dutch text of at least LEAST_CHARACTERS characters.

    requests: request_id, text, one row each; null, short and foreign texts get none. A text without known words gets the
    level of the grade UNKNOWN."""
    long = cut(requests.filter(F.length("text") >= LEAST_CHARACTERS), "requests")
    ours = cut(dutch(long, "request_id", "text", model), "dutch")
    texts = long.join(ours, "request_id", "left_semi")
    words = cut(texts.select("request_id", F.explode(words_column(F.col("text"))).alias("word")).groupBy("request_id", "word").agg(F.count("*").alias("n")), "words")
    graded = cut(grades(ours, editors, sentences), "grades")
    known = cut(word_grades(words, graded), "known")
    q = text_quantiles(words, known)
    q = cut(ours.join(q, "request_id", "left").withColumn("q", F.coalesce("q", F.array(*[F.lit(UNKNOWN)] * len(QUANTILES)))), "quantiles")
    sample = q.join(graded, "request_id").orderBy(F.col("weight").desc(), F.xxhash64("request_id")).limit(SAMPLE)
    rows = [(list(r["q"]), r["level"], 1.0 if r["weight"] == EDITOR else CALIBRATION_WEAK) for r in bounded_rows(sample, SAMPLE, "the sample")]
    return q.select("request_id", predict(F.col("q"), calibrate(rows)).alias("difficulty_level"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = latest(table(spark, sf_dir, "analyze_requests").select("request_id", "text", "ingested_at"), ["request_id"], "ingested_at").select("request_id", "text")
    model = langid.train(table(spark, sf_dir, "documents"), "lang", "text", "doc_id")
    return levels(requests, table(spark, sf_dir, "reading_grades"), table(spark, sf_dir, "sentence_analysis"), model)
