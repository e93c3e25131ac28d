"""Words outside the dictionary and what they may have been meant to be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leesmaat.functions import guards as G
from leesmaat.functions import text as T

LONGEST = 14  # longer words are left alone
DISTANCE = 2
COMMON = 3.0  # frequency of a common word


def unknown_words(features: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Different words that could be misspelt: content words in letters, three to LONGEST of them, not in the dictionary."""
    words = features.filter(F.col("is_content_plain") & F.col("is_alpha") & (F.length("lower") >= 3) & (F.length("lower") <= LONGEST)).select(F.col("lower").alias("word")).distinct()
    return words.join(dictionary.select("word").distinct(), "word", "left_anti")


def candidates(words: DataFrame, frequency: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """word, candidate, distance, word_count: dictionary words within the distance, joined on shared pieces; words need more letters than the distance.

    Of distance + 1 pieces of a word one survives any `distance` edits, so each word is cut into that many, and a listed
    word matches that holds a piece at a place the edits allow. No pair is compared that shares none."""
    pieces = distance + 1
    n = F.length("word")
    cut = [F.floor(n * k / pieces).cast("int") for k in range(pieces + 1)]
    keys = F.array(*[F.struct(F.lit(k).alias("part"), cut[k].alias("at"), F.substring(F.col("word"), cut[k] + 1, cut[k + 1] - cut[k]).alias("piece")) for k in range(pieces)])
    left = words.select("word", n.alias("n"), F.explode(keys).alias("x")).select("word", "n", "x.at", "x.piece").filter(F.length("piece") > 0)
    # every place the edits allow is a key of its own: a piece of one letter would else meet half the dictionary
    left = left.select("word", "n", "piece", F.explode(F.sequence(F.greatest(F.col("at") - distance, F.lit(0)), F.col("at") + distance)).alias("c_at"))
    span = F.sequence(F.lit(1), F.least(F.length("candidate"), F.lit((LONGEST + pieces) // pieces)))
    right = frequency.select(F.col("word").alias("candidate"), "word_count").filter((F.length("candidate") > 0) & (F.length("candidate") <= LONGEST + distance))
    subs = F.flatten(F.transform(span, lambda size: F.transform(F.sequence(F.lit(0), F.length("candidate") - size), lambda at: F.struct(at.alias("at"), F.substring(F.col("candidate"), at + 1, size).alias("piece")))))
    right = right.select("candidate", "word_count", F.explode(subs).alias("y")).select("candidate", "word_count", F.col("y.at").alias("c_at"), "y.piece")
    pairs = left.join(right, ["piece", "c_at"]).filter(F.abs(F.col("n") - F.length("candidate")) <= distance).select("word", "candidate", "word_count").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "candidate")).filter((F.col("distance") <= distance) & (F.col("distance") > 0))


def best_corrections(words: DataFrame, frequency: DataFrame) -> DataFrame:
    """word, candidate, distance: for each unknown word its nearest, then most frequent, plausible candidate; equals by alphabet."""
    c = candidates(words, frequency)
    ok = c.filter(G.plausible(F.col("word"), F.col("candidate"), F.lit(None).cast("double"), F.col("word_count")))
    w = W.partitionBy("word").orderBy("distance", F.col("word_count").desc(), "candidate")
    return ok.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("word", "candidate", "distance")


def correct_first(sentence, word, correction):
    """The sentence with the first occurrence of a word's letters replaced."""
    return T.replace_first(sentence, word, correction)


def reject_reason(proposals: DataFrame, frequency: DataFrame, sentences: int | str) -> DataFrame:
    """proposals (sent_idx, wrong, right, sentence) with reject_reason, null for the ones to keep.

    Reasons in order: range (no such sentence), placeholder, insertion (the correction only adds words), absent (the word
    isn't in the sentence), no_effect, both_valid (both are listed words far apart), implausible."""
    f = frequency.select(F.col("word").alias("wrong"), F.col("word_count").alias("f_wrong"))
    g = frequency.select(F.col("word").alias("right"), F.col("word_count").alias("f_right"))
    p = proposals.join(f, "wrong", "left").join(g, "right", "left")
    # a split is plausible only if every part is a common word
    parts = p.filter(G.split_of(F.col("wrong"), F.col("right"))).select("wrong", "right", F.explode(F.split("right", " ")).alias("word")).distinct()
    common = parts.join(frequency.select("word", "word_count"), "word", "left").groupBy("wrong", "right").agg(F.bool_and(F.coalesce("word_count", F.lit(0.0)) >= COMMON).alias("parts_common"))
    p = p.withColumn("is_split", G.split_of(F.col("wrong"), F.col("right"))).join(common, ["wrong", "right"], "left")
    last = F.col(sentences) if isinstance(sentences, str) else F.lit(sentences)
    reason = F.coalesce(
        F.when((F.col("sent_idx") < 0) | (F.col("sent_idx") >= last), "range"),
        F.when(F.col("right").rlike(r"[\[\]<>{}]|^\s*$"), "placeholder"),
        F.when(F.startswith("right", F.concat("wrong", F.lit(" "))) | F.col("right").endswith(F.concat(F.lit(" "), F.col("wrong"))), "insertion"),
        F.when(F.instr("sentence", F.col("wrong")) == 0, "absent"),
        F.when(F.col("wrong") == F.col("right"), "no_effect"),
        F.when(F.col("f_wrong").isNotNull() & F.col("f_right").isNotNull() & (F.levenshtein("wrong", "right") > 2), "both_valid"),
        F.when(F.col("is_split"), F.when(~F.coalesce("parts_common", F.lit(False)), "implausible")).when(~G.plausible(F.col("wrong"), F.col("right"), F.col("f_wrong"), F.col("f_right")), "implausible"),
    )
    return p.select(*proposals.columns, reason.alias("reject_reason"))
