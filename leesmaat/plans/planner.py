"""From problems to a bounded, fairly dealt list of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leesmaat import constants as K


def budget(words: Column) -> Column:
    """Jobs for a text: one for ten words, at least one and at most 25; rounded half to even."""
    return F.least(F.greatest(F.lit(1), F.bround(words / K.BUDGET_WORDS, 0).cast("int")), F.lit(K.BUDGET_MOST))


def rank_of(kind: Column) -> Column:
    out = F.lit(len(K.PRIORITY))
    for n, t in enumerate(K.PRIORITY):
        out = F.when(kind == t, n).otherwise(out)
    return out


def within_cap(df: DataFrame, position: Column, cap) -> DataFrame:
    """Rows whose position is within the cap: a number, or a column of each document's own cap; None lets all in."""
    return df if cap is None else df.filter(position <= (F.col(cap) if isinstance(cap, str) else F.lit(cap)))


def prioritise(triggers: DataFrame, cap: int | str | None) -> DataFrame:
    """The problems a document's cap admits, with pick, their position. The most pressing problem of every sentence comes
    first, then every sentence's second, and so on: two rankings, no loop."""
    inner = W.partitionBy("doc_id", "sent_idx").orderBy(rank_of(F.col("type")), "ord", F.coalesce("i", F.lit(-1)))
    deal = W.partitionBy("doc_id").orderBy("round", "sent_idx")
    t = triggers.withColumn("round", F.row_number().over(inner)).withColumn("pick", F.row_number().over(deal))
    return within_cap(t, F.col("pick"), cap)


def single_jobs(triggers: DataFrame, cap: int | str | None) -> DataFrame:
    """One job per admitted problem; items has the places of its words."""
    return prioritise(triggers, cap).select("doc_id", F.col("pick").alias("job_idx"), F.lit("single").alias("kind"), "sent_idx", F.array("type").alias("types"), F.array("word").alias("words"), F.array(F.struct("sent_idx", "i", "word")).alias("items"))


def consolidated_jobs(triggers: DataFrame, cap: int | str | None) -> DataFrame:
    """Jobs that take all sentence problems of a sentence together, then enumerations, then rare words dealt round-robin over
    the sentences and bundled by eight. Sentence jobs count as one each against the cap, words one by one."""
    key = ["doc_id", "sent_idx"]
    capped = isinstance(cap, str)
    keep = [cap] if capped else []
    level = triggers.filter(F.col("type").isin(*K.SENTENCE_LEVEL))
    types = F.transform(F.array_sort(F.collect_list(F.struct(rank_of(F.col("type")).alias("r"), "type"))), lambda x: x["type"])
    none, no_items = F.array().cast("array<string>"), F.array().cast("array<struct<sent_idx int,i int,word string>>")
    s = level.groupBy(*key, *keep).agg(types.alias("types")).select(*key, *keep, F.when(F.size("types") > 1, "consolidated").otherwise("single").alias("kind"), "types", none.alias("words"), F.lit(0).alias("stage"))
    e = triggers.filter(F.col("type") == "enumeration").select(*key, *keep, F.lit("single").alias("kind"), F.array("type").alias("types"), none.alias("words"), F.lit(1).alias("stage"))
    first = s.unionByName(e).withColumn("job_idx", F.row_number().over(W.partitionBy("doc_id").orderBy("stage", "sent_idx")))
    first = within_cap(first, F.col("job_idx"), cap)
    used = first.groupBy("doc_id").agg(F.count("*").alias("used"))
    w = triggers.filter(F.col("type") == "word_frequency").withColumn("round", F.row_number().over(W.partitionBy(*key).orderBy("i")))
    w = w.withColumn("pick", F.row_number().over(W.partitionBy("doc_id").orderBy("round", "sent_idx"))).join(used, "doc_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    w = within_cap(w, F.col("pick") + F.col("used"), cap)
    bundles = w.groupBy("doc_id", "used", F.floor((F.col("pick") - 1) / K.BUNDLE).alias("bundle")).agg(F.min_by("sent_idx", "pick").alias("sent_idx"), F.array_sort(F.collect_list(F.struct("pick", "sent_idx", "i", "word"))).alias("x"))
    word, item = F.transform("x", lambda y: y["word"]), F.transform("x", lambda y: y.dropFields("pick"))
    b = bundles.select("doc_id", (F.col("used") + F.col("bundle") + 1).cast("int").alias("job_idx"), F.lit("wordfreq_bundle").alias("kind"), "sent_idx", F.array(F.lit("word_frequency")).alias("types"), word.alias("words"), item.alias("items"))
    return first.select("doc_id", "job_idx", "kind", "sent_idx", "types", "words", no_items.alias("items")).unionByName(b)


def spelling_chunks(sentences: DataFrame) -> DataFrame:
    """doc_id, chunk, prompt: 25 numbered sentences a call. sentences: doc_id, sent_idx, sentence."""
    line = F.concat((F.col("sent_idx") + 1).cast("string"), F.lit(". "), F.col("sentence"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", line.alias("line")))), lambda x: x["line"]), "\n")
    return sentences.groupBy("doc_id", F.floor(F.col("sent_idx") / K.SPELLING_CHUNK).cast("int").alias("chunk")).agg(text.alias("prompt"))


def connective_candidates(sentences: DataFrame, paragraph: list[str]) -> DataFrame:
    """Adjacent sentences of a paragraph that could be linked: both of four words or more, no questions, the second not opened
    by a connective. sentences: doc_id, paragraph columns, sent_idx, sentence, sent_length, first_word, last_token."""
    w = W.partitionBy("doc_id", *paragraph).orderBy("sent_idx")
    nxt = {c: F.lead(c).over(w).alias(f"next_{c}") for c in ("sent_idx", "sent_length", "first_word", "last_token")}
    j = sentences.select("*", *nxt.values())
    ok = (F.col("sent_length") >= 4) & (F.col("next_sent_length") >= 4) & (F.col("last_token") != "?") & (F.col("next_last_token") != "?") & ~F.col("next_first_word").isin(*K.CONNECTIVES)
    return j.filter((F.col("next_sent_idx") == F.col("sent_idx") + 1) & ok).select("doc_id", *paragraph, "sent_idx", F.col("next_sent_idx").alias("second"))
