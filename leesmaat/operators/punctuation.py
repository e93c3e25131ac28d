"""Marks that stand against a word, for showing sentences token by token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPENING = ("(", "[", "{")


def attach(tokens: DataFrame) -> DataFrame:
    """tokens with leading, trailing and standalone marks, null where there are none.

    tokens: doc_id, block_idx, i, text, is_punct, space_after. Marks without a blank between them and a word belong to it; an
    opening bracket that touches the word behind it belongs to that one alone. A mark with blanks on both sides stands alone."""
    w = W.partitionBy("doc_id", "block_idx").orderBy("i")
    t = tokens.withColumn("_glued", F.coalesce(~F.lag("space_after").over(w), F.lit(False)))  # to the token before
    t = t.withColumn("_next_glued", F.coalesce(F.lead("_glued").over(w), F.lit(False))).withColumn("_next_word", F.coalesce(~F.lead("is_punct").over(w), F.lit(False)))
    # a run is a stretch of glued tokens; an opening bracket that touches a word starts one of its own
    opens = F.col("text").isin(*OPENING) & F.col("_next_glued") & F.col("_next_word")
    starts = (~F.col("_glued")) | opens
    t = t.withColumn("_opens", opens).withColumn("_run", F.sum(starts.cast("int")).over(w))
    run = W.partitionBy("doc_id", "block_idx", "_run").orderBy("i")
    t = t.withColumn("_word", F.sum((~F.col("is_punct")).cast("int")).over(run))  # words of the run up to here
    marks = t.filter("is_punct").groupBy("doc_id", "block_idx", "_run", "_word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("_marks"))
    words = t.filter(~F.col("is_punct"))
    key = ["doc_id", "block_idx", "_run"]
    lead = marks.select(*key, (F.col("_word") + 1).alias("_word"), F.col("_marks").alias("leading"))
    trail = marks.select(*key, "_word", F.col("_marks").alias("trailing"))
    w1 = words.join(lead, [*key, "_word"], "left").join(trail, [*key, "_word"], "left").withColumn("standalone", F.lit(None).cast("string"))
    alone = ~F.col("_glued") & ~F.col("_next_glued")
    p = t.filter("is_punct").withColumn("leading", F.lit(None).cast("string")).withColumn("trailing", F.lit(None).cast("string")).withColumn("standalone", F.when(alone, F.col("text")))
    cols = [*tokens.columns, "leading", "trailing", "standalone"]
    return w1.select(*cols).unionByName(p.select(*cols))
