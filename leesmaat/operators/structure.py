"""Blocks to sentences: only prose and list items are analysed, no sentence reaches over a block, short ones join the next,
and fragments that can't be scored leave the sentences and become headings of the layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leesmaat.functions import text as T

ANALYSED = ("prose", "list_item")
SHORT = 2  # words of a sentence that joins the next one
FINAL = (".", "!", "?")  # marks behind which even a short sentence stands alone
BLOCK = ["doc_id", "block_idx"]


def analysed(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, text of the blocks that have sentences; headings, quotations and blanks are layout only."""
    return blocks.filter(F.col("type").isin(*ANALYSED)).select("doc_id", F.col("block_idx").cast("int").alias("block_idx"), "text")


def block_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, i, text: the tokens of every analysed block, i counted within it."""
    return analysed(blocks).select(*BLOCK, F.posexplode(T.tokens(F.col("text"))).alias("i", "text"))


def segmented(tokens: DataFrame) -> DataFrame:
    """Tokens of blocks with seg, their sentence within the block: it ends behind . ! ? or an ellipsis."""
    ends = F.col("text").isin(*FINAL, "…").cast("int")
    before = W.partitionBy(*BLOCK).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    return tokens.withColumn("seg", F.coalesce(F.sum(ends).over(before), F.lit(0)).cast("int"))


def merged(tokens: DataFrame) -> DataFrame:
    """The same with seg as joined: a sentence of at most SHORT words that no final mark ends joins the next one of its block.
    A sentence that was joined doesn't join on, so of a run of short ones each second opens none: its place in the run tells."""
    one, block = W.partitionBy(*BLOCK, "seg"), W.partitionBy(*BLOCK)
    word = F.col("text").rlike(r"^[\p{L}\p{N}]").cast("int")
    t = tokens.withColumn("_words", F.sum(word).over(one)).withColumn("_last", F.max(F.struct("i", "text")).over(one)["text"]).withColumn("_end", F.max("seg").over(block))
    t = t.withColumn("_short", (F.col("_words") <= SHORT) & ~F.col("_last").isin(*FINAL) & (F.col("seg") < F.col("_end")))
    upto = block.orderBy("seg").rangeBetween(W.unboundedPreceding, W.currentRow)
    run = F.col("seg") - F.coalesce(F.max(F.when(~F.col("_short"), F.col("seg"))).over(upto), F.lit(-1))
    t = t.withColumn("_opens", (F.col("_short") & (run % 2 == 1)).cast("int"))
    joins = F.max("_opens").over(block.orderBy("seg").rangeBetween(-1, -1)) == 1
    t = t.withColumn("seg", F.when(joins, F.col("seg") - 1).otherwise(F.col("seg")))
    return t.drop("_words", "_last", "_end", "_short", "_opens")


def numbered(tokens: DataFrame) -> DataFrame:
    """Tokens with sent_idx and i counted over the document; a block's own numbers give way."""
    w = W.partitionBy("doc_id")
    t = tokens.withColumn("sent_idx", (F.dense_rank().over(w.orderBy("block_idx", "seg")) - 1).cast("int"))
    t = t.withColumn("at", F.col("i"))
    return t.withColumn("i", (F.row_number().over(w.orderBy("block_idx", "at")) - 1).cast("int")).drop("seg", "at")


def sentence_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, sent_idx, i, text of every token of every sentence."""
    return numbered(merged(segmented(block_tokens(blocks))))


def sentence_texts(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_idx, block_idx, sentence: the sentences' tokens with a blank between each."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
    return tokens.groupBy("doc_id", "sent_idx").agg(F.min("block_idx").alias("block_idx"), F.array_join(words, " ").alias("sentence"))


def without_fragments(texts: DataFrame, sentences: DataFrame) -> DataFrame:
    """doc_id, sent_idx, block_idx, sentence, new_idx: the sentences with the number they have once fragments are out; null for
    a fragment, that is a sentence without level that is_fragment holds of."""
    level = sentences.select("doc_id", "sent_idx", "level")
    s = texts.join(level, ["doc_id", "sent_idx"], "left").withColumn("_out", F.col("level").isNull() & T.is_fragment(F.col("sentence"))).drop("level")
    n = F.sum((~F.col("_out")).cast("int")).over(W.partitionBy("doc_id").orderBy("sent_idx"))
    return s.withColumn("new_idx", F.when(~F.col("_out"), n - 1).cast("int")).drop("_out")


def renumbered(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows with doc_id and sent_idx, those of fragments left out and the others by their new number."""
    m = kept.filter(F.col("new_idx").isNotNull()).select("doc_id", "sent_idx", "new_idx")
    return rows.join(m, ["doc_id", "sent_idx"]).withColumn("sent_idx", F.col("new_idx")).drop("new_idx").select(*rows.columns)


def layout(blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, block_idx, part, type, text, ordered, number, sentences: what a document shows, in order.

    A prose block gives a row per sentence (sentence, or heading for a fragment), a list item one row with the numbers of its
    sentences (or a heading if all are fragments); a list item's fragments beside others leave it. Other blocks stay."""
    cols = [F.col(c) if c in blocks.columns else F.lit(None).cast(t).alias(c) for c, t in (("ordered", "boolean"), ("number", "int"))]
    b = blocks.select("doc_id", F.col("block_idx").cast("int").alias("block_idx"), "type", "text", *cols)
    none = F.lit(None).cast("array<int>")
    other = b.filter(~F.col("type").isin(*ANALYSED)).select("doc_id", "block_idx", F.lit(0).alias("part"), "type", "text", "ordered", "number", none.alias("sentences"))
    place = (F.row_number().over(W.partitionBy(*BLOCK).orderBy("sent_idx")) - 1).cast("int")
    s = kept.select("doc_id", "block_idx", "sent_idx", "sentence", "new_idx").join(b.select(*BLOCK, "type", "ordered", "number"), BLOCK).withColumn("part", place)
    lost = F.col("new_idx").isNull()
    prose = s.filter("type = 'prose'").select("doc_id", "block_idx", "part", F.when(lost, "heading").otherwise("sentence").alias("type"), F.col("sentence").alias("text"), "ordered", "number", F.when(~lost, F.array("new_idx")).alias("sentences"))
    joined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(x, F.struct("sent_idx", "sentence")))), lambda y: y["sentence"]), " ")
    items = s.filter("type = 'list_item'").groupBy(*BLOCK).agg(F.first("ordered").alias("ordered"), F.first("number").alias("number"), F.array_sort(F.collect_list("new_idx")).alias("sentences"), joined(~lost).alias("kept"), joined(F.lit(True)).alias("every"))
    gone = F.size("sentences") == 0
    items = items.select("doc_id", "block_idx", F.lit(0).alias("part"), F.when(gone, "heading").otherwise("list_item").alias("type"), F.when(gone, F.col("every")).otherwise(F.col("kept")).alias("text"), "ordered", "number", F.when(~gone, F.col("sentences")).alias("sentences"))
    return other.unionByName(prose).unionByName(items)


def paragraphs(shown: DataFrame) -> DataFrame:
    """doc_id, sent_idx, paragraph: maximal runs of sentences in the layout with nothing between them."""
    w = W.partitionBy("doc_id").orderBy("block_idx", "part")
    t = shown.withColumn("paragraph", F.sum((F.col("type") != "sentence").cast("int")).over(w))
    return t.filter("type = 'sentence'").select("doc_id", F.element_at("sentences", 1).alias("sent_idx"), F.col("paragraph").cast("int").alias("paragraph"))


def closing(c: Column) -> Column:
    """Whether a token is a mark that attaches to the word before it."""
    return c.rlike(r"^[.,;:!?…)\]”’»%]+$")
