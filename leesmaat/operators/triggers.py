"""Detectors of readability problems: one row per problem, in a fixed order within the sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leesmaat import constants as K
from leesmaat.operators.aggregate import SENTENCE
from leesmaat.sources.lexicons import Lexicons

TYPES = ("word_frequency", "max_sdl", "content_words_per_clause", "abstract_nouns", "passive", "subordinate_clause", "sentence_length", "enumeration")
#: what problems of whole sentences are told by
WHOLE = ["sent_length", "max_sdl", "alpha_words", "content_words_per_clause", "proportion_of_concrete_nouns", "abstract", "has_passive", "agents", "subordinate_clauses"]
COLUMNS = ["doc_id", "sent_idx", "ord", "type", "i", "word", "value", "threshold"]


def candidate_stems():
    """Array of a word's family members: lemma, verb without particle, noun without diminutive, adjective without ending."""
    lemma, low = F.col("lemma"), F.col("lower")

    def without_end(c, ends, least):
        return [F.when(c.endswith(e) & (F.length(c) - len(e) >= least), F.substring(c, F.lit(1), F.length(c) - len(e))) for e in ends]

    verb = [F.when(lemma.startswith(p) & (F.length(lemma) - len(p) >= 4), F.substring(lemma, F.lit(len(p) + 1), F.length(lemma))) for p in K.PARTICLES]
    return F.array_compact(
        F.when(F.col("pos") == "VERB", F.array(lemma, *verb))
        .when(F.col("pos") == "NOUN", F.array(lemma, *without_end(lemma, K.DIMINUTIVES, 3), *without_end(low, K.DIMINUTIVES, 3)))
        .when(F.col("pos") == "ADJ", F.array(lemma, *without_end(lemma, K.ADJECTIVE_ENDINGS, 3), *without_end(low, K.ADJECTIVE_ENDINGS, 3)))
        .otherwise(F.array(lemma))
    )


def family_frequency(words: DataFrame, lex: Lexicons) -> DataFrame:
    """lower, lemma, pos, family: the highest frequency within a word's family, null if the list has none of it.
    words: any token rows; each different (lower, lemma, pos) is looked up once."""
    distinct = words.select("lower", "lemma", "pos").distinct()
    stems = distinct.select("*", F.explode(candidate_stems()).alias("stem"))
    freq = lex.side("frequency").select(F.col("word").alias("stem"), "word_count")
    return distinct.join(stems.join(freq, "stem").groupBy("lower", "lemma", "pos").agg(F.max("word_count").alias("family")), ["lower", "lemma", "pos"], "left")


def rare_words(features: DataFrame, lex: Lexicons, threshold: float = K.THRESHOLDS["word_frequency"]) -> DataFrame:
    """Rare words whose family isn't common."""
    rare = features.filter(F.col("frequency") < threshold)
    family = family_frequency(rare, lex)
    return rare.join(family, ["lower", "lemma", "pos"], "left").filter(F.col("family").isNull() | (F.col("family") < threshold))


def detect(sentences: DataFrame, features: DataFrame, lex: Lexicons, thresholds: dict | None = None, enumerations: DataFrame | None = None) -> DataFrame:
    """doc_id, sent_idx, ord, type, i, word, value, threshold of every problem. sentences: features with subordinate_clauses."""
    th = K.THRESHOLDS | (thresholds or {})
    null_i, null_w = F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("word")

    def whole(kind: str, where, value, threshold) -> DataFrame:
        return sentences.filter(where).select(*SENTENCE, F.lit(TYPES.index(kind)).alias("ord"), F.lit(kind).alias("type"), null_i, null_w, value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"))

    words = rare_words(features, lex, th["word_frequency"]).select(*SENTENCE, F.lit(0).alias("ord"), F.lit("word_frequency").alias("type"), "i", F.col("lower").alias("word"), F.col("frequency").alias("value"), F.lit(float(th["word_frequency"])).alias("threshold"))
    parts = [
        words,
        whole("max_sdl", (F.col("max_sdl") > th["max_sdl"]) & (F.col("alpha_words") >= th["max_sdl_words"]), F.col("max_sdl"), th["max_sdl"]),
        whole("content_words_per_clause", F.col("content_words_per_clause") > th["content_words_per_clause"], F.col("content_words_per_clause"), th["content_words_per_clause"]),
        whole("abstract_nouns", (F.col("proportion_of_concrete_nouns") < 1 - th["abstract_share"]) & (F.col("abstract") >= th["abstract_nouns"]), F.col("proportion_of_concrete_nouns"), 1 - th["abstract_share"]),
        whole("passive", F.col("has_passive") & (F.col("agents") > 0), F.lit(1.0), 1),
        whole("subordinate_clause", F.col("subordinate_clauses") > th["subordinate_clauses"], F.col("subordinate_clauses"), th["subordinate_clauses"]),
        whole("sentence_length", F.col("sent_length") > th["sentence_length"], F.col("sent_length"), th["sentence_length"]),
    ]
    if enumerations is not None:
        parts.append(enumerations.select(*SENTENCE, F.lit(7).alias("ord"), F.lit("enumeration").alias("type"), null_i, null_w, F.col("items").cast("double").alias("value"), F.lit(float(th["enumeration_items"])).alias("threshold")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*COLUMNS)


def enumeration_conj(based: DataFrame, items: int = K.THRESHOLDS["enumeration_items"], span: int = K.THRESHOLDS["enumeration_span"]) -> DataFrame:
    """Enumerations as groups of conjuncts: the group with the most members of each sentence that has enough of them over
    enough words, none of them a finite verb; equals by position."""
    g = based.groupBy(*SENTENCE, "base").agg(
        F.count("*").alias("items"), (F.max("i") - F.min("i") + 1).alias("span"), F.bool_or(finite()).alias("finite")
    )
    best = W.partitionBy(*SENTENCE).orderBy(F.col("items").desc(), "base")
    return g.filter((F.col("items") >= items) & (F.col("span") >= span) & ~F.col("finite")).withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*SENTENCE, "items", "span")


def finite():
    """A finite verb."""
    return F.col("pos").isin("VERB", "AUX") & F.contains("tag", F.lit("WW|pv"))


def enumeration_infinitive(tokens: DataFrame, items: int = K.THRESHOLDS["enumeration_items"], span: int = K.THRESHOLDS["enumeration_span"]) -> DataFrame:
    """Enumerations of nominalised infinitives: "het [modifier] INFINITIVE van", twice at least; a noun in -en counts as one."""
    w = W.partitionBy(*SENTENCE).orderBy("i")
    noun = (F.col("pos") == "VERB") & F.startswith("tag", F.lit("WW|inf")) | (F.col("pos") == "NOUN") & F.col("lower").endswith("en")
    between = F.col("pos").isin("ADJ", "ADV") | (F.col("pos") == "VERB") & F.col("tag").rlike(r"^WW\|[vo]d")
    t = tokens.withColumn("_n", noun).withColumn("_m", ~noun & between).withColumn("_v", F.col("lower") == "van")
    nxt = lambda c, k: F.coalesce(F.lead(c, k).over(w), F.lit(False))
    t = t.withColumn("_at", F.when(nxt("_n", 1) & nxt("_v", 2), F.col("i") + 1).when(nxt("_m", 1) & nxt("_n", 2) & nxt("_v", 3), F.col("i") + 2))
    g = t.filter((F.col("lower") == "het") & F.col("_at").isNotNull()).groupBy(*SENTENCE).agg(F.count("*").alias("items"), (F.max("_at") - F.min("i") + 1).alias("span"))
    return g.filter((F.col("items") >= 2) & (F.col("items") >= items) & (F.col("span") >= span))


def enumeration_commas(tokens: DataFrame, items: int = K.THRESHOLDS["enumeration_items"], span: int = K.THRESHOLDS["enumeration_span"]) -> DataFrame:
    """Enumerations by commas: the parts after the first comma, the last one split at its last "en" or "of", hold no finite
    verb. The part before the first comma counts as one; the span runs from that comma to the last word."""
    whole = W.partitionBy(*SENTENCE)
    comma = F.col("text") == ","
    t = tokens.withColumn("_first", F.min(F.when(comma, F.col("i"))).over(whole)).withColumn("_last", F.max(F.when(comma, F.col("i"))).over(whole))
    t = t.filter(F.col("i") > F.col("_first")).withColumn("_turn", F.max(F.when((F.col("i") > F.col("_last")) & F.col("lower").isin(*K.LIST_COORDINATORS), F.col("i"))).over(whole))
    part = F.sum(comma.cast("int")).over(whole.orderBy("i")) + (F.col("i") > F.col("_turn")).cast("int")
    words = t.filter(F.col("_turn").isNotNull()).withColumn("_part", part).filter(~F.col("is_punct") & (F.col("i") != F.col("_turn")))
    g = words.groupBy(*SENTENCE).agg((F.countDistinct("_part") + 1).alias("items"), (F.max("i") - F.min("_first") + 1).alias("span"), F.bool_or(finite()).alias("_f"))
    return g.filter(~F.col("_f") & (F.col("items") >= items) & (F.col("span") >= span)).select(*SENTENCE, "items", "span")
