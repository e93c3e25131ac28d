"""Features of sentences and documents: one grouped pass each, over partial sums that merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leesmaat import constants as K
from leesmaat.functions import score as S

SENTENCE = ["doc_id", "sent_idx"]


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


STEP = float(1 << 40)


def steady(c: Column) -> Column:
    """A number without what is below 2^-40, so that sums under 8,000 are exact and don't depend on the order of the rows."""
    return F.floor(c * F.lit(STEP)) / F.lit(STEP)


def opens_subordinate() -> Column:
    """Whether a token opens a subordinate clause: its chain's base has such a label and its subtree holds a verb."""
    return F.col("base_dep").isin(*K.SUBORDINATE) & (F.col("subtree_verbs") > 0)


def ordered(value: str, where: Column) -> Column:
    """Values of the rows that meet a condition, in text order."""
    return F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("i", value)))), lambda x: x[value])


def sentence_features(tokens: DataFrame) -> DataFrame:
    """One row per sentence. tokens: token features with dep_length. Empty groups give null means, not zeros."""
    word = ~F.col("is_punct")
    kinds = {k: count_if(F.col("noun_class") == k).alias(k) for k in ("concrete", "abstract", "undefined", "unknown")}
    a = tokens.groupBy(*SENTENCE).agg(
        count_if(word).alias("sent_length"),
        F.sum(steady(F.col("frequency"))).alias("freq_sum"),
        F.count("frequency").alias("freq_count"),
        F.max(F.when(word, F.col("dep_length"))).alias("_sdl"),
        *kinds.values(),
        count_if(F.col("is_content")).alias("content_words"),
        count_if(F.col("is_finite")).alias("finite_verbs"),
        F.bool_or("is_passive_aux").alias("has_passive"),
        count_if(F.col("is_constituent")).alias("constituents"),
        count_if(F.col("is_modifier")).alias("modifiers"),
        count_if(F.col("is_human")).alias("humans"),
        count_if(F.col("dep") == "obl:agent").alias("agents"),
        count_if(F.col("is_alpha")).alias("alpha_words"),
        count_if(opens_subordinate()).alias("subordinate_clauses"),
        # conjuncts in a modifier's subtree count again
        F.coalesce(F.sum(F.when(F.col("is_modifier"), F.col("subtree_conj"))), F.lit(0)).alias("_inner"),
    )
    a = a.select("*", *[x.alias(c) for c, x in sentence_means(F.col).items()]).drop("_sdl", "_inner")
    return with_score(a, "mean_log_word_frequency", "max_sdl", "content_words_per_clause", "proportion_of_concrete_nouns")


def sentence_means(c: Callable[[str], Column]) -> dict[str, Column]:
    """The means of a sentence by its sums, wherever c finds them."""
    clauses = F.greatest(c("finite_verbs"), F.lit(1))
    classed = c("concrete") + c("abstract") + c("undefined")
    return {
        "mean_log_word_frequency": c("freq_sum") / F.nullif(c("freq_count"), F.lit(0)),
        "max_sdl": F.when(c("sent_length") >= 2, c("_sdl")),
        "content_words_per_clause": c("content_words") / clauses,
        "proportion_of_concrete_nouns": F.when(classed > 0, c("concrete") / classed),
        "mean_clause_length": c("sent_length") / clauses,
        "constituents_per_clause": c("constituents") / clauses,
        "modifiers_per_clause": (c("modifiers") + c("_inner")) / clauses,
    }


def with_score(df: DataFrame, frequency: str, sdl: str, cwpc: str, concrete: str) -> DataFrame:
    return df.withColumn("score", S.difficulty(F.col(frequency), F.col(sdl), F.col(cwpc), F.col(concrete))).withColumn("level", S.level(F.col("score")))


def document_features(sentences: DataFrame) -> DataFrame:
    """One row per document: pooled word frequency and noun share, means of the sentences' other two features."""
    classed = F.sum("concrete") + F.sum("abstract") + F.sum("undefined")
    d = sentences.groupBy("doc_id").agg(
        F.count("*").alias("sentence_count"),
        F.expr("sum(freq_sum) / nullif(sum(freq_count), 0)").alias("mean_log_word_frequency"),
        F.avg("max_sdl").alias("mean_max_sdl"),
        F.avg(steady(F.col("content_words_per_clause"))).alias("mean_content_words_per_clause"),
        F.when(classed > 0, F.sum("concrete") / classed).alias("proportion_of_concrete_nouns"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.sum("sent_length").alias("words"),
    )
    return with_score(d, "mean_log_word_frequency", "mean_max_sdl", "mean_content_words_per_clause", "proportion_of_concrete_nouns")


def sentence_lists(tokens: DataFrame) -> DataFrame:
    """The word lists of a sentence: nouns by class, content words, finite verbs, humans, pronouns by person, in text order."""
    lists = {f"{k}_nouns": F.col("noun_class") == k for k in ("concrete", "abstract", "undefined", "unknown")}
    lists |= {"content": F.col("is_content"), "finite": F.col("is_finite"), "human": F.col("is_human")}
    lists |= {f"pronouns_{p}": F.col("person") == p for p in (1, 2, 3)}
    return tokens.groupBy(*SENTENCE).agg(*[ordered("lower", c).alias(k) for k, c in lists.items()])


def passive_spans(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_idx, i, first, last, span: the words from a passive auxiliary to its heads, whichever way they lie."""
    aux = tokens.filter("is_passive_aux").select(*SENTENCE, "i", F.least(F.array_min("heads"), "i").alias("first"), F.greatest(F.array_max("heads"), "i").alias("last"))
    inner = tokens.select(*SENTENCE, F.col("i").alias("at"), "text").join(aux, SENTENCE).filter(F.col("at").between(F.col("first"), F.col("last")))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ")
    return inner.groupBy(*SENTENCE, "i", "first", "last").agg(words.alias("span"))
