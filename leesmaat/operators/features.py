"""Token features: lookups in word lists and predicates over the annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leesmaat import constants as K
from leesmaat.sources.lexicons import Lexicons
from leesmaat.workspace import by_document


def is_noun() -> Column:
    return F.col("pos").isin(*K.NOUNS)


def is_pronoun() -> Column:
    tag = F.col("tag")
    return F.contains(tag, F.lit("VNW")) & (F.contains(tag, F.lit("|pers|")) | F.contains(tag, F.lit("|pr|")) | F.contains(tag, F.lit("|bez|")))


def person() -> Column:
    """First digit of a pronoun's tag; null without one and for other words."""
    return F.when(is_pronoun(), F.expr("try_cast(nullif(regexp_extract(tag, '([0-9])', 1), '') as int)"))


def entity_or_situation() -> Column:
    return (F.col("dep") != "cop") & (F.col("pos").isin("NOUN", "PROPN", "VERB") | is_pronoun())


def token_features(tokens: DataFrame, lex: Lexicons) -> DataFrame:
    """tokens with frequency, class of noun, person and the Boolean features. Each list is looked up by its own form of the
    word: frequency by surface or compound head, the skip list by lemma or surface, nouns by surface, then lemma."""
    flag = F.lit(True)
    nouns, freq, skip = lex.side("nouns"), lex.side("frequency"), lex.side("skiplist")
    by_lower = nouns.select(F.col("word").alias("lower"), F.col("super_sem_type").alias("_sup"), F.col("head").alias("_head"))
    by_lemma = nouns.select(F.col("word").alias("lemma"), F.col("super_sem_type").alias("_sup_l"), F.col("sem_type").alias("_sem_l"))
    t = tokens.join(by_lower, "lower", "left").join(by_lemma, "lemma", "left")
    t = t.join(lex.side("manner").select(F.col("word").alias("lower"), flag.alias("_manner")), "lower", "left").join(lex.side("units").select(F.col("word").alias("lower"), flag.alias("_unit")), "lower", "left")
    t = t.join(skip.select(F.col("word").alias("lower"), flag.alias("_skip")), "lower", "left").join(skip.select(F.col("word").alias("lemma"), flag.alias("_skip_l")), "lemma", "left")
    t = t.withColumn("_form", F.when(is_noun(), F.coalesce("_head", "lower")).otherwise(F.col("lower")))
    t = t.join(freq.select(F.col("word").alias("_form"), F.col("word_count").alias("_f")), "_form", "left")
    content = ~F.contains("tag", F.lit("TW")) & (F.col("dep") != "cop") & (F.col("pos").isin(*K.CONTENT) | F.col("_manner").isNotNull())
    plain = content & (F.col("pos") != "PROPN")
    entity = F.when(F.col("ent_type").isin("PERSON", "GPE"), "concrete").when(F.col("ent_type") == "ORG", "abstract")
    kind = F.when(is_noun(), F.coalesce("_sup", "_sup_l", entity, F.lit("unknown"))).when(F.contains("tag", F.lit("SPEC")) & F.col("_unit").isNotNull(), "concrete")
    human = is_pronoun() & (F.col("lower") != "het") | F.startswith("tag", F.lit("VNW|onbep")) & F.col("lower").isin(*K.PERSON_PRONOUNS) | is_noun() & ((F.coalesce("ent_type", F.lit("")) == "PERSON") | (F.coalesce("_sem_l", F.lit("")) == "human"))
    return t.select(
        *tokens.columns,
        content.alias("is_content"), plain.alias("is_content_plain"),
        F.when(plain & F.col("_skip").isNull() & F.col("_skip_l").isNull(), F.coalesce("_f", F.lit(K.MISSING_FREQUENCY))).alias("frequency"),
        kind.alias("noun_class"), F.contains("tag", F.lit("WW|pv")).alias("is_finite"), (F.col("dep") == "aux:pass").alias("is_passive_aux"),
        is_pronoun().alias("is_pronoun"), person().alias("person"), human.alias("is_human"), entity_or_situation().alias("is_entity"),
        ((F.col("pos") != "ADV") & F.col("dep").isin(*K.MODIFIERS)).alias("is_modifier"), ((F.col("dep") == "conj") & F.col("pos").isin(*K.CONSTITUENTS)).alias("is_constituent"),
    )


def novelty(features: DataFrame, scope: str = "document") -> DataFrame:
    """features with `is_new`: for an entity or situation at position 50 or later, whether none of the 50 words before it has
    the same lemma or, null and null being the same, the same person. Null for other words and earlier ones.

    The last earlier entity with the same key decides, so one ordered pass per key replaces a search per word. scope
    "block" takes positions as they are within a parsed block (column block_i)."""
    features = by_document(features)  # both windows below find their rows together
    i = F.col("i") if scope == "document" else F.col("block_i")
    before = W.unboundedPreceding, -1
    entity = F.col("is_entity")
    order = lambda *k: W.partitionBy("doc_id", "is_entity", *k).orderBy("i").rowsBetween(*before)
    seen_lemma = F.max(i).over(order("lemma"))
    # among pronouns the person counts, and nulls count as equal; other words are compared by lemma, but share a null person
    seen_person = F.max(i).over(order("person"))
    last = F.when(F.col("is_pronoun"), F.greatest(seen_lemma, seen_person)).otherwise(seen_lemma)
    new = F.when(entity & (i >= K.NOVELTY_SPAN), F.coalesce(i - last > K.NOVELTY_SPAN, F.lit(True)))
    return features.withColumn("is_new", new)


def rarest(features: DataFrame, n: int, by: list[str]) -> DataFrame:
    """by, rank, i, lower, frequency of the n rarest words per sentence or document; equals by position, -1 for all."""
    r = features.filter(F.col("frequency").isNotNull()).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("frequency", "i")))
    return (r if n < 0 else r.filter(F.col("rank") <= n)).select(*by, "rank", "i", "lower", "frequency")
