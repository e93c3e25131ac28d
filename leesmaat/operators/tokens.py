"""Documents to tokens. A parser may be plugged in; the derived annotation below stands in for one in tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leesmaat.functions import text as T
from leesmaat.operators import structure
from leesmaat.workspace import by_document

#: An annotator turns (doc_id, text) into the token schema: doc_id, sent_idx, i, text, lower, lemma, pos, tag, dep, head, ent_type, is_punct, is_alpha.
Annotator = Callable[[DataFrame], DataFrame]

PRONOUNS_1 = ("ik", "wij", "we", "ons")
PRONOUNS_2 = ("jij", "je", "u", "jullie")
PRONOUNS_3 = ("hij", "zij", "ze", "het", "hem", "haar", "hen")
ARTICLES = ("de", "een", "the", "a")
CONJUNCTIONS = ("en", "of", "maar", "want", "and", "or")
PREPOSITIONS = ("van", "in", "op", "met", "voor", "aan", "bij", "door", "over", "om", "na", "uit")
COPULAS = ("is", "zijn", "was", "waren")
PASSIVES = ("wordt", "worden", "werd", "werden")


def tokenize(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, i, text of every token. Documents are dealt by key before they are taken apart, so that every later step
    by document or sentence finds its rows together without moving the far larger tokens. Null texts have no tokens."""
    dealt = by_document(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull()))
    return dealt.select("doc_id", F.posexplode(T.tokens(F.col("_t"))).alias("i", "text"))


def any_of(c: Column, values: tuple[str, ...]) -> Column:
    return c.isin(*values)


def derive(tokens: DataFrame) -> DataFrame:
    """A deterministic annotation from word lists and last letters. It is no parse: it only gives every operator of the
    engine columns of the right shape, by rules that SQL can repeat. Tokens that come with sent_idx and block_idx keep them,
    and no word of another block counts as the one before."""
    low, n = F.lower("text"), F.length("text")
    by_doc = W.partitionBy("doc_id").orderBy("i")
    ends = F.col("text").isin(".", "!", "?", "…").cast("int")
    given = "sent_idx" in tokens.columns
    back = W.partitionBy("doc_id", "block_idx").orderBy("i") if given else by_doc
    place = F.col("sent_idx") if given else F.coalesce(F.sum(ends).over(by_doc.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("sent_idx")
    carried = ["block_idx"] if given else []
    t = tokens.select(
        "doc_id", *carried, "i", "text", low.alias("lower"), (~F.col("text").rlike(r"^[\p{L}\p{N}]")).alias("is_punct"), F.col("text").rlike(r"^\p{L}+$").alias("is_alpha"),
        place,
        F.coalesce(F.lag(low).over(back), F.lit("")).alias("before"),
    )
    low = F.col("lower")
    pos = (
        F.when(F.col("is_punct"), "PUNCT").when(F.col("text").rlike(r"^\p{N}"), "NUM").when(any_of(low, PRONOUNS_1 + PRONOUNS_2 + PRONOUNS_3), "PRON").when(any_of(low, ARTICLES), "DET")
        .when(any_of(low, CONJUNCTIONS), "CCONJ").when(any_of(low, PREPOSITIONS), "ADP").when(any_of(low, COPULAS + PASSIVES), "AUX")
        .when(F.col("text").rlike(r"^\p{Lu}\p{Ll}{3,}$") & (F.col("before") != "") & ~F.col("before").isin(".", "!", "?", "…"), "PROPN")
        .when(low.endswith("t") & (n >= 5), "VERB").when(low.endswith("en") & (n >= 7), "VERB").when(low.endswith("e") & (n >= 5), "ADJ").when(n >= 4, "NOUN").otherwise("ADV")
    )
    t = t.withColumn("pos", pos)
    by_sentence = W.partitionBy("doc_id", "sent_idx").orderBy("i")
    whole = by_sentence.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    is_noun, is_verb = F.col("pos").isin("NOUN", "PROPN"), F.col("pos") == "VERB"
    noun_at, verb_at = F.when(is_noun, F.col("i")), F.when(is_verb, F.col("i"))
    t = t.select(
        "*",
        F.min("i").over(whole).alias("first"),
        F.min(verb_at).over(whole).alias("verb"),
        F.max(verb_at).over(by_sentence.rowsBetween(W.unboundedPreceding, -1)).alias("last_verb"),
        F.max(noun_at).over(by_sentence.rowsBetween(W.unboundedPreceding, -1)).alias("last_noun"),
        F.min(noun_at).over(by_sentence.rowsBetween(1, W.unboundedFollowing)).alias("next_noun"),
    )
    root = F.coalesce("verb", "first")
    joined = any_of(F.col("before"), CONJUNCTIONS + (",",))
    dep = (
        F.when(F.col("pos") == "PUNCT", "punct").when(F.col("i") == root, "root").when(F.col("pos") == "DET", "det").when(F.col("pos") == "NUM", "nummod").when(F.col("pos") == "ADJ", "amod").when(F.col("pos") == "CCONJ", "cc").when(F.col("pos") == "ADP", "case")
        .when(any_of(low, COPULAS), "cop").when(F.col("pos") == "AUX", "aux:pass")
        .when(is_verb & joined & F.col("last_verb").isNotNull(), "conj").when(is_verb, F.when(n % 2 == 0, "advcl").otherwise("acl:relcl"))
        .when(is_noun & joined & F.col("last_noun").isNotNull(), "conj").when(is_noun & any_of(F.col("before"), ("door",)), "obl:agent").when((is_noun | (F.col("pos") == "PRON")) & F.col("last_verb").isNull(), "nsubj").when(is_noun & any_of(F.col("before"), PREPOSITIONS), "nmod").when(is_noun | (F.col("pos") == "PRON"), "obj").otherwise("advmod")
    )
    head = (
        F.when(F.col("dep") == "root", F.col("i"))
        .when(F.col("dep") == "conj", F.when(is_verb, F.col("last_verb")).otherwise(F.col("last_noun")))
        .when(F.col("dep").isin("det", "amod", "nummod", "case"), F.coalesce(F.col("next_noun"), root))
        .when(F.col("dep") == "nmod", F.coalesce(F.col("last_noun"), root))
        .otherwise(root)
    )
    person = F.when(any_of(low, PRONOUNS_1), "|1").when(any_of(low, PRONOUNS_2), "|2").when(low == "het", "").otherwise("|3")
    tag = (
        F.when(F.col("pos") == "PUNCT", "LET").when(F.col("pos") == "NUM", "TW|hoofd").when(F.col("pos") == "PRON", F.concat(F.lit("VNW|pers|pron"), person)).when(F.col("pos") == "DET", "LID|bep").when(F.col("pos") == "CCONJ", "VG|neven").when(F.col("pos") == "ADP", "VZ|init")
        .when((F.col("pos") == "AUX") | low.endswith("t") & is_verb, "WW|pv|tgw").when(is_verb, "WW|inf").when(F.col("pos") == "ADJ", "ADJ|prenom").when(F.col("pos") == "PROPN", "SPEC|deeleigen").when(F.col("pos") == "NOUN", "N|soort|ev").otherwise("BW")
    )
    lemma = F.when(low.endswith("en") & (n > 5), F.expr("left(lower, length(lower) - 2)")).when(low.endswith("t") & is_verb, F.expr("left(lower, length(lower) - 1)")).otherwise(low)
    entity = F.when(F.col("pos") == "PROPN", F.when(n % 3 == 0, "PERSON").when(n % 3 == 1, "GPE").otherwise("ORG"))
    t = t.withColumn("dep", dep).withColumn("head", head)
    return t.select("doc_id", *carried, "sent_idx", "i", "text", "lower", lemma.alias("lemma"), "pos", tag.alias("tag"), "dep", "head", entity.alias("ent_type"), "is_punct", "is_alpha")


def annotate_blocks(blocks: DataFrame, annotator: Annotator | None = None) -> DataFrame:
    """Tokens of the sentences of blocks. A plugged-in annotator gets doc_id, block_idx, text of the blocks that are analysed
    and returns the token schema with block_idx, sent_idx and i counted within the block and head among the latter; short
    sentences are joined and all numbers made the document's here."""
    if annotator is None:
        return derive(structure.sentence_tokens(blocks))
    t = structure.merged(annotator(structure.analysed(blocks)).withColumnRenamed("sent_idx", "seg"))
    t = structure.numbered(t.withColumn("_at", F.col("i")))
    return t.withColumn("head", (F.col("i") - F.col("_at") + F.col("head")).cast("int")).drop("_at")


def annotate(documents: DataFrame, annotator: Annotator | None = None) -> DataFrame:
    """Tokens of (doc_id, text) by a plugged-in annotator or, without one, by the derived annotation."""
    return annotator(documents) if annotator else derive(tokenize(documents))
