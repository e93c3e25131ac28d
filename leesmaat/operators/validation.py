"""What is kept of a language model's proposals: links between sentences, lists, variants of a rewrite, inflection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leesmaat import constants as K
from leesmaat.functions import guards as G
from leesmaat.functions import text as T

# Relations that a link between sentences may mark.
STRONG_RELATIONS = ("reden", "gevolg", "tegenstelling")


def _low_words(text: Column) -> Column:
    return F.transform(T.bare_words(T.collapse(text)), F.lower)


def is_recompound(word: Column, known: Column) -> Column:
    """Whether a word is two of the known words, of two letters or more each, written together."""
    n = F.length(word)
    places = F.when(n >= 4, F.sequence(F.lit(2), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda k: F.array_contains(known, F.substring(word, F.lit(1), k)) & F.array_contains(known, F.substring(word, k + 1, n)))


def added_words(original: Column, rewrite: Column) -> Column:
    """Array of the content words of a merged sentence that neither the original has nor merging explains: words of four
    letters or more in small letters that are no connective, no rejoined verb, and not "geen" for a negation that was there."""
    old = _low_words(original)
    negated = F.array_contains(old, "niet") | F.array_contains(old, "geen")

    def new(w: Column) -> Column:
        low = F.lower(w)
        return (
            ~F.array_contains(old, low) & ~low.isin(*K.CONNECTIVES) & (F.length(w) >= 4) & w.rlike(r"^\p{L}+$") & ~w.rlike(r"^\p{Lu}") & ~is_recompound(low, old) & ~((low == "geen") & negated)
        )

    return F.filter(T.bare_words(T.collapse(rewrite)), new)


def link_failure(relation: Column, original: Column, rewrite: Column) -> Column:
    """Why a link between two sentences is turned down; null for one to keep."""
    return F.coalesce(
        F.when(~F.coalesce(F.lower(F.trim(relation)).isin(*STRONG_RELATIONS), F.lit(False)), "weak relation"),
        F.when(rewrite.isNull() | (F.trim(rewrite) == "") | F.contains(F.lower(rewrite), F.lit("niet toegepast")), "nothing proposed"),
        F.when(F.size(added_words(original, rewrite)) > 0, "adds content"),
    )


def unanchored(original: Column, items: Column) -> Column:
    """Array of list items that share no word of four letters or more with the sentence they were made from."""
    old = _low_words(original)
    return F.filter(items, lambda item: ~F.exists(T.bare_words(T.collapse(item)), lambda w: (F.length(w) >= 4) & w.rlike(r"^\p{L}+$") & F.array_contains(old, F.lower(w))))


def list_failure(original: Column, intro: Column, items: Column, least: int = K.THRESHOLDS["enumeration_items"]) -> Column:
    """Why a list is turned down; null for one to keep."""
    return F.coalesce(
        F.when(intro.isNull() | (F.trim(intro) == ""), "no introduction"),
        F.when(items.isNull() | (F.size(items) < least), "too few items"),
        F.when(F.size(unanchored(original, items)) > 0, "invented item"),
    )


def list_text(intro: Column, items: Column) -> Column:
    """A list as text; its introduction ends in a colon."""
    head = F.when(F.rtrim(intro).endswith(":"), intro).otherwise(F.concat(F.rtrim(intro), F.lit(":")))
    return F.concat_ws("\n", head, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def parse_list(content: Column) -> Column:
    """struct(intro, items, explanation) of an answer with INLEIDING, ITEM and UITLEG lines."""
    lines = F.transform(F.split(content, r"\r?\n"), F.trim)
    value = lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
    bare = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[-•*\s]+", "")), r'^["“”]+|["“”]+$', "")
    of = lambda name: F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit(name)))
    items = F.filter(F.transform(of("item:"), lambda x: bare(value(x))), lambda x: x != "")
    return F.struct(bare(value(F.try_element_at(of("inleiding:"), F.lit(-1)))).alias("intro"), items.alias("items"), value(F.try_element_at(of("uitleg:"), F.lit(-1))).alias("explanation"))


def introduced(rows: DataFrame, key: str, original: str, rewrite: str, lexicons) -> DataFrame:
    """key, word: words of a rewrite that its original hasn't and neither word list knows; of three letters or more, in letters
    only, not capitalised. The first by alphabet where there are several."""
    old = F.transform(T.bare_words(F.col(original)), F.lower)
    new = rows.select(F.col(key).alias("_backstop"), F.explode(F.filter(T.bare_words(F.col(rewrite)), lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{L}+$") & ~w.rlike(r"^\p{Lu}") & ~F.array_contains(old, F.lower(w)))).alias("word"))
    new = new.withColumn("_low", F.lower("word"))
    for known in (lexicons.frequency, lexicons.dictionary):
        new = new.join(known.select(F.col("word").alias("_low")).distinct(), "_low", "left_anti")
    return new.groupBy("_backstop").agg(F.min("word").alias("word")).withColumnRenamed("_backstop", key)


def backstop(rows: DataFrame, key: str, original: str, rewrite: str, lexicons, disagreements=None, joins: bool = False) -> DataFrame:
    """rows with `failure`, the first guard a rewrite fails, null for none: empty, marker (it says it wasn't applied), noop,
    conjunction, url, misspelling, agreement. key is unique. joins: the rewrite joins sentences, so only empty, marker,
    misspelling and agreement count. disagreements: a function from (key, text) to the keys of texts in which an adjective
    doesn't agree, such as wrong_inflection over a parser's tokens."""
    o, r = F.col(original), F.col(rewrite)
    bad = introduced(rows.filter(r.isNotNull()), key, original, rewrite, lexicons).select(F.col(key).alias("_backstop"), F.lit(True).alias("_typo"))
    j = rows.join(bad, F.col(key) == F.col("_backstop"), "left").drop("_backstop")
    if disagreements is not None:
        odd = disagreements(rows.select(F.col(key).alias("key"), r.alias("text"))).select(F.col("key").alias("_backstop")).distinct().withColumn("_odd", F.lit(True))
        j = j.join(odd, F.col(key) == F.col("_backstop"), "left").drop("_backstop")
    else:
        j = j.withColumn("_odd", F.lit(None).cast("boolean"))
    single = F.lit(not joins)
    failure = F.coalesce(
        F.when(r.isNull() | (F.trim(r) == ""), "empty"), F.when(F.contains(F.lower(r), F.lit("niet toegepast")), "marker"), F.when(single & G.is_noop(o, r), "noop"), F.when(single & G.breaks_conjunction(o, r), "conjunction"),
        F.when(single & G.alters_url(o, r), "url"), F.when(F.col("_typo"), "misspelling"), F.when(F.col("_odd"), "agreement"),
    )
    return j.withColumn("failure", failure).drop("_typo", "_odd")


def variants(answers: DataFrame) -> DataFrame:
    """job, key, label, text, primary: the rewrites of a sentence worth offering. answers: job, sentence, fields (map).

    The full rewrite (VOLLEDIG, or HERSCHRIJVING of an answer without variants) and the cautious one (BEHOUDEND) are cleaned
    and checked; equal ones count once, as the full one. The full one is primary, else the only one left."""
    get = lambda k: F.try_element_at(F.col("fields"), F.lit(k))
    both = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("full").alias("key"), F.lit("Volledig").alias("label"), T.clean_variant(F.coalesce(get("VOLLEDIG"), get("HERSCHRIJVING"))).alias("text")),
        F.struct(F.lit(1).alias("n"), F.lit("conservative").alias("key"), F.lit("Behoudend").alias("label"), T.clean_variant(get("BEHOUDEND")).alias("text")),
    )
    v = answers.select("job", "sentence", F.explode(both).alias("v")).select("job", "sentence", "v.*")
    v = v.filter(F.col("text").isNotNull() & (F.col("text") != "") & G.first_failure(F.col("sentence"), F.col("text")).isNull())
    g = v.withColumn("same", F.lower(T.collapse(F.trim("text")))).groupBy("job", "same").agg(F.min_by(F.struct("n", "key", "label", "text"), "n").alias("v"))
    every = g.groupBy("job").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    return every.select("job", F.posexplode("vs").alias("at", "v")).select("job", "v.key", "v.label", "v.text", (F.col("at") == 0).alias("primary"))


def keeps_swap(content: Column) -> Column:
    """Whether a judge's answer lets a swap of words stand: only a clear verdict against it doesn't."""
    return ~F.coalesce(content.rlike(r"(?i)OORDEEL\s*:\s*\**\s*FOUT"), F.lit(False))


def wrong_inflection(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_idx, i, pair: inflected adjectives before an indefinite singular neuter noun, which takes none.

    tokens carry tags such as ADJ|prenom|basis|met-e and N|soort|ev|basis|onz; a definite, demonstrative or possessive word on
    the noun makes the inflection right."""
    key = ["doc_id", "sent_idx"]
    has = lambda c, *parts: F.size(F.array_except(F.array(*map(F.lit, parts)), F.split(c, r"\|"))) == 0
    adj = tokens.filter((F.col("pos") == "ADJ") & (F.col("dep") == "amod") & has("tag", "prenom", "basis", "met-e") & (F.col("head") > F.col("i"))).select(*key, "i", F.col("text").alias("a"), F.col("head").alias("noun"))
    noun = tokens.filter((F.col("pos") == "NOUN") & has("tag", "ev", "onz")).select(*key, F.col("i").alias("noun"), F.col("text").alias("n"))
    definite = F.startswith("tag", F.lit("LID|bep")) | F.startswith("tag", F.lit("VNW|aanw")) | F.startswith("tag", F.lit("VNW|bez"))
    fixed = tokens.filter(F.col("dep").isin("det", "nmod:poss") & definite).select(*key, F.col("head").alias("noun"))
    return adj.join(noun, [*key, "noun"]).join(fixed, [*key, "noun"], "left_anti").select(*key, "i", F.concat_ws(" ", "a", "n").alias("pair"))
