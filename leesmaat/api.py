"""The engine's front: documents in, tables of every stage out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leesmaat import constants
from leesmaat.operators import aggregate, blocks, compact, features, generation, structure, syntax, tokens, triggers
from leesmaat.plans import planner
from leesmaat.sources.lexicons import Lexicons
from leesmaat.workspace import by_document, cut


@dataclass
class Analysis:
    """Tables of one analysis, each made on first use and written to the shared folder where several others build on it.

    documents: doc_id BIGINT, text. format: text (structure by lines) or markdown. annotator: a parser; None derives columns.
    structured: sentences are those of blocks, and fragments that can't be scored are none; without it a document is one text."""

    documents: DataFrame
    lexicons: Lexicons
    format: str = "text"
    annotator: tokens.Annotator | None = None
    thresholds: dict | None = None
    structured: bool = True

    @cached_property
    def blocks(self) -> DataFrame:
        return blocks.from_markdown(self.documents) if self.format == "markdown" else blocks.blocks(self.documents)

    @cached_property
    def _parsed(self) -> DataFrame:
        """Annotated tokens before fragments leave."""
        found = tokens.annotate_blocks(by_document(self.blocks), self.annotator) if self.structured else tokens.annotate(self.documents, self.annotator)
        return cut(syntax.parse(found), "tokens")

    def _compact(self, rarer: float | None = None) -> DataFrame:
        """Documents with their sentences in one pass, from the texts."""
        found = tokens.annotate_blocks(by_document(self.blocks), self.annotator) if self.structured else tokens.annotate(self.documents, self.annotator)
        return compact.documents(features.token_features(found, self.lexicons), self.structured, rarer)

    @cached_property
    def _described(self) -> DataFrame:
        return cut(features.token_features(self._parsed, self.lexicons), "described")

    @cached_property
    def _summed(self) -> DataFrame:
        """Features of every sentence, fragments too."""
        return cut(aggregate.sentence_features(self._described), "summed")

    @cached_property
    def kept(self) -> DataFrame:
        """Every sentence found in blocks, with its number among the sentences, null for a fragment."""
        return cut(structure.without_fragments(structure.sentence_texts(self._parsed), self._summed), "kept")

    @cached_property
    def layout(self) -> DataFrame:
        return structure.layout(self.blocks, self.kept)

    @cached_property
    def tokens(self) -> DataFrame:
        """Annotated tokens with their structure."""
        return structure.renumbered(self._parsed, self.kept) if self.structured else self._parsed

    @cached_property
    def heads(self) -> DataFrame:
        return syntax.heads(self.tokens)

    @cached_property
    def features(self) -> DataFrame:
        found = structure.renumbered(self._described, self.kept) if self.structured else features.token_features(self._parsed, self.lexicons)
        return cut(features.novelty(found), "features")

    @cached_property
    def sentences(self) -> DataFrame:
        return structure.renumbered(self._summed, self.kept) if self.structured else cut(aggregate.sentence_features(self.features), "sentences")

    @cached_property
    def scores(self) -> DataFrame:
        """One row per document."""
        return aggregate.document_features(self.sentences)

    @cached_property
    def enumerations(self) -> DataFrame:
        """Enumerations by any of the three routes, the one with the most items for a sentence that several find."""
        every = triggers.enumeration_conj(self.tokens).unionByName(triggers.enumeration_infinitive(self.tokens).select("doc_id", "sent_idx", "items", "span")).unionByName(triggers.enumeration_commas(self.tokens))
        return every.groupBy("doc_id", "sent_idx").agg(F.max("items").alias("items"))

    def triggers(self, enumerations: bool = False) -> DataFrame:
        """Problems; enumerations only if asked for. Without them, of a structured analysis only sentences and their rare words
        are written, no tokens."""
        if enumerations or not self.structured:
            return triggers.detect(self.sentences, self.features, self.lexicons, self.thresholds, self.enumerations if enumerations else None)
        s = self._sentences_with_rare
        rare = s.select("doc_id", "sent_idx", F.explode("words").alias("w")).select("doc_id", "sent_idx", *[f"w.{c}" for c in ("i", "lower", "lemma", "pos", "frequency")])
        return triggers.detect(s, rare, self.lexicons, self.thresholds)

    @cached_property
    def _sentences_with_rare(self) -> DataFrame:
        """One row per sentence with its features and its rare words."""
        rarer = (constants.THRESHOLDS | (self.thresholds or {}))["word_frequency"]
        d = self._compact(rarer).select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.*")
        few = F.transform("words", lambda w: F.struct(*[w[c].alias(c) for c in ("i", "lower", "lemma", "pos", "frequency")]))
        return cut(d.select(*aggregate.SENTENCE, *triggers.WHOLE, few.alias("words")), "rare")

    def plan(self, cap: int | None = None, consolidate: bool = True, enumerations: bool = False) -> DataFrame:
        """Jobs within the cap; without one, each document's own budget by its length."""
        t = self.triggers(enumerations)
        if cap is None:
            t = t.join(self.scores.select("doc_id", planner.budget(F.col("words")).alias("cap")), "doc_id")
        plan = planner.consolidated_jobs if consolidate else planner.single_jobs
        return plan(t, "cap" if cap is None else cap)

    def suggestions(self, factory, **options) -> DataFrame:
        """Checked suggestions of a language model; see generation.generate."""
        return generation.generate(self, factory, **options)

    def rare_words(self, n: int, by_sentence: bool = False) -> DataFrame:
        """The n least frequent words of each document or sentence; all for a negative n."""
        return features.rarest(self.features, n, aggregate.SENTENCE if by_sentence else ["doc_id"])

    def detailed(self) -> DataFrame:
        """Sentence features with the lists of words behind them and the number of new words; one row per sentence."""
        new = self.features.filter("is_new").groupBy(*aggregate.SENTENCE).agg(F.count("*").alias("new_words"))
        return self.sentences.join(aggregate.sentence_lists(self.features), aggregate.SENTENCE, "left").join(new, aggregate.SENTENCE, "left").withColumn("new_words", F.coalesce("new_words", F.lit(0)))

    def payload(self, suggestions: DataFrame | None = None) -> DataFrame:
        """doc_id, payload: document, sentence and token features as JSON, with the suggestions if given; null values are left out."""
        word = lambda x: F.struct(x["text"].alias("text"), x["tag"].alias("tag"), x["pos"].alias("pos"), x["frequency"].alias("word_frequency"), F.when(x["dep_length"] > 0, x["dep_length"]).alias("dep_length"), x["noun_class"].alias("super_sem_type"))
        plain = ["mean_log_word_frequency", "max_sdl", "proportion_of_concrete_nouns", "content_words_per_clause"]
        d = self._compact()
        d = d.select("*", *[x.alias(c) for c, x in compact.scores().items()])
        d = aggregate.with_score(d, "mean_log_word_frequency", "mean_max_sdl", "mean_content_words_per_clause", "proportion_of_concrete_nouns")
        d = d.withColumn("sentences", F.transform("sentences", lambda s: F.struct(s["sent_idx"].alias("sent_idx"), F.transform(s["words"], word).alias("word_features"), s["score"].alias("lint_score"), s["level"].alias("difficulty_level"), *[s[c].alias(c) for c in plain])))
        extra = []
        if suggestions is not None:
            each = F.struct(*[c for c in suggestions.columns if c != "doc_id"])
            g = suggestions.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_idx", "id", each.alias("s")))).alias("_s"))
            d = d.join(g, "doc_id", "left").withColumn("suggestions", F.transform(F.coalesce("_s", F.array().cast(g.schema["_s"].dataType)), lambda x: x["s"]))
            extra = ["suggestions"]
        return d.select("doc_id", F.to_json(F.struct("sentences", *extra, F.col("score").alias("document_score"), F.col("level").alias("document_level"), "sentence_count", "min_score", "max_score"), {"ignoreNullFields": "true"}).alias("payload"))


class Readability:
    """Entry point: Readability(lexicons).analyze(documents)."""

    def __init__(self, lexicons: Lexicons, annotator: tokens.Annotator | None = None, thresholds: dict | None = None):
        self.lexicons, self.annotator, self.thresholds = lexicons, annotator, thresholds

    def analyze(self, documents: DataFrame, key: str = "doc_id", text: str = "text", format: str = "text", unwrap: bool | None = None, structure: bool = True) -> Analysis:
        """documents with any other columns; null texts take no part. unwrap rejoins hard-wrapped lines first; left open, plain
        text with structure is. structure False takes a document as one text, as if it had no headings, lists or lines."""
        d = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
        if unwrap or unwrap is None and structure and format == "text":
            d = cut(blocks.unwrap(d, self.lexicons.dictionary), "unwrapped")
        return Analysis(d, self.lexicons, format, self.annotator, self.thresholds, structure)
