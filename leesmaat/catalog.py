"""Registry of the engine's queries over a folder of tables, each with its SQL twin where SQL can express it on whole tables.

Queries over parsed text use the derived annotation and derived word lists, which SQL can repeat. They share the stages of
one analysis per session and folder, as the stages of a pipeline do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leesmaat import constants as K
from leesmaat import sql as Q
from leesmaat.api import Analysis, Readability
from leesmaat.functions import guards as G
from leesmaat.functions import score as S
from leesmaat.functions import text as T
from leesmaat.operators import aggregate, blocks, editing, editor, features, generation, rewrite, spelling, stats, structure, syntax, triggers, validation
from leesmaat.plans import planner
from leesmaat.sources import eval_items, lexicons, results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ROUTES: dict[str, str] = {}  # selects without the parts they name
_analyses: dict[tuple[str, str], Analysis] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _analyses:
        lex = lexicons.derived(table(spark, sf_dir, "word_freq"))
        _analyses[key] = Readability(lex).analyze(table(spark, sf_dir, "documents"), structure=False)
    return _analyses[key]


def by_blocks(spark: SparkSession, sf_dir: str) -> Analysis:
    """The same with documents taken as blocks, hard-wrapped lines rejoined first."""
    key = (spark.sparkContext.applicationId, f"blocks of {sf_dir}")
    if key not in _analyses:
        lex = lexicons.derived(table(spark, sf_dir, "word_freq"))
        _analyses[key] = Readability(lex).analyze(table(spark, sf_dir, "documents"))
    return _analyses[key]


def forget() -> None:
    """Let go of the analyses that queries share, so that the next ones read their tables again."""
    _analyses.clear()


def query(name: str, sql: str | None = None, parts: dict[str, str] | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ROUTES[name] = sql
            SQL[name] = Q.steady(Q.sql(sql, parts))
        return f

    return register


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Floating columns rounded for comparison: sums in another order differ in the last digits. The small addend decides ties."""
    return df.withColumns({c: F.round(F.col(c).cast("double") + Q.TIE, 6) for c in columns})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_document_score"](spark, sf_dir)


# --- structure ------------------------------------------------------------------------------------------------------


@query("q_sentence_like", "SELECT doc_id, n, type <> 'heading' AND type <> 'blank' AS sentence_like FROM kinds WHERE line <> ''")
def _(spark, d):
    t = blocks.lines(table(spark, d, "documents")).filter("line <> ''")
    return t.select("doc_id", "n", T.ends_like_sentence(F.col("line")).alias("sentence_like"))


@query(
    "q_blocks",
    """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS block_idx, type, line AS text FROM (
       SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY n) AS last, max(CASE WHEN type <> 'blank' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead,
         min(CASE WHEN type <> 'blank' THEN n END) OVER (PARTITION BY doc_id) AS first FROM kinds)
       WHERE (type <> 'blank' OR (last <> 'blank' AND ahead IS NOT NULL)) AND n >= first""",
)
def _(spark, d):
    return blocks.blocks(table(spark, d, "documents"))


@query(
    "q_unwrap_gate",
    """SELECT doc_id, joinable, suspicious, joinable >= 3 AND suspicious >= greatest(2, 0.4 * joinable) AS hard_wrapped FROM (
       SELECT doc_id, count(*) FILTER (line <> '' AND nxt <> '') AS joinable, count(*) FILTER (line <> '' AND nxt <> '' AND type = 'heading') AS suspicious
       FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS nxt FROM kinds) GROUP BY doc_id)""",
)
def _(spark, d):
    return blocks.wrapping(table(spark, d, "documents"))


@query(
    "q_unwrapped",
    """WITH g AS (SELECT doc_id FROM (SELECT doc_id, count(*) FILTER (line <> '' AND nxt <> '') AS j, count(*) FILTER (line <> '' AND nxt <> '' AND type = 'heading') AS s FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS nxt FROM kinds) GROUP BY doc_id) WHERE j >= 3 AND s >= greatest(2, 0.4 * j)),
       e AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS para FROM kinds WHERE doc_id IN (SELECT doc_id FROM g)),
       j AS (SELECT *, CASE WHEN regexp_extract(line, '(\\p{L}+)-$', 1) <> '' AND regexp_extract(coalesce(nxt, ''), '^(\\p{Ll}\\p{L}*)', 1) <> '' THEN lower(regexp_extract(line, '(\\p{L}+)-$', 1) || regexp_extract(nxt, '^(\\p{Ll}\\p{L}*)', 1)) END AS joined FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id, para ORDER BY n) AS nxt FROM e WHERE line <> '')),
       p AS (SELECT doc_id, min(n) AS n, trim(string_agg(CASE WHEN w.word IS NOT NULL THEN left(line, length(line) - 1) WHEN joined IS NOT NULL THEN line ELSE line || ' ' END, '' ORDER BY n), ' ') AS p FROM j LEFT JOIN word_freq w ON w.word = j.joined GROUP BY doc_id, para
         UNION ALL SELECT doc_id, n, line FROM e WHERE line = '')
       SELECT doc_id, coalesce(u.text, docs.text) AS text FROM docs LEFT JOIN (SELECT doc_id, string_agg(p, chr(10) ORDER BY n) AS text FROM p GROUP BY doc_id) u USING (doc_id)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    return blocks.unwrap(docs, table(spark, d, "word_freq"))


@query("q_markdown_blocks")
def _(spark, d):
    return blocks.from_markdown(table(spark, d, "documents").filter("format = 'markdown'"))


@query("q_quotes_and_space", f"SELECT doc_id, regexp_replace(translate(text, '{K.QUOTES}', repeat('\"', {len(K.QUOTES)})), '{T.SPACE}', ' ', 'g') AS text FROM docs")
def _(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.collapse(T.straight_quotes(F.col("text"))).alias("text"))


@query(
    "q_html_text",
    r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), ' ') AS text
       FROM docs WHERE regexp_matches(text, '<[a-z]+[^>]*>')""",
)
def _(spark, d):
    return table(spark, d, "documents").filter(F.col("text").rlike("<[a-z]+[^>]*>")).select("doc_id", blocks.strip_html(F.col("text")).alias("text"))


@query("q_fragments", r"SELECT doc_id, n, len(regexp_extract_all(line, '\p{L}+')) <= 3 OR regexp_matches(line, ':\s*$') AS fragment FROM lines WHERE line <> ''")
def _(spark, d):
    return blocks.lines(table(spark, d, "documents")).filter("line <> ''").select("doc_id", "n", T.is_fragment(F.col("line")).alias("fragment"))


# --- tokens and lexicons --------------------------------------------------------------------------------------------

TOKEN_COLUMNS = ["doc_id", "sent_idx", "i", "text", "lower", "lemma", "pos", "tag", "dep", "head", "ent_type", "is_punct", "is_alpha"]


@query("q_tokens", f"SELECT {', '.join(TOKEN_COLUMNS)} FROM tok")
def _(spark, d):
    return analysis(spark, d).tokens.select(*TOKEN_COLUMNS)


@query("q_token_stats", "SELECT doc_id, count(*) AS tokens, count(*) FILTER (NOT is_punct) AS words, count(DISTINCT sent_idx) AS sentences, count(DISTINCT lower) AS vocabulary FROM tok GROUP BY doc_id")
def _(spark, d):
    n = F.count(F.when(~F.col("is_punct"), 1))
    return analysis(spark, d).tokens.groupBy("doc_id").agg(F.count("*").alias("tokens"), n.alias("words"), F.countDistinct("sent_idx").alias("sentences"), F.countDistinct("lower").alias("vocabulary"))


@query("q_corpus_lexicon", "SELECT lower AS word, round(log10(count(*) / (SELECT count(*) FROM tok WHERE is_alpha)::DOUBLE * 1e9), 6) AS word_count FROM tok WHERE is_alpha GROUP BY lower")
def _(spark, d):
    return r6(lexicons.from_corpus(analysis(spark, d).tokens.filter("is_alpha").select(F.col("lower").alias("word"))), "word_count")


@query("q_word_frequency", "SELECT doc_id, i, lower, round(frequency, 6) AS frequency FROM f2 WHERE frequency IS NOT NULL")
def _(spark, d):
    return r6(analysis(spark, d).features.filter("frequency is not null").select("doc_id", "i", "lower", "frequency"), "frequency")


@query("q_noun_class", "SELECT doc_id, i, lower, noun_class FROM f2 WHERE noun_class IS NOT NULL")
def _(spark, d):
    return analysis(spark, d).features.filter("noun_class is not null").select("doc_id", "i", "lower", "noun_class")


@query("q_content_words", "SELECT doc_id, i, lower, is_content_plain FROM f2 WHERE is_content")
def _(spark, d):
    return analysis(spark, d).features.filter("is_content").select("doc_id", "i", "lower", "is_content_plain")


@query("q_pronoun_person", "SELECT doc_id, i, lower, person FROM f2 WHERE is_pronoun")
def _(spark, d):
    return analysis(spark, d).features.filter("is_pronoun").select("doc_id", "i", "lower", "person")


@query("q_human", "SELECT doc_id, i, lower FROM f2 WHERE is_human")
def _(spark, d):
    return analysis(spark, d).features.filter("is_human").select("doc_id", "i", "lower")


@query(
    "q_token_flags",
    "SELECT doc_id, sent_idx, count(*) FILTER (is_finite) AS finite, count(*) FILTER (is_passive_aux) AS passive, count(*) FILTER (is_entity) AS entities, count(*) FILTER (is_modifier) AS modifiers, count(*) FILTER (is_constituent) AS constituents FROM f2 GROUP BY doc_id, sent_idx",
)
def _(spark, d):
    n = aggregate.count_if
    return analysis(spark, d).features.groupBy("doc_id", "sent_idx").agg(n(F.col("is_finite")).alias("finite"), n(F.col("is_passive_aux")).alias("passive"), n(F.col("is_entity")).alias("entities"), n(F.col("is_modifier")).alias("modifiers"), n(F.col("is_constituent")).alias("constituents"))


# --- syntax ---------------------------------------------------------------------------------------------------------


@query("q_conj_base", "SELECT doc_id, sent_idx, i, base FROM based WHERE dep = 'conj'")
def _(spark, d):
    return analysis(spark, d).tokens.filter("dep = 'conj'").select("doc_id", "sent_idx", "i", "base")


@query("q_heads", "SELECT doc_id, sent_idx, i, head FROM hd")
def _(spark, d):
    return analysis(spark, d).heads.select("doc_id", "sent_idx", "i", "head")


@query("q_dep_length", "SELECT doc_id, sent_idx, i, dep_length FROM dl")
def _(spark, d):
    return analysis(spark, d).tokens.select("doc_id", "sent_idx", "i", "dep_length")


@query("q_subtree_size", "SELECT doc_id, sent_idx, anc, count(*) AS size FROM up GROUP BY doc_id, sent_idx, anc")
def _(spark, d):
    return analysis(spark, d).tokens.select("doc_id", "sent_idx", F.col("i").alias("anc"), F.col("subtree_size").alias("size"))


@query("q_subordinate", "SELECT doc_id, sent_idx, i FROM sub")
def _(spark, d):
    return analysis(spark, d).tokens.filter(aggregate.opens_subordinate()).select("doc_id", "sent_idx", "i")


@query(
    "q_passive_spans",
    """SELECT a.doc_id, a.sent_idx, a.i, a.first, a.last, string_agg(t.text, ' ' ORDER BY t.i) AS span FROM (
       SELECT h.doc_id, h.sent_idx, h.i, least(min(h.head), h.i) AS first, greatest(max(h.head), h.i) AS last FROM hd h JOIN tok k ON k.doc_id = h.doc_id AND k.i = h.i AND k.dep = 'aux:pass' GROUP BY 1, 2, 3) a
       JOIN tok t ON t.doc_id = a.doc_id AND t.sent_idx = a.sent_idx AND t.i BETWEEN a.first AND a.last GROUP BY 1, 2, 3, 4, 5""",
)
def _(spark, d):
    return aggregate.passive_spans(analysis(spark, d).features)


@query("q_subordinate_texts", "SELECT s.doc_id, s.sent_idx, s.i, string_agg(t.text, ' ' ORDER BY t.i) AS span FROM sub s JOIN up u ON u.doc_id = s.doc_id AND u.anc = s.i JOIN tok t ON t.doc_id = u.doc_id AND t.i = u.i GROUP BY 1, 2, 3")
def _(spark, d):
    return syntax.subtree_texts(analysis(spark, d).tokens, aggregate.opens_subordinate())


@query("q_modifier_texts", "SELECT s.doc_id, s.sent_idx, s.i, string_agg(t.text, ' ' ORDER BY t.i) AS span FROM f2 s JOIN up u ON u.doc_id = s.doc_id AND u.anc = s.i JOIN tok t ON t.doc_id = u.doc_id AND t.i = u.i WHERE s.is_modifier GROUP BY 1, 2, 3")
def _(spark, d):
    return syntax.subtree_texts(analysis(spark, d).features, F.col("is_modifier"))


# --- sentences and documents ----------------------------------------------------------------------------------------

SENTENCE_INTS = "doc_id, sent_idx, sent_length, concrete, abstract, undefined, unknown, content_words, finite_verbs, has_passive, humans, subordinate_clauses"
SENTENCE_FLOATS = ["mean_log_word_frequency", "max_sdl", "content_words_per_clause", "proportion_of_concrete_nouns", "mean_clause_length", "constituents_per_clause", "modifiers_per_clause"]


def rounded(columns: list[str]) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns)


@query("q_sentence_features", f"SELECT {SENTENCE_INTS}, {rounded(SENTENCE_FLOATS)} FROM sent")
def _(spark, d):
    return r6(analysis(spark, d).sentences.select(*SENTENCE_INTS.split(", "), *SENTENCE_FLOATS), *SENTENCE_FLOATS)


@query("q_sentence_score", "SELECT doc_id, sent_idx, round(score, 6) AS score, level FROM sent")
def _(spark, d):
    return r6(analysis(spark, d).sentences.select("doc_id", "sent_idx", "score", "level"), "score")


DOC_FLOATS = ["mean_log_word_frequency", "mean_max_sdl", "mean_content_words_per_clause", "proportion_of_concrete_nouns", "min_score", "max_score", "score"]


@query("q_document_score", f"SELECT doc_id, sentence_count, CAST(words AS BIGINT) AS words, {rounded(DOC_FLOATS)}, level FROM doc")
def _(spark, d):
    return r6(analysis(spark, d).scores.select("doc_id", "sentence_count", "words", *DOC_FLOATS, "level"), *DOC_FLOATS)


@query("q_readers", "SELECT level, count(*) AS documents, max(CASE level WHEN 1 THEN 14 WHEN 2 THEN 29 WHEN 3 THEN 53 WHEN 4 THEN 78 END) AS struggling FROM doc GROUP BY level")
def _(spark, d):
    return analysis(spark, d).scores.groupBy("level").agg(F.count("*").alias("documents"), F.max(S.readers_struggling(F.col("level"))).alias("struggling"))


@query(
    "q_sentence_lists",
    "SELECT doc_id, sent_idx, "
    + ", ".join(f"coalesce(string_agg(lower, ' ' ORDER BY i) FILTER ({c}), '') AS {n}" for n, c in {"concrete_nouns": "noun_class = 'concrete'", "content": "is_content", "finite": "is_finite", "human": "is_human", "pronouns_1": "person = 1", "pronouns_3": "person = 3"}.items())
    + " FROM f2 GROUP BY doc_id, sent_idx",
)
def _(spark, d):
    lists = aggregate.sentence_lists(analysis(spark, d).features)
    return lists.select("doc_id", "sent_idx", *[F.array_join(c, " ").alias(c) for c in ("concrete_nouns", "content", "finite", "human", "pronouns_1", "pronouns_3")])


@query("q_rare_words_sentence", "SELECT doc_id, sent_idx, rank, i, lower, round(frequency, 6) AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY frequency, i) AS rank FROM f2 WHERE frequency IS NOT NULL) WHERE rank <= 5")
def _(spark, d):
    return r6(features.rarest(analysis(spark, d).features, 5, ["doc_id", "sent_idx"]), "frequency")


@query("q_rare_words_document", "SELECT doc_id, rank, i, lower, round(frequency, 6) AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency, i) AS rank FROM f2 WHERE frequency IS NOT NULL) WHERE rank <= 5")
def _(spark, d):
    return r6(features.rarest(analysis(spark, d).features, 5, ["doc_id"]), "frequency")


@query(
    "q_novel_words",
    """SELECT doc_id, i, lower, coalesce(i - greatest(by_lemma, CASE WHEN is_pronoun THEN by_person END) > 50, true) AS is_new FROM (
       SELECT *, max(i) OVER (PARTITION BY doc_id, lemma ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS by_lemma, max(i) OVER (PARTITION BY doc_id, person ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS by_person FROM f2 WHERE is_entity) WHERE i >= 50""",
)
def _(spark, d):
    return analysis(spark, d).features.filter("is_new is not null").select("doc_id", "i", "lower", "is_new")


@query("q_payload")
def _(spark, d):
    return analysis(spark, d).payload()


@query("q_detailed", "SELECT doc_id, sent_idx, sent_length, finite_verbs, humans, has_passive, round(score, 6) AS score, level, coalesce(n, 0) AS new_words FROM sent LEFT JOIN (SELECT doc_id, sent_idx, count(*) AS n FROM (SELECT *, max(i) OVER (PARTITION BY doc_id, lemma ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, max(i) OVER (PARTITION BY doc_id, person ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f2 WHERE is_entity) WHERE i >= 50 AND coalesce(i - greatest(a, CASE WHEN is_pronoun THEN b END) > 50, true) GROUP BY 1, 2) USING (doc_id, sent_idx)")
def _(spark, d):
    a = analysis(spark, d)
    new = a.features.filter("is_new").groupBy("doc_id", "sent_idx").agg(F.count("*").alias("new_words"))
    s = a.sentences.select("doc_id", "sent_idx", "sent_length", "finite_verbs", "humans", "has_passive", "score", "level").join(new, ["doc_id", "sent_idx"], "left")
    return r6(s.withColumn("new_words", F.coalesce("new_words", F.lit(0))), "score")


# --- detectors and plans --------------------------------------------------------------------------------------------


@query("q_triggers", "SELECT doc_id, sent_idx, ord, type, i, word, round(value, 6) AS value, round(threshold, 6) AS threshold FROM trig")
def _(spark, d):
    return r6(analysis(spark, d).triggers(), "value", "threshold")


@query("q_family_frequency", "SELECT lower, lemma, pos, round(family, 6) AS family FROM family")
def _(spark, d):
    a = analysis(spark, d)
    return r6(triggers.family_frequency(a.features.filter(F.col("frequency") < K.THRESHOLDS["word_frequency"]), a.lexicons), "family")


@query(
    "q_enumeration_conj",
    """SELECT doc_id, sent_idx, items, span FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY items DESC, base) AS r FROM (
       SELECT doc_id, sent_idx, base, count(*) AS items, max(i) - min(i) + 1 AS span, bool_or(pos IN ('VERB', 'AUX') AND contains(tag, 'WW|pv')) AS finite FROM based GROUP BY 1, 2, 3) WHERE items >= 2 AND span >= 3 AND NOT finite) WHERE r = 1""",
)
def _(spark, d):
    return triggers.enumeration_conj(analysis(spark, d).tokens, items=2, span=3)


@query(
    "q_enumeration_infinitive",
    """SELECT doc_id, sent_idx, count(*) AS items, max(spot) - min(i) + 1 AS span FROM (
       SELECT *, CASE WHEN lead(n, 1) OVER w AND lead(v, 2) OVER w THEN i + 1 WHEN lead(m, 1) OVER w AND lead(n, 2) OVER w AND lead(v, 3) OVER w THEN i + 2 END AS spot FROM (
         SELECT *, (pos = 'VERB' AND prefix(tag, 'WW|inf')) OR (pos = 'NOUN' AND suffix(lower, 'en')) AS n, NOT ((pos = 'VERB' AND prefix(tag, 'WW|inf')) OR (pos = 'NOUN' AND suffix(lower, 'en'))) AND (pos IN ('ADJ', 'ADV') OR (pos = 'VERB' AND regexp_matches(tag, '^WW\\|[vo]d'))) AS m, lower = 'van' AS v FROM tok)
       WINDOW w AS (PARTITION BY doc_id, sent_idx ORDER BY i)) WHERE lower = 'het' AND spot IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def _(spark, d):
    return triggers.enumeration_infinitive(analysis(spark, d).tokens, items=2, span=1)


@query(
    "q_enumeration_commas",
    """SELECT doc_id, sent_idx, count(DISTINCT part) + 1 AS items, max(i) - min(f) + 1 AS span FROM (
         SELECT *, sum(CASE WHEN text = ',' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_idx ORDER BY i) + CASE WHEN i > turn THEN 1 ELSE 0 END AS part FROM (
           SELECT *, max(CASE WHEN i > l AND lower IN ('en', 'of') THEN i END) OVER (PARTITION BY doc_id, sent_idx) AS turn FROM (
             SELECT *, min(CASE WHEN text = ',' THEN i END) OVER (PARTITION BY doc_id, sent_idx) AS f, max(CASE WHEN text = ',' THEN i END) OVER (PARTITION BY doc_id, sent_idx) AS l FROM tok) WHERE i > f))
       WHERE turn IS NOT NULL AND NOT is_punct AND i <> turn GROUP BY 1, 2 HAVING NOT bool_or(pos IN ('VERB', 'AUX') AND contains(tag, 'WW|pv')) AND count(DISTINCT part) + 1 >= 2 AND max(i) - min(f) + 1 >= 3""",
)
def _(spark, d):
    return triggers.enumeration_commas(analysis(spark, d).tokens, items=2, span=3)


LONG_ENOUGH = f"items >= {K.THRESHOLDS['enumeration_items']} AND span >= {K.THRESHOLDS['enumeration_span']}"
WIDE = {"items >= 2 AND span >= 3": LONG_ENOUGH, "HAVING count(*) >= 2": f"HAVING count(*) >= {K.THRESHOLDS['enumeration_items']} AND max(spot) - min(i) + 1 >= {K.THRESHOLDS['enumeration_span']}", "count(DISTINCT part) + 1 >= 2 AND max(i) - min(f) + 1 >= 3": f"count(DISTINCT part) + 1 >= {K.THRESHOLDS['enumeration_items']} AND max(i) - min(f) + 1 >= {K.THRESHOLDS['enumeration_span']}"}


def at_defaults(name: str) -> str:
    """The select of an enumeration query at the detectors' own thresholds."""
    text = ROUTES[name]
    for old, new in WIDE.items():
        text = text.replace(old, new)
    return text


@query("q_enumerations", "SELECT doc_id, sent_idx, max(items) AS items FROM (" + " UNION ALL ".join(f"SELECT doc_id, sent_idx, items FROM ({at_defaults(n)})" for n in ("q_enumeration_conj", "q_enumeration_infinitive", "q_enumeration_commas")) + ") GROUP BY 1, 2")
def _(spark, d):
    return analysis(spark, d).enumerations.select("doc_id", "sent_idx", "items")


@query("q_round_robin_plan", "SELECT doc_id, sent_idx, type, i, round, pick FROM dealt WHERE pick <= 10")
def _(spark, d):
    return planner.prioritise(analysis(spark, d).triggers(), 10).select("doc_id", "sent_idx", "type", "i", "round", "pick")


PLAN_PARTS = """
WITH lv AS (SELECT doc_id, sent_idx, CASE WHEN count(*) > 1 THEN 'consolidated' ELSE 'single' END AS kind, string_agg(type, ',' ORDER BY {rank}) AS types, '' AS words FROM {trig} WHERE type IN {types} GROUP BY 1, 2),
fj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) AS job_idx FROM lv) WHERE job_idx <= 12),
us AS (SELECT doc_id, count(*) AS used FROM fj GROUP BY 1),
wd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rnd, sent_idx) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY i) AS rnd FROM {trig} WHERE type = 'word_frequency')),
wk AS (SELECT wd.*, coalesce(used, 0) AS used FROM wd LEFT JOIN us USING (doc_id) WHERE pick + coalesce(used, 0) <= 12)
SELECT doc_id, CAST(job_idx AS INTEGER) AS job_idx, kind, sent_idx, types, words FROM fj
UNION ALL SELECT doc_id, CAST(used + (pick - 1) // 8 + 1 AS INTEGER), 'wordfreq_bundle', arg_min(sent_idx, pick), 'word_frequency', string_agg(word, ',' ORDER BY pick) FROM wk GROUP BY doc_id, used, (pick - 1) // 8"""


@query("q_consolidated_plan", "SELECT * FROM (" + PLAN_PARTS.format(rank=Q.priority("type"), types=Q.names(K.SENTENCE_LEVEL), trig="trig") + ")")
def _(spark, d):
    j = planner.consolidated_jobs(analysis(spark, d).triggers(), 12)
    return j.select("doc_id", "job_idx", "kind", "sent_idx", F.array_join("types", ",").alias("types"), F.array_join("words", ",").alias("words"))


@query("q_budget", "SELECT doc_id, CAST(least(greatest(1, round_even(words / 10, 0)), 25) AS INTEGER) AS budget FROM doc")
def _(spark, d):
    return analysis(spark, d).scores.select("doc_id", planner.budget(F.col("words")).alias("budget"))


def sentence_texts(a: Analysis) -> DataFrame:
    words = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
    return a.tokens.groupBy("doc_id", "sent_idx").agg(F.array_join(words, " ").alias("sentence"))


@query(
    "q_spelling_chunks",
    "SELECT doc_id, CAST(sent_idx // 25 AS INTEGER) AS chunk, string_agg((sent_idx + 1) || '. ' || sentence, chr(10) ORDER BY sent_idx) AS prompt FROM (SELECT doc_id, sent_idx, string_agg(text, ' ' ORDER BY i) AS sentence FROM tok GROUP BY 1, 2) GROUP BY 1, 2",
)
def _(spark, d):
    return planner.spelling_chunks(sentence_texts(analysis(spark, d)))


@query(
    "q_connective_candidates",
    f"""SELECT doc_id, sent_idx, second FROM (SELECT *, lead(sent_idx) OVER w AS second, lead(n) OVER w AS n2, lead(first_word) OVER w AS f2w, lead(last_token) OVER w AS l2 FROM (
        SELECT doc_id, sent_idx, count(*) FILTER (NOT is_punct) AS n, arg_min(lower, i) AS first_word, arg_max(lower, i) AS last_token FROM tok GROUP BY 1, 2) WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx))
        WHERE second = sent_idx + 1 AND n >= 4 AND n2 >= 4 AND last_token <> '?' AND l2 <> '?' AND f2w NOT IN {Q.names(K.CONNECTIVES)}""",
)
def _(spark, d):
    t = analysis(spark, d).tokens.groupBy("doc_id", "sent_idx").agg(aggregate.count_if(~F.col("is_punct")).alias("sent_length"), F.min_by("lower", "i").alias("first_word"), F.max_by("lower", "i").alias("last_token"))
    return planner.connective_candidates(t, []).select("doc_id", "sent_idx", "second")


# --- spelling and guards --------------------------------------------------------------------------------------------


@query("q_unknown_words", "SELECT DISTINCT lower AS word FROM f2 WHERE is_content_plain AND is_alpha AND length(lower) BETWEEN 3 AND 14 AND lower NOT IN (SELECT word FROM word_freq)")
def _(spark, d):
    a = analysis(spark, d)
    return spelling.unknown_words(a.features, a.lexicons.dictionary)


# DuckDB's distance counts bytes, so letters with accents are given one-byte names first.
ACCENTS = "áàäâãåéèëêíìïîóòöôõúùüûçñß"
ONE_BYTE = "translate({0}, '" + ACCENTS + "', '" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[: len(ACCENTS)] + "')"
FAR = f"levenshtein({ONE_BYTE.format('u.word')}, {ONE_BYTE.format('w.word')})"
NEAR = f"SELECT u.word, w.word AS candidate, CAST({FAR} AS INTEGER) AS distance, w.word_count FROM (SELECT DISTINCT lower AS word FROM f2 WHERE is_content_plain AND is_alpha AND length(lower) BETWEEN 3 AND 14 AND lower NOT IN (SELECT word FROM word_freq)) u JOIN word_freq w ON abs(length(u.word) - length(w.word)) <= 2 AND {FAR} BETWEEN 1 AND 2"


@query("q_spelling_candidates", f"SELECT word, candidate, distance FROM ({NEAR})")
def _(spark, d):
    a = analysis(spark, d)
    return spelling.candidates(spelling.unknown_words(a.features, a.lexicons.dictionary), a.lexicons.frequency).select("word", "candidate", F.col("distance").cast("int").alias("distance"))


PREFIX = "coalesce(list_max([k FOR k IN range(0, least(length({a}), length({b})) + 1) IF left({a}, k) = left({b}, k)]), 0)"


@query(
    "q_best_corrections",
    f"SELECT word, candidate, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, word_count DESC, candidate) AS r FROM (SELECT *, {PREFIX.format(a='word', b='candidate')} AS p FROM ({NEAR})) WHERE p >= greatest(3, least(length(word), length(candidate)) - 2) OR (length(word) <= 4 AND length(candidate) <= 4) OR word_count > {K.MISSING_FREQUENCY}) WHERE r = 1",
)
def _(spark, d):
    a = analysis(spark, d)
    return spelling.best_corrections(spelling.unknown_words(a.features, a.lexicons.dictionary), a.lexicons.frequency).select("word", "candidate", F.col("distance").cast("int").alias("distance"))


SWAPS = "(SELECT DISTINCT suggestion_id, lower(word) AS word, lower(replacement_word) AS replacement FROM suggestions WHERE word IS NOT NULL AND replacement_word IS NOT NULL)"


def swaps(spark, d) -> DataFrame:
    s = table(spark, d, "suggestions").filter("word is not null and replacement_word is not null")
    return s.select("suggestion_id", F.lower("word").alias("word"), F.lower("replacement_word").alias("replacement")).distinct()


@query("q_same_family", f"SELECT suggestion_id, word, replacement, p >= 5 AND length(word) - p <= 3 AND length(replacement) - p <= 3 AS same_family FROM (SELECT *, {PREFIX.format(a='word', b='replacement')} AS p FROM {SWAPS})")
def _(spark, d):
    return swaps(spark, d).select("*", G.same_family(F.col("word"), F.col("replacement")).alias("same_family"))


@query("q_frequency_band", f"SELECT s.suggestion_id, s.word, s.replacement, round_even(coalesce(r.word_count, {K.MISSING_FREQUENCY}), 0) > round_even(coalesce(w.word_count, {K.MISSING_FREQUENCY}), 0) AS higher FROM {SWAPS} s LEFT JOIN word_freq w ON w.word = s.word LEFT JOIN word_freq r ON r.word = s.replacement")
def _(spark, d):
    f = table(spark, d, "word_freq")
    w, r = f.select("word", F.col("word_count").alias("fw")), f.select(F.col("word").alias("replacement"), F.col("word_count").alias("fr"))
    miss = F.lit(K.MISSING_FREQUENCY)
    return swaps(spark, d).join(w, "word", "left").join(r, "replacement", "left").select("suggestion_id", "word", "replacement", G.higher_band(F.coalesce("fr", miss), F.coalesce("fw", miss)).alias("higher"))


PAIRS_SQL = "(SELECT DISTINCT suggestion_id, original_text AS o, suggested_text AS r FROM suggestions WHERE original_text IS NOT NULL)"
TRIMMED = "regexp_replace(lower(trim(regexp_replace({0}, '" + T.SPACE + r"', ' ', 'g'), ' ')), '[\s.!?…\"'']+$', '')"
NOOP = f"{TRIMMED.format('o')} = {TRIMMED.format('r')}"
URLS = "[regexp_replace(u, '[.,;:!?)\\]]+$', '') FOR u IN regexp_extract_all(o, '" + T.URL.replace("'", "''") + "')]"
URL_LOST = f"len([u FOR u IN {URLS} IF NOT contains(r, u)]) > 0"
CONJ_LOST = " OR ".join(f"(contains(lower(o), ', {w} ') AND NOT contains(lower(r), ', {w} '))" for w in K.CLAUSE_CONJUNCTIONS)


def pairs(spark, d) -> DataFrame:
    return table(spark, d, "suggestions").filter("original_text is not null").select("suggestion_id", F.col("original_text").alias("o"), F.col("suggested_text").alias("r")).distinct()


@query("q_noop", f"SELECT suggestion_id, {NOOP} AS noop FROM {PAIRS_SQL} WHERE r IS NOT NULL")
def _(spark, d):
    return pairs(spark, d).filter("r is not null").select("suggestion_id", G.is_noop(F.col("o"), F.col("r")).alias("noop"))


@query("q_url_preserved", f"SELECT suggestion_id, NOT ({URL_LOST}) AS kept FROM {PAIRS_SQL} WHERE r IS NOT NULL")
def _(spark, d):
    return pairs(spark, d).filter("r is not null").select("suggestion_id", (~G.alters_url(F.col("o"), F.col("r"))).alias("kept"))


@query("q_clause_conj", f"SELECT suggestion_id, {CONJ_LOST} AS broken FROM {PAIRS_SQL} WHERE r IS NOT NULL")
def _(spark, d):
    return pairs(spark, d).filter("r is not null").select("suggestion_id", G.breaks_conjunction(F.col("o"), F.col("r")).alias("broken"))


@query("q_first_failure", f"SELECT suggestion_id, CASE WHEN r IS NULL OR trim(r, ' ') = '' THEN 'empty' WHEN {NOOP} THEN 'noop' WHEN {URL_LOST} THEN 'url' WHEN {CONJ_LOST} THEN 'conjunction' END AS failure FROM {PAIRS_SQL}")
def _(spark, d):
    return pairs(spark, d).select("suggestion_id", G.first_failure(F.col("o"), F.col("r")).alias("failure"))


WORDS_OF = "[x FOR x IN [regexp_replace(x, '^[^0-9A-Za-zÀ-ſ]+|[^0-9A-Za-zÀ-ſ]+$', '', 'g') FOR x IN string_split({0}, ' ')] IF x <> '']"


@query("q_new_words", f"SELECT suggestion_id, w AS word FROM (SELECT DISTINCT suggestion_id, unnest([x FOR x IN {WORDS_OF.format('r')} IF NOT list_contains([lower(y) FOR y IN {WORDS_OF.format('o')}], lower(x))]) AS w FROM {PAIRS_SQL} WHERE r IS NOT NULL) WHERE length(w) >= 3 AND regexp_matches(w, '^\\p{{L}}+$') AND NOT regexp_matches(w, '^\\p{{Lu}}') AND lower(w) NOT IN (SELECT word FROM word_freq)")
def _(spark, d):
    p = pairs(spark, d).filter("r is not null").select("suggestion_id", T.bare_words(F.col("r")).alias("n"), F.transform(T.bare_words(F.col("o")), F.lower).alias("old"))
    new = p.select("suggestion_id", F.explode(F.filter("n", lambda x: ~F.array_contains("old", F.lower(x)))).alias("word")).distinct()
    shaped = new.filter((F.length("word") >= 3) & F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").rlike(r"^\p{Lu}"))
    known = table(spark, d, "word_freq").select(F.col("word").alias("low"))
    return shaped.withColumn("low", F.lower("word")).join(known, "low", "left_anti").select("suggestion_id", "word")


@query("q_replacement_band", f"SELECT s.suggestion_id, s.word, s.replacement, CASE WHEN contains(replacement, ' ') THEN length(s.word) >= {K.COMPOUND_LEAST} ELSE NOT (p >= 5 AND length(s.word) - p <= 3 AND length(s.replacement) - p <= 3) AND round_even(coalesce(r.word_count, {K.MISSING_FREQUENCY}), 0) > round_even(coalesce(w.word_count, {K.MISSING_FREQUENCY}), 0) END AS passes FROM (SELECT *, {PREFIX.format(a='word', b='replacement')} AS p FROM {SWAPS}) s LEFT JOIN word_freq w ON w.word = s.word LEFT JOIN word_freq r ON r.word = s.replacement")
def _(spark, d):
    f = table(spark, d, "word_freq")
    w, r = f.select("word", F.col("word_count").alias("fw")), f.select(F.col("word").alias("replacement"), F.col("word_count").alias("fr"))
    return swaps(spark, d).join(w, "word", "left").join(r, "replacement", "left").select("suggestion_id", "word", "replacement", G.passes_band(F.col("word"), F.col("replacement"), F.coalesce("fw", F.lit(K.MISSING_FREQUENCY)), F.col("fr")).alias("passes"))


LINKS = "(SELECT DISTINCT suggestion_id, relation, original_text AS o, suggested_text AS r FROM suggestions WHERE type = 'connective' AND original_text IS NOT NULL)"
SPACED = "regexp_replace({0}, '" + T.SPACE + "', ' ', 'g')"
OLD = "[lower(y) FOR y IN " + WORDS_OF.format(SPACED.format("o")) + "]"
ADDED = f"""[x FOR x IN {WORDS_OF.format(SPACED.format('r'))} IF NOT list_contains({OLD}, lower(x)) AND lower(x) NOT IN {Q.names(K.CONNECTIVES)} AND length(x) >= 4 AND regexp_matches(x, '^\\p{{L}}+$') AND NOT regexp_matches(x, '^\\p{{Lu}}')
  AND len([k FOR k IN range(2, length(x) - 1) IF list_contains({OLD}, left(lower(x), k)) AND list_contains({OLD}, substr(lower(x), k + 1))]) = 0 AND NOT (lower(x) = 'geen' AND (list_contains({OLD}, 'niet') OR list_contains({OLD}, 'geen')))]"""


@query("q_link_failure", f"SELECT suggestion_id, CASE WHEN NOT coalesce(lower(trim(relation, ' ')) IN {Q.names(validation.STRONG_RELATIONS)}, false) THEN 'weak relation' WHEN r IS NULL OR trim(r, ' ') = '' OR contains(lower(r), 'niet toegepast') THEN 'nothing proposed' WHEN len({ADDED}) > 0 THEN 'adds content' END AS failure FROM {LINKS}")
def _(spark, d):
    s = table(spark, d, "suggestions").filter("type = 'connective' and original_text is not null").select("suggestion_id", "relation", "original_text", "suggested_text").distinct()
    return s.select("suggestion_id", validation.link_failure(F.col("relation"), F.col("original_text"), F.col("suggested_text")).alias("failure"))


@query(
    "q_list_failure",
    f"""SELECT suggestion_id, CASE WHEN list_intro IS NULL OR trim(list_intro, ' ') = '' THEN 'no introduction' WHEN list_items IS NULL OR len(list_items) < 3 THEN 'too few items'
       WHEN len([t FOR t IN list_items IF len([x FOR x IN {WORDS_OF.format(SPACED.format('t'))} IF length(x) >= 4 AND regexp_matches(x, '^\\p{{L}}+$') AND list_contains({OLD}, lower(x))]) = 0]) > 0 THEN 'invented item' END AS failure
       FROM (SELECT DISTINCT suggestion_id, original_text AS o, list_intro, list_items FROM suggestions WHERE type = 'enumeration' AND original_text IS NOT NULL)""",
)
def _(spark, d):
    s = table(spark, d, "suggestions").filter("type = 'enumeration' and original_text is not null").select("suggestion_id", "original_text", "list_intro", "list_items").distinct()
    return s.select("suggestion_id", validation.list_failure(F.col("original_text"), F.col("list_intro"), F.col("list_items")).alias("failure"))


@query("q_affected_words")
def _(spark, d):
    return editor.affected_words(pairs(spark, d), "suggestion_id", "o", "r")


# --- answers of models ----------------------------------------------------------------------------------------------


@query("q_without_thinking", r"SELECT DISTINCT response_id, trim(regexp_replace(content, '(?s)<think>.*?</think>', '', 'g'), ' ') AS content FROM llm_responses WHERE content IS NOT NULL")
def _(spark, d):
    return table(spark, d, "llm_responses").filter("content is not null").select("response_id", T.strip_thinking(F.col("content")).alias("content")).distinct()


@query("q_response_fields")
def _(spark, d):
    r = table(spark, d, "llm_responses").dropDuplicates(["response_id"])
    return rewrite.parsed(r, "response_id", "content").withColumn("fields", F.to_json("fields"))


@query("q_response_blocks")
def _(spark, d):
    r = table(spark, d, "llm_responses").dropDuplicates(["response_id"])
    return rewrite.parsed(r, "response_id", "content", "WOORD").withColumn("fields", F.to_json("fields"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROMPTS = f"""SELECT doc_id, sent_idx, type, i, replace(replace(CASE WHEN type = 'word_frequency' THEN {quoted(rewrite.TEMPLATES['word_frequency'])} ELSE {quoted(rewrite.TEMPLATES['sentence_rewrite'])} END, '{{issue}}',
  CASE type WHEN 'sentence_length' THEN 'de zin heeft ' || CAST(value AS INTEGER) || ' woorden' WHEN 'max_sdl' THEN 'woorden die bij elkaar horen staan ' || CAST(value AS INTEGER) || ' woorden uit elkaar' WHEN 'content_words_per_clause' THEN printf('%.1f', floor(value * 10 + 0.5) / 10) || ' inhoudswoorden per deelzin'
    WHEN 'abstract_nouns' THEN 'veel abstracte woorden' WHEN 'passive' THEN 'lijdende vorm' WHEN 'subordinate_clause' THEN CAST(value AS INTEGER) || ' bijzinnen' ELSE word END), '{{sentence}}', sentence) AS prompt
  FROM trig JOIN (SELECT doc_id, sent_idx, string_agg(text, ' ' ORDER BY i) AS sentence FROM tok GROUP BY 1, 2) USING (doc_id, sent_idx)"""


@query("q_prompts", PROMPTS)
def _(spark, d):
    a = analysis(spark, d)
    return rewrite.prompts(a.triggers().join(sentence_texts(a), ["doc_id", "sent_idx"])).select("doc_id", "sent_idx", "type", "i", "prompt")


# --- editing --------------------------------------------------------------------------------------------------------

# Every suggestion of the table, a re-delivered one once; a request is a document here.
PROPOSED = "(SELECT DISTINCT ON (suggestion_id) suggestion_id AS id, request_id AS doc_id, sentence_index AS sent_idx, type, original_text AS original, suggested_text AS suggested, word_index AS i, replacement_word AS replacement, relation, error_category FROM suggestions WHERE request_id IS NOT NULL AND sentence_index IS NOT NULL ORDER BY suggestion_id, ingested_at)"
WORD_TYPES = ("word_frequency", "spelling")
ALONE = ("connective", "enumeration")


def proposed(spark, d) -> DataFrame:
    s = table(spark, d, "suggestions").filter("request_id is not null and sentence_index is not null")
    cols = {"request_id": "doc_id", "sentence_index": "sent_idx", "type": "type", "original_text": "original", "suggested_text": "suggested", "word_index": "i", "replacement_word": "replacement", "relation": "relation", "error_category": "error_category"}
    once = s.groupBy(F.col("suggestion_id").alias("id")).agg(F.min_by(F.struct(*[F.col(a).alias(b) for a, b in cols.items()]), "ingested_at").alias("s"))
    return once.select("id", "s.*")


def clustered(spark, d) -> DataFrame:
    """Suggestions with their cluster: a change of a word covers its place, a rewrite every place of its sentence."""
    p = proposed(spark, d)
    whole = F.when(F.trim(F.coalesce("original", F.lit(""))) != "", F.sequence(F.lit(0), F.size(F.split(F.trim("original"), r"\s+")) - 1))
    words = F.when(F.col("type").isin(*WORD_TYPES), F.when(F.col("i").isNotNull(), F.array("i"))).otherwise(whole)
    return p.join(editor.clusters(p.select("doc_id", "sent_idx", "id", "type", words.alias("words"))).select("id", "cluster"), "id")


CLUSTERED = rf"""(SELECT * EXCLUDE (unit, reach, n), min(id) OVER (PARTITION BY doc_id, sent_idx, unit) AS cluster FROM (
  SELECT *, CASE WHEN type IN {Q.names(ALONE)} OR (type IN {Q.names(WORD_TYPES)} AND i IS NULL) OR (type NOT IN {Q.names(WORD_TYPES)} AND n IS NULL) THEN 'id ' || id WHEN type NOT IN {Q.names(WORD_TYPES)} OR i < reach THEN 'rewrite' ELSE 'word ' || i END AS unit FROM (
    SELECT *, max(CASE WHEN type NOT IN {Q.names(WORD_TYPES + ALONE)} THEN n END) OVER (PARTITION BY doc_id, sent_idx) AS reach FROM (
      SELECT *, CASE WHEN regexp_replace(coalesce(original, ''), '^ +| +$', '', 'g') <> '' THEN len(regexp_split_to_array(regexp_replace(original, '^ +| +$', '', 'g'), '\s+')) END AS n FROM {PROPOSED}))))"""


@query("q_suggestion_clusters", f"SELECT id, doc_id, sent_idx, cluster FROM {CLUSTERED}")
def _(spark, d):
    return clustered(spark, d).select("id", "doc_id", "sent_idx", "cluster")


def decided(spark, d) -> DataFrame:
    """Suggestions with their state after the first of every sentence, by id, is accepted."""
    c = clustered(spark, d)
    w = Window.partitionBy("doc_id", "sent_idx").orderBy("id")
    log = c.select("doc_id", "id", "sent_idx", "cluster", "type", F.row_number().over(w).alias("_n"))
    cols = ["doc_id", "id", "sent_idx", "cluster", "type"]
    propose = log.select(*cols, F.lit(0).cast("bigint").alias("seq"), F.lit("propose").alias("action"))
    accept = log.filter("_n = 1").select(*cols, (F.col("sent_idx") + 1).cast("bigint").alias("seq"), F.lit("accept").alias("action"))
    return c.join(editor.decisions(propose.unionByName(accept)).select("id", "state"), "id")


SCOPED = Q.names(sorted(editor.SENTENCE_SCOPED))
COMPOSABLE = Q.names(sorted(editor.COMPOSABLE))
DECIDED = f"""(SELECT c.*, CASE WHEN c.id = a.id THEN 'accepted'
  WHEN a.type = 'connective' THEN CASE WHEN c.type NOT IN {COMPOSABLE} THEN 'ignored' ELSE 'pending' END
  WHEN c.type = 'connective' THEN CASE WHEN a.type NOT IN {COMPOSABLE} THEN 'ignored' ELSE 'pending' END
  WHEN c.cluster = a.cluster THEN 'ignored' WHEN c.type = 'enumeration' AND a.type NOT IN {SCOPED} THEN 'pending'
  WHEN a.type IN {SCOPED} OR c.type IN {SCOPED} THEN 'ignored' ELSE 'pending' END AS state FROM {CLUSTERED} c JOIN (SELECT doc_id, sent_idx, min(id) AS id, arg_min(type, id) AS type, arg_min(cluster, id) AS cluster FROM {CLUSTERED} GROUP BY 1, 2) a USING (doc_id, sent_idx))"""


@query("q_decided_states", f"SELECT id, doc_id, sent_idx, state FROM {DECIDED}")
def _(spark, d):
    return decided(spark, d).select("id", "doc_id", "sent_idx", "state")


@query("q_decided_clusters", f"SELECT doc_id, cluster, CASE WHEN bool_or(state = 'accepted') THEN 'accepted' WHEN bool_and(state = 'ignored') THEN 'ignored' ELSE 'pending' END AS state FROM {DECIDED} GROUP BY 1, 2")
def _(spark, d):
    return editor.cluster_state(decided(spark, d).select("doc_id", "cluster", "state"))


@query("q_decided_counts", f"SELECT type, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'accepted') AS accepted, count(*) FILTER (state = 'ignored') AS ignored FROM {DECIDED} GROUP BY type")
def _(spark, d):
    return editor.state_counts(decided(spark, d), ["type"])


DIMENSIONS = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in editor.DIMENSION.items()) + " END"
DIAGNOSED = f"(SELECT doc_id, dimension, count(DISTINCT cluster) AS total, count(DISTINCT CASE WHEN state = 'pending' THEN cluster END) AS remaining FROM (SELECT *, {DIMENSIONS} AS dimension FROM {DECIDED}) WHERE dimension IS NOT NULL GROUP BY 1, 2)"


def diagnosed(spark, d) -> DataFrame:
    return editor.diagnose(decided(spark, d).select("doc_id", "cluster", "state", F.array("type").alias("types")))


@query("q_suggestion_diagnosis", f"SELECT * FROM {DIAGNOSED}")
def _(spark, d):
    return diagnosed(spark, d)


@query("q_summary_bars", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, dimension) AS INTEGER) AS rank, dimension, total, remaining, round(100.0 * remaining / greatest(max(total) OVER (PARTITION BY doc_id), 1), 1) AS share FROM {DIAGNOSED}")
def _(spark, d):
    return editing.summary_bars(diagnosed(spark, d))


@query("q_labels", "SELECT id, CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in editing.LABELS.items()) + f" ELSE type END AS label, CASE WHEN type IN ('passive', 'connective') THEN type WHEN type = 'word_frequency' AND contains(trim(replacement, ' '), ' ') THEN 'split' END AS note, CASE error_category WHEN 'spelling' THEN 'Spelfout' WHEN 'grammar' THEN 'Grammaticafout' END AS error FROM {PROPOSED}")
def _(spark, d):
    return proposed(spark, d).select("id", editing.label(F.col("type")).alias("label"), editing.note(F.col("type"), F.col("replacement")).alias("note"), editing.named(editing.ERRORS, F.col("error_category")).alias("error"))


@query("q_absorbing_merges", rf"""SELECT id, rewrite, regexp_replace(regexp_replace(first, '^ +| +$', '', 'g'), '[.!?]+$', '') || substr(suggested, spot) AS text FROM (
  SELECT *, strpos(lower(suggested), ', ' || w || ' ') AS spot FROM (SELECT l.id, l.suggested, r.id AS rewrite, r.suggested AS first,
    [x FOR x IN [lower(regexp_replace(y, '[.,;:!?()"''“”‘’]', '', 'g')) FOR y IN regexp_split_to_array(l.suggested, '\s+')] IF x <> '' AND NOT list_contains([lower(regexp_replace(z, '[.,;:!?()"''“”‘’]', '', 'g')) FOR z IN regexp_split_to_array(l.original, '\s+')], x)][1] AS w
    FROM {PROPOSED} l JOIN {PROPOSED} r ON r.doc_id = l.doc_id AND r.sent_idx = l.sent_idx AND r.type IN {Q.names(generation.REWRITES)} WHERE l.type = 'connective')) WHERE spot > 0 AND first IS NOT NULL""")
def _(spark, d):
    return generation.composed(proposed(spark, d))


INTRODUCED = f"(SELECT DISTINCT suggestion_id FROM (SELECT suggestion_id, unnest([x FOR x IN {WORDS_OF.format('r')} IF NOT list_contains([lower(y) FOR y IN {WORDS_OF.format('o')}], lower(x))]) AS w FROM {PAIRS_SQL} WHERE r IS NOT NULL) WHERE length(w) >= 3 AND regexp_matches(w, '^\\p{{L}}+$') AND NOT regexp_matches(w, '^\\p{{Lu}}') AND lower(w) NOT IN (SELECT word FROM word_freq))"


@query(
    "q_backstop",
    f"SELECT suggestion_id, CASE WHEN r IS NULL OR trim(r, ' ') = '' THEN 'empty' WHEN contains(lower(r), 'niet toegepast') THEN 'marker' WHEN {NOOP} THEN 'noop' WHEN {CONJ_LOST} THEN 'conjunction' WHEN {URL_LOST} THEN 'url' WHEN suggestion_id IN (SELECT suggestion_id FROM {INTRODUCED}) THEN 'misspelling' END AS failure FROM {PAIRS_SQL}",
)
def _(spark, d):
    lex = lexicons.derived(table(spark, d, "word_freq"))
    return validation.backstop(pairs(spark, d), "suggestion_id", "o", "r", lex).select("suggestion_id", "failure")


@query("q_bundle_items", PLAN_PARTS.format(rank=Q.priority("type"), types=Q.names(K.SENTENCE_LEVEL), trig="trig").split("SELECT doc_id, CAST(job_idx")[0] + "SELECT doc_id, CAST(used + (pick - 1) // 8 + 1 AS INTEGER) AS job_idx, CAST((pick - 1) % 8 + 1 AS INTEGER) AS n, sent_idx, i, word FROM wk")
def _(spark, d):
    jobs = planner.consolidated_jobs(analysis(spark, d).triggers(), 12).filter("kind = 'wordfreq_bundle'")
    return jobs.select("doc_id", "job_idx", F.posexplode("items").alias("n", "x")).select("doc_id", "job_idx", (F.col("n") + 1).alias("n"), "x.sent_idx", "x.i", "x.word")


BEST = f"(SELECT word, candidate FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, word_count DESC, candidate) AS r FROM (SELECT *, {PREFIX.format(a='word', b='candidate')} AS p FROM ({NEAR})) WHERE p >= greatest(3, least(length(word), length(candidate)) - 2) OR (length(word) <= 4 AND length(candidate) <= 4) OR word_count > {K.MISSING_FREQUENCY}) WHERE r = 1)"


@query(
    "q_dictionary_spelling",
    f"""SELECT doc_id, sent_idx, i, word, candidate AS replacement, left(sentence, spot - 1) || candidate || substr(sentence, spot + length(word)) AS suggested FROM (SELECT f.doc_id, f.sent_idx, f.i, f.word, b.candidate, t.sentence, strpos(t.sentence, f.word) AS spot
        FROM (SELECT doc_id, sent_idx, lower AS word, min(i) AS i FROM f2 WHERE is_content_plain GROUP BY 1, 2, 3) f JOIN {BEST} b USING (word) JOIN (SELECT doc_id, sent_idx, string_agg(text, ' ' ORDER BY i) AS sentence FROM tok GROUP BY 1, 2) t USING (doc_id, sent_idx)) WHERE spot > 0 AND word <> candidate""",
)
def _(spark, d):
    a = analysis(spark, d)
    return generation.dictionary_spelling(a.features, sentence_texts(a), a.lexicons).select("doc_id", "sent_idx", "i", "word", "replacement", "suggested")


@query(
    "q_edited_text",
    """SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM (
       SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY n) AS last, max(CASE WHEN type <> 'blank' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead,
         min(CASE WHEN type <> 'blank' THEN n END) OVER (PARTITION BY doc_id) AS first FROM kinds)
       WHERE (type <> 'blank' OR (last <> 'blank' AND ahead IS NOT NULL)) AND n >= first GROUP BY doc_id""",
)
def _(spark, d):
    return editor.edited_text(blocks.blocks(table(spark, d, "documents")).withColumn("ordered", F.lit(False)).withColumn("number", F.lit(None).cast("int")))


@query("q_word_diff")
def _(spark, d):
    return editor.diffs(pairs(spark, d), "suggestion_id", "o", "r")


@query("q_enumeration_suppression", "SELECT DISTINCT suggestion_id FROM suggestions s WHERE type NOT IN ('sentence_rewrite', 'sentence_length', 'max_sdl') OR NOT EXISTS (SELECT 1 FROM suggestions e WHERE e.type = 'enumeration' AND e.request_id = s.request_id AND e.sentence_index = s.sentence_index)")
def _(spark, d):
    s = table(spark, d, "suggestions").select("suggestion_id", "type", F.col("request_id").alias("doc_id"), F.col("sentence_index").alias("sent_idx"))
    return rewrite.without_enumerated(s).select("suggestion_id").distinct()


# --- documents as blocks --------------------------------------------------------------------------------------------


@query("q_block_tokens", "SELECT doc_id, sent_idx, i, text, lemma, pos, dep, head FROM tok", Q.BLOCKS)
def _(spark, d):
    return by_blocks(spark, d)._parsed.select("doc_id", "sent_idx", "i", "text", "lemma", "pos", "dep", "head")


@query("q_merged_sentences", "SELECT doc_id, sent_idx, string_agg(text, ' ' ORDER BY i) AS sentence FROM tok GROUP BY 1, 2", Q.BLOCKS)
def _(spark, d):
    return by_blocks(spark, d).kept.select("doc_id", "sent_idx", "sentence")


@query("q_excluded_fragments", "SELECT doc_id, sent_idx, sentence FROM kept WHERE new_idx IS NULL", Q.BLOCKS)
def _(spark, d):
    return by_blocks(spark, d).kept.filter("new_idx IS NULL").select("doc_id", "sent_idx", "sentence")


@query(
    "q_layout",
    """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, s) - 1 AS INTEGER) AS place, type, text, sentence FROM (
       SELECT doc_id, n, 0 AS s, type, line AS text, NULL AS sentence FROM shown WHERE type <> 'prose'
       UNION ALL SELECT k.doc_id, t.n, k.sent_idx, CASE WHEN new_idx IS NULL THEN 'heading' ELSE 'sentence' END, k.sentence, new_idx FROM kept k JOIN (SELECT DISTINCT doc_id, sent_idx, n FROM t1) t USING (doc_id, sent_idx))""",
    Q.BLOCKS,
)
def _(spark, d):
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx", "part")) - 1
    return by_blocks(spark, d).layout.select("doc_id", place.cast("int").alias("place"), "type", "text", F.try_element_at("sentences", F.lit(1)).alias("sentence"))


@query("q_structured_sentences", f"SELECT {SENTENCE_INTS.replace('sent_idx', 'new_idx AS sent_idx')}, {rounded(SENTENCE_FLOATS)}, round(score, 6) AS score, level FROM sent JOIN kept USING (doc_id, sent_idx) WHERE new_idx IS NOT NULL", Q.BLOCKS)
def _(spark, d):
    return r6(by_blocks(spark, d).sentences.select(*SENTENCE_INTS.split(", "), *SENTENCE_FLOATS, "score", "level"), *SENTENCE_FLOATS, "score")


@query("q_structured_score", f"SELECT doc_id, sentence_count, CAST(words AS BIGINT) AS words, {rounded(DOC_FLOATS)}, level FROM doc", Q.BLOCKS)
def _(spark, d):
    return r6(by_blocks(spark, d).scores.select("doc_id", "sentence_count", "words", *DOC_FLOATS, "level"), *DOC_FLOATS)


@query("q_structured_triggers", "SELECT doc_id, new_idx AS sent_idx, type, i, word, round(value, 6) AS value FROM trig JOIN kept USING (doc_id, sent_idx) WHERE new_idx IS NOT NULL", Q.BLOCKS)
def _(spark, d):
    return r6(by_blocks(spark, d).triggers().select("doc_id", "sent_idx", "type", "i", "word", "value"), "value")


def linkable(a: Analysis) -> DataFrame:
    """Sentences of a structured analysis with what linking asks of them, and the paragraph of the layout each stands in."""
    t = a.tokens.groupBy("doc_id", "sent_idx").agg(aggregate.count_if(~F.col("is_punct")).alias("sent_length"), F.min_by("lower", "i").alias("first_word"), F.max_by("lower", "i").alias("last_token"))
    return t.join(structure.paragraphs(a.layout), ["doc_id", "sent_idx"])


@query(
    "q_paragraph_links",
    f"""SELECT doc_id, sent_idx, second FROM (SELECT *, lead(sent_idx) OVER w AS second, lead(words) OVER w AS n2, lead(first_word) OVER w AS f2w, lead(last_token) OVER w AS l2 FROM (
        SELECT k.doc_id, k.new_idx AS sent_idx, any_value(p.para) AS para, count(*) FILTER (NOT t.is_punct) AS words, arg_min(t.lower, t.i) AS first_word, arg_max(t.lower, t.i) AS last_token FROM tok t JOIN kept k USING (doc_id, sent_idx)
          JOIN (SELECT doc_id, type, s, sum(CASE WHEN type <> 'sentence' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n, s) AS para FROM (SELECT doc_id, n, 0 AS s, 'other' AS type FROM shown WHERE type <> 'prose'
            UNION ALL SELECT k.doc_id, u.n, k.sent_idx, CASE WHEN new_idx IS NULL THEN 'other' ELSE 'sentence' END FROM kept k JOIN (SELECT DISTINCT doc_id, sent_idx, n FROM t1) u USING (doc_id, sent_idx))) p ON p.doc_id = k.doc_id AND p.s = k.sent_idx AND p.type = 'sentence'
          WHERE k.new_idx IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY doc_id, para ORDER BY sent_idx))
        WHERE second = sent_idx + 1 AND words >= 4 AND n2 >= 4 AND last_token <> '?' AND l2 <> '?' AND f2w NOT IN {Q.names(K.CONNECTIVES)}""",
    Q.BLOCKS,
)
def _(spark, d):
    return planner.connective_candidates(linkable(by_blocks(spark, d)), ["paragraph"]).select("doc_id", "sent_idx", "second")


# --- figures, evaluation, service -----------------------------------------------------------------------------------


@query("q_noun_type_counts", "SELECT noun_class, count(*) AS n FROM f2 WHERE noun_class IS NOT NULL GROUP BY 1")
def _(spark, d):
    return stats.noun_counts(analysis(spark, d).features)


@query("q_dep_histogram", "SELECT dep_length, count(*) AS n FROM dl WHERE dep_length > 0 GROUP BY 1")
def _(spark, d):
    return stats.dependency_histogram(analysis(spark, d).tokens)


@query("q_score_quartiles", "SELECT level, round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3, round(max(score), 6) AS max FROM sent WHERE score IS NOT NULL GROUP BY level")
def _(spark, d):
    return r6(stats.box(analysis(spark, d).sentences, "score", ["level"]), "min", "q1", "median", "q3", "max")


@query("q_presence", "SELECT source, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (e IS NULL OR p IS NULL) AS unlabelled, round(count(*) FILTER (e AND p) / nullif(count(*) FILTER (p AND e IS NOT NULL), 0), 6) AS precision, round(count(*) FILTER (e AND p) / nullif(count(*) FILTER (e AND p IS NOT NULL), 0), 6) AS recall FROM (SELECT source, should_suggest AS e, length(text) > 400 AS p FROM corpus) GROUP BY source")
def _(spark, d):
    return stats.presence(table(spark, d, "corpus").select("source", F.col("should_suggest").alias("expected"), (F.length("text") > 400).alias("produced")), ["source"])


HELD_OUT = {"docs": "SELECT item_id AS doc_id, text FROM heldout_items WHERE text IS NOT NULL"}


@query(
    "q_detector_presence",
    """SELECT suite, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (e IS NULL OR p IS NULL) AS unlabelled, round(count(*) FILTER (e AND p) / nullif(count(*) FILTER (p AND e IS NOT NULL), 0), 6) AS precision,
       round(count(*) FILTER (e AND p) / nullif(count(*) FILTER (e AND p IS NOT NULL), 0), 6) AS recall FROM (SELECT suite, should_suggest AS e, item_id IN (SELECT doc_id FROM trig) AS p FROM heldout_items) GROUP BY suite""",
    HELD_OUT,
)
def _(spark, d):
    items = table(spark, d, "heldout_items")
    found = Readability(lexicons.derived(table(spark, d, "word_freq"))).analyze(items, key="item_id", structure=False).triggers().select(F.col("doc_id").alias("item_id")).distinct().withColumn("produced", F.lit(True))
    t = items.join(found, "item_id", "left").select("suite", F.col("should_suggest").alias("expected"), F.coalesce("produced", F.lit(False)).alias("produced"))
    return stats.presence(t, ["suite"])


@query("q_list_verdicts", f"SELECT doc_id, sent_idx, CASE WHEN NOT bool_or(type = 'enumeration') THEN 'missing' WHEN bool_or(type IN {Q.names(generation.REWRITES)}) THEN 'unsuppressed' ELSE 'ok' END AS verdict FROM {PROPOSED} GROUP BY 1, 2")
def _(spark, d):
    return stats.list_verdicts(proposed(spark, d), generation.REWRITES)


@query("q_model_tally", "SELECT type, lower(trim(model, ' ')) AS model, count(DISTINCT suggestion_id) AS suggestions FROM suggestions GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "suggestions").groupBy("type", F.lower(F.trim("model")).alias("model")).agg(F.countDistinct("suggestion_id").alias("suggestions"))


@query("q_phenomena", "SELECT phenomenon, count(*) AS items, count(*) FILTER (should_suggest) AS positive FROM (SELECT should_suggest, unnest(phenomena) AS phenomenon FROM corpus) GROUP BY 1")
def _(spark, d):
    return eval_items.phenomena(table(spark, d, "corpus"))


WORDLIST = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM {0})"


@query("q_vocab_audit", f"SELECT word FROM {WORDLIST.format('heldout_items')} WHERE length(word) >= 5 INTERSECT SELECT word FROM {WORDLIST.format('corpus')} WHERE length(word) >= 5")
def _(spark, d):
    words = lambda n: table(spark, d, n).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    return stats.shared_vocabulary(words("heldout_items"), words("corpus"))


@query("q_language_gate", "SELECT doc_id, coalesce(left(lower(lang), 2) IN ('nl', 'du'), true) OR length(trim(text, ' ')) < 25 AS passes FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return results.language_gate(table(spark, d, "documents").filter("text is not null")).select("doc_id", "passes")


@query("q_content_key", "SELECT doc_id, sha256('1' || ',' || 'none' || ',' || coalesce(format, '') || ',' || '' || ',' || text) AS key FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", results.content_key("1", "none", F.col("format"), F.lit(""), F.col("text")).alias("key"))


@query("q_cache_misses", "SELECT min(doc_id) AS doc_id, key FROM (SELECT doc_id, sha256('1' || ',' || 'none' || ',' || coalesce(format, '') || ',' || '' || ',' || text) AS key FROM documents WHERE text IS NOT NULL) WHERE key NOT IN (SELECT sha256('1' || ',' || 'none' || ',' || coalesce(format, '') || ',' || '' || ',' || text) FROM documents WHERE text IS NOT NULL AND source = 'nieuws') GROUP BY key")
def _(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "source", results.content_key("1", "none", F.col("format"), F.lit(""), F.col("text")).alias("key"))
    return results.misses(docs, docs.filter("source = 'nieuws'"), "doc_id")


@query("q_valid_requests", "SELECT DISTINCT request_id, length(text) BETWEEN 10 AND 20000 AND (max_suggestions IS NULL OR max_suggestions BETWEEN 1 AND 50) AND coalesce(lower(format) IN ('text', 'markdown', 'md'), true) AS valid FROM analyze_requests WHERE text IS NOT NULL")
def _(spark, d):
    return results.validated(table(spark, d, "analyze_requests").filter("text is not null")).select("request_id", "valid").distinct()


@query("q_suggestion_tally", "SELECT type, count(DISTINCT suggestion_id) FILTER (lower(model) = 'polder-70b') AS polder, count(DISTINCT suggestion_id) FILTER (lower(model) = 'klein-taal-8b') AS klein, count(DISTINCT suggestion_id) AS every FROM suggestions GROUP BY type")
def _(spark, d):
    s = table(spark, d, "suggestions")
    n = lambda m: F.countDistinct(F.when(F.lower("model") == m, F.col("suggestion_id")))
    return s.groupBy("type").agg(n("polder-70b").alias("polder"), n("klein-taal-8b").alias("klein"), F.countDistinct("suggestion_id").alias("every"))


@query("q_request_levels", "SELECT request_id, round(avg(lint_score), 6) AS mean_score, mode(difficulty_level) IS NOT NULL AS graded, count(*) AS sentences FROM (SELECT DISTINCT ON (request_id, sentence_index) * FROM sentence_analysis ORDER BY request_id, sentence_index, ingested_at DESC, lint_score, difficulty_level) GROUP BY request_id")
def _(spark, d):
    return results.request_levels(table(spark, d, "sentence_analysis"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
