"""SQL twins of the engine's stages for DuckDB: named parts that a query pulls in as it needs them."""

from __future__ import annotations

import re

from leesmaat import constants as K
from leesmaat.functions import text as T
from leesmaat.operators import tokens as TK
from leesmaat.operators.triggers import TYPES


def names(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def score(f: str, s: str, c: str, p: str) -> str:
    return f"CASE WHEN {f} IS NULL OR {s} IS NULL OR {c} IS NULL OR {p} IS NULL THEN NULL ELSE greatest(least(100 - ({K.INTERCEPT} + {K.W_FREQUENCY} * {f} + {K.W_DEPENDENCY} * {s} + {K.W_CONTENT_WORDS} * {c} + {K.W_CONCRETE} * {p}), 100.0), 0.0) END"


def level(x: str) -> str:
    a, b, c = K.LEVEL_BOUNDS
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {a} THEN 1 WHEN {x} < {b} THEN 2 WHEN {x} < {c} THEN 3 ELSE 4 END"


def priority(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{t}' THEN {n}" for n, t in enumerate(K.PRIORITY)) + f" ELSE {len(K.PRIORITY)} END"


SENT = "PARTITION BY doc_id, sent_idx ORDER BY i"
PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
PRON = "(contains(tag, 'VNW') AND (contains(tag, '|pers|') OR contains(tag, '|pr|') OR contains(tag, '|bez|')))"
BARE = "regexp_replace({0}, '" + T.CLOSERS.replace("'", "''") + "', '')"
CLOSED = "(regexp_matches(" + BARE + ", '[.!?…]$') OR (" + BARE + " <> '' AND regexp_matches({0}, '[.!?…]\\s')) OR regexp_matches(" + BARE + ", '\\S\\s+" + T.URL.replace("'", "''") + "$'))"
TH = K.THRESHOLDS

PARTS: dict[str, str] = {
    "docs": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL",
    "t0": f"SELECT doc_id, unnest(toks) AS text, CAST(unnest(range(len(toks))) AS INTEGER) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{T.TOKEN}') AS toks FROM docs)",
    "t1": f"""SELECT doc_id, i, text, lower(text) AS lower, NOT regexp_matches(text, '^[\\p{{L}}\\p{{N}}]') AS is_punct, regexp_matches(text, '^\\p{{L}}+$') AS is_alpha,
      CAST(coalesce(sum(CASE WHEN text IN ('.', '!', '?', '…') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i {PAST}), 0) AS INTEGER) AS sent_idx,
      coalesce(lag(lower(text)) OVER (PARTITION BY doc_id ORDER BY i), '') AS before FROM t0""",
    "t2": f"""SELECT *, CASE WHEN is_punct THEN 'PUNCT' WHEN regexp_matches(text, '^\\p{{N}}') THEN 'NUM' WHEN lower IN {names(TK.PRONOUNS_1 + TK.PRONOUNS_2 + TK.PRONOUNS_3)} THEN 'PRON'
      WHEN lower IN {names(TK.ARTICLES)} THEN 'DET' WHEN lower IN {names(TK.CONJUNCTIONS)} THEN 'CCONJ' WHEN lower IN {names(TK.PREPOSITIONS)} THEN 'ADP' WHEN lower IN {names(TK.COPULAS + TK.PASSIVES)} THEN 'AUX'
      WHEN regexp_matches(text, '^\\p{{Lu}}\\p{{Ll}}{{3,}}$') AND before <> '' AND before NOT IN ('.', '!', '?', '…') THEN 'PROPN'
      WHEN suffix(lower, 't') AND length(text) >= 5 THEN 'VERB' WHEN suffix(lower, 'en') AND length(text) >= 7 THEN 'VERB' WHEN suffix(lower, 'e') AND length(text) >= 5 THEN 'ADJ' WHEN length(text) >= 4 THEN 'NOUN' ELSE 'ADV' END AS pos FROM t1""",
    "t3": f"""SELECT *, min(i) OVER (PARTITION BY doc_id, sent_idx) AS first, min(CASE WHEN pos = 'VERB' THEN i END) OVER (PARTITION BY doc_id, sent_idx) AS verb,
      max(CASE WHEN pos = 'VERB' THEN i END) OVER ({SENT} {PAST}) AS last_verb, max(CASE WHEN pos IN ('NOUN', 'PROPN') THEN i END) OVER ({SENT} {PAST}) AS last_noun,
      min(CASE WHEN pos IN ('NOUN', 'PROPN') THEN i END) OVER ({SENT} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_noun FROM t2""",
    "t4": f"""SELECT *, coalesce(verb, first) AS root, CASE WHEN pos = 'PUNCT' THEN 'punct' WHEN i = coalesce(verb, first) THEN 'root' WHEN pos = 'DET' THEN 'det' WHEN pos = 'NUM' THEN 'nummod' WHEN pos = 'ADJ' THEN 'amod' WHEN pos = 'CCONJ' THEN 'cc' WHEN pos = 'ADP' THEN 'case'
      WHEN lower IN {names(TK.COPULAS)} THEN 'cop' WHEN pos = 'AUX' THEN 'aux:pass'
      WHEN pos = 'VERB' AND before IN {names(TK.CONJUNCTIONS + (",",))} AND last_verb IS NOT NULL THEN 'conj' WHEN pos = 'VERB' THEN CASE WHEN length(text) % 2 = 0 THEN 'advcl' ELSE 'acl:relcl' END
      WHEN pos IN ('NOUN', 'PROPN') AND before IN {names(TK.CONJUNCTIONS + (",",))} AND last_noun IS NOT NULL THEN 'conj' WHEN pos IN ('NOUN', 'PROPN') AND before = 'door' THEN 'obl:agent'
      WHEN pos IN ('NOUN', 'PROPN', 'PRON') AND last_verb IS NULL THEN 'nsubj' WHEN pos IN ('NOUN', 'PROPN') AND before IN {names(TK.PREPOSITIONS)} THEN 'nmod' WHEN pos IN ('NOUN', 'PROPN', 'PRON') THEN 'obj' ELSE 'advmod' END AS dep FROM t3""",
    "tok": f"""SELECT doc_id, sent_idx, i, text, lower, CASE WHEN suffix(lower, 'en') AND length(text) > 5 THEN left(lower, length(lower) - 2) WHEN suffix(lower, 't') AND pos = 'VERB' THEN left(lower, length(lower) - 1) ELSE lower END AS lemma, pos,
      CASE WHEN pos = 'PUNCT' THEN 'LET' WHEN pos = 'NUM' THEN 'TW|hoofd' WHEN pos = 'PRON' THEN 'VNW|pers|pron' || CASE WHEN lower IN {names(TK.PRONOUNS_1)} THEN '|1' WHEN lower IN {names(TK.PRONOUNS_2)} THEN '|2' WHEN lower = 'het' THEN '' ELSE '|3' END
        WHEN pos = 'DET' THEN 'LID|bep' WHEN pos = 'CCONJ' THEN 'VG|neven' WHEN pos = 'ADP' THEN 'VZ|init' WHEN pos = 'AUX' OR (suffix(lower, 't') AND pos = 'VERB') THEN 'WW|pv|tgw' WHEN pos = 'VERB' THEN 'WW|inf' WHEN pos = 'ADJ' THEN 'ADJ|prenom' WHEN pos = 'PROPN' THEN 'SPEC|deeleigen' WHEN pos = 'NOUN' THEN 'N|soort|ev' ELSE 'BW' END AS tag,
      dep, CASE WHEN dep = 'root' THEN i WHEN dep = 'conj' THEN CASE WHEN pos = 'VERB' THEN last_verb ELSE last_noun END WHEN dep IN ('det', 'amod', 'nummod', 'case') THEN coalesce(next_noun, root) WHEN dep = 'nmod' THEN coalesce(last_noun, root) ELSE root END AS head,
      CASE WHEN pos = 'PROPN' THEN CASE length(text) % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'GPE' ELSE 'ORG' END END AS ent_type, is_punct, is_alpha FROM t4""",
    "climb": """SELECT doc_id, i, head AS cur, 1 AS step FROM tok WHERE dep = 'conj' AND head <> i UNION ALL
      SELECT c.doc_id, c.i, t.head, c.step + 1 FROM climb c JOIN tok t ON t.doc_id = c.doc_id AND t.i = c.cur WHERE t.dep = 'conj' AND t.head <> t.i AND c.step < 50""",
    "based": "SELECT t.*, coalesce(b.cur, t.i) AS base FROM tok t LEFT JOIN (SELECT doc_id, i, arg_max(cur, step) AS cur FROM climb GROUP BY doc_id, i) b USING (doc_id, i)",
    "hd": """SELECT DISTINCT * FROM (SELECT t.doc_id, t.sent_idx, t.i, b.head FROM based t JOIN based b ON b.doc_id = t.doc_id AND b.i = t.base
      UNION ALL SELECT t.doc_id, t.sent_idx, t.i, m.i AS head FROM based t JOIN based b ON b.doc_id = t.doc_id AND b.i = t.base AND b.dep = 'nsubj'
        JOIN based g ON g.doc_id = t.doc_id AND g.i = b.head JOIN based m ON m.doc_id = t.doc_id AND m.sent_idx = t.sent_idx AND m.base = g.base)""",
    "pre": f"SELECT doc_id, sent_idx, i, dep, coalesce(sum(CASE WHEN dep <> 'punct' THEN 1 ELSE 0 END) OVER ({SENT} {PAST}), 0) AS p FROM based",
    "dl": """SELECT p.doc_id, p.sent_idx, p.i, CAST(CASE WHEN p.dep = 'punct' THEN 0 ELSE greatest(coalesce(max(abs(h.p - p.p)) - 1, 0), 0) END AS INTEGER) AS dep_length
      FROM pre p LEFT JOIN hd USING (doc_id, sent_idx, i) LEFT JOIN pre h ON h.doc_id = p.doc_id AND h.sent_idx = p.sent_idx AND h.i = hd.head GROUP BY p.doc_id, p.sent_idx, p.i, p.dep""",
    "up": """SELECT doc_id, sent_idx, i, i AS anc, 0 AS step FROM tok UNION ALL
      SELECT u.doc_id, u.sent_idx, u.i, t.head AS anc, u.step + 1 FROM up u JOIN tok t ON t.doc_id = u.doc_id AND t.i = u.anc WHERE t.head <> t.i AND u.step < 1000""",
    "sub": f"""SELECT DISTINCT u.doc_id, u.sent_idx, u.anc AS i FROM up u JOIN tok v ON v.doc_id = u.doc_id AND v.i = u.i AND contains(v.tag, 'WW')
      JOIN based a ON a.doc_id = u.doc_id AND a.i = u.anc JOIN based b ON b.doc_id = u.doc_id AND b.i = a.base WHERE b.dep IN {names(K.SUBORDINATE)}""",
    "nouns": """SELECT word, CASE WHEN length(word) % 5 = 0 THEN 'human' WHEN length(word) % 5 = 1 THEN 'place' ELSE 'other' END AS sem_type,
      CASE length(word) % 4 WHEN 0 THEN 'concrete' WHEN 1 THEN 'abstract' ELSE 'undefined' END AS super_sem_type, CASE WHEN length(word) >= 10 THEN right(word, 5) END AS head FROM word_freq WHERE length(word) % 4 <> 3""",
    "skips": "SELECT word FROM word_freq WHERE length(word) % 11 = 0",
    "manner": "SELECT word FROM word_freq WHERE length(word) = 5",
    "units": "SELECT unnest(['kg', 'cm', 'km', 'mm', 'm', 'l', 'uur']) AS word",
    "f0": f"""SELECT t.*, a.super_sem_type AS sup, a.head AS chead, b.super_sem_type AS sup_l, b.sem_type AS sem_l, (m.word IS NOT NULL) AS is_manner, (u.word IS NOT NULL) AS is_unit, (s1.word IS NOT NULL OR s2.word IS NOT NULL) AS skipped
      FROM based t LEFT JOIN nouns a ON a.word = t.lower LEFT JOIN nouns b ON b.word = t.lemma LEFT JOIN manner m ON m.word = t.lower LEFT JOIN units u ON u.word = t.lower LEFT JOIN skips s1 ON s1.word = t.lower LEFT JOIN skips s2 ON s2.word = t.lemma""",
    "f1": f"""SELECT *, (NOT contains(tag, 'TW') AND dep <> 'cop' AND (pos IN {names(K.CONTENT)} OR is_manner)) AS is_content, {PRON} AS is_pronoun,
      CASE WHEN pos IN ('NOUN', 'PROPN') THEN coalesce(chead, lower) ELSE lower END AS form FROM f0""",
    "f2": f"""SELECT f1.*, (is_content AND pos <> 'PROPN') AS is_content_plain, CASE WHEN is_content AND pos <> 'PROPN' AND NOT skipped THEN coalesce(w.word_count, {K.MISSING_FREQUENCY}) END AS frequency,
      CASE WHEN pos IN ('NOUN', 'PROPN') THEN coalesce(sup, sup_l, CASE WHEN ent_type IN ('PERSON', 'GPE') THEN 'concrete' WHEN ent_type = 'ORG' THEN 'abstract' END, 'unknown') WHEN contains(tag, 'SPEC') AND is_unit THEN 'concrete' END AS noun_class,
      contains(tag, 'WW|pv') AS is_finite, dep = 'aux:pass' AS is_passive_aux, CASE WHEN is_pronoun THEN TRY_CAST(nullif(regexp_extract(tag, '([0-9])', 1), '') AS INTEGER) END AS person,
      (is_pronoun AND lower <> 'het') OR (prefix(tag, 'VNW|onbep') AND lower IN {names(K.PERSON_PRONOUNS)}) OR (pos IN ('NOUN', 'PROPN') AND (coalesce(ent_type, '') = 'PERSON' OR coalesce(sem_l, '') = 'human')) AS is_human,
      dep <> 'cop' AND (pos IN ('NOUN', 'PROPN', 'VERB') OR is_pronoun) AS is_entity, pos <> 'ADV' AND dep IN {names(K.MODIFIERS)} AS is_modifier, dep = 'conj' AND pos IN {names(K.CONSTITUENTS)} AS is_constituent
      FROM f1 LEFT JOIN word_freq w ON w.word = f1.form""",
    "feat": "SELECT f2.*, dl.dep_length FROM f2 JOIN dl USING (doc_id, sent_idx, i)",
    "agg": """SELECT doc_id, sent_idx, count(*) FILTER (NOT is_punct) AS sent_length, sum(frequency) AS freq_sum, count(frequency) AS freq_count, max(CASE WHEN NOT is_punct THEN dep_length END) AS sdl,
      count(*) FILTER (noun_class = 'concrete') AS concrete, count(*) FILTER (noun_class = 'abstract') AS abstract, count(*) FILTER (noun_class = 'undefined') AS undefined, count(*) FILTER (noun_class = 'unknown') AS unknown,
      count(*) FILTER (is_content) AS content_words, count(*) FILTER (is_finite) AS finite_verbs, bool_or(is_passive_aux) AS has_passive, count(*) FILTER (is_constituent) AS constituents, count(*) FILTER (is_modifier) AS modifiers,
      count(*) FILTER (is_human) AS humans, count(*) FILTER (dep = 'obl:agent') AS agents, count(*) FILTER (is_alpha) AS alpha_words FROM feat GROUP BY doc_id, sent_idx""",
    "agg2": """SELECT *, freq_sum / nullif(freq_count, 0) AS mean_log_word_frequency, CASE WHEN sent_length >= 2 THEN sdl END AS max_sdl, content_words / greatest(finite_verbs, 1) AS content_words_per_clause,
      concrete / nullif(concrete + abstract + undefined, 0) AS proportion_of_concrete_nouns, sent_length / greatest(finite_verbs, 1) AS mean_clause_length, constituents / greatest(finite_verbs, 1) AS constituents_per_clause FROM agg""",
    "clauses": """SELECT a.doc_id, a.sent_idx, coalesce(s.n, 0) AS subordinate_clauses, (a.modifiers + coalesce(x.n, 0)) / greatest(a.finite_verbs, 1) AS modifiers_per_clause FROM agg a
      LEFT JOIN (SELECT doc_id, sent_idx, count(*) AS n FROM sub GROUP BY 1, 2) s USING (doc_id, sent_idx)
      LEFT JOIN (SELECT u.doc_id, u.sent_idx, count(*) AS n FROM up u JOIN f2 m ON m.doc_id = u.doc_id AND m.i = u.anc AND m.is_modifier JOIN tok c ON c.doc_id = u.doc_id AND c.i = u.i AND c.dep = 'conj' GROUP BY 1, 2) x USING (doc_id, sent_idx)""",
    "s0": f"SELECT *, {score('mean_log_word_frequency', 'max_sdl', 'content_words_per_clause', 'proportion_of_concrete_nouns')} AS score FROM agg2",
    "sent": f"SELECT s0.*, {level('score')} AS level, subordinate_clauses, modifiers_per_clause FROM s0 JOIN clauses USING (doc_id, sent_idx)",
    "d0": """SELECT doc_id, count(*) AS sentence_count, sum(freq_sum) / nullif(sum(freq_count), 0) AS mean_log_word_frequency, avg(max_sdl) AS mean_max_sdl, avg(content_words_per_clause) AS mean_content_words_per_clause,
      sum(concrete) / nullif(sum(concrete) + sum(abstract) + sum(undefined), 0) AS proportion_of_concrete_nouns, min(score) AS min_score, max(score) AS max_score, sum(sent_length) AS words FROM s0 GROUP BY doc_id""",
    "d1": f"SELECT *, {score('mean_log_word_frequency', 'mean_max_sdl', 'mean_content_words_per_clause', 'proportion_of_concrete_nouns')} AS score FROM d0",
    "doc": f"SELECT *, {level('score')} AS level FROM d1",
    "stems": f"""SELECT DISTINCT lower, lemma, pos, unnest(list_concat([lemma],
        CASE WHEN pos = 'VERB' THEN [substr(lemma, length(p) + 1) FOR p IN [{', '.join(f"'{p}'" for p in K.PARTICLES)}] IF prefix(lemma, p) AND length(lemma) - length(p) >= 4]
             WHEN pos = 'NOUN' THEN list_concat([left(lemma, length(lemma) - length(p)) FOR p IN [{', '.join(f"'{p}'" for p in K.DIMINUTIVES)}] IF suffix(lemma, p) AND length(lemma) - length(p) >= 3], [left(lower, length(lower) - length(p)) FOR p IN [{', '.join(f"'{p}'" for p in K.DIMINUTIVES)}] IF suffix(lower, p) AND length(lower) - length(p) >= 3])
             WHEN pos = 'ADJ' THEN list_concat([left(lemma, length(lemma) - length(p)) FOR p IN [{', '.join(f"'{p}'" for p in K.ADJECTIVE_ENDINGS)}] IF suffix(lemma, p) AND length(lemma) - length(p) >= 3], [left(lower, length(lower) - length(p)) FOR p IN [{', '.join(f"'{p}'" for p in K.ADJECTIVE_ENDINGS)}] IF suffix(lower, p) AND length(lower) - length(p) >= 3]) ELSE [] END)) AS stem
      FROM (SELECT DISTINCT lower, lemma, pos FROM f2 WHERE frequency < {TH['word_frequency']})""",
    "family": "SELECT s.lower, s.lemma, s.pos, max(w.word_count) AS family FROM stems s LEFT JOIN word_freq w ON w.word = s.stem GROUP BY 1, 2, 3",
    "trig": f"""SELECT f.doc_id, f.sent_idx, 0 AS ord, 'word_frequency' AS type, f.i, f.lower AS word, f.frequency AS value, CAST({TH['word_frequency']} AS DOUBLE) AS threshold FROM f2 f JOIN family USING (lower, lemma, pos) WHERE f.frequency < {TH['word_frequency']} AND (family IS NULL OR family < {TH['word_frequency']})
      UNION ALL SELECT doc_id, sent_idx, 1, 'max_sdl', NULL, NULL, CAST(max_sdl AS DOUBLE), {TH['max_sdl']} FROM sent WHERE max_sdl > {TH['max_sdl']} AND alpha_words >= {TH['max_sdl_words']}
      UNION ALL SELECT doc_id, sent_idx, 2, 'content_words_per_clause', NULL, NULL, content_words_per_clause, {TH['content_words_per_clause']} FROM sent WHERE content_words_per_clause > {TH['content_words_per_clause']}
      UNION ALL SELECT doc_id, sent_idx, 3, 'abstract_nouns', NULL, NULL, proportion_of_concrete_nouns, 1 - CAST({TH['abstract_share']} AS DOUBLE) FROM sent WHERE proportion_of_concrete_nouns < 1 - CAST({TH['abstract_share']} AS DOUBLE) AND abstract >= {TH['abstract_nouns']}
      UNION ALL SELECT doc_id, sent_idx, 4, 'passive', NULL, NULL, 1.0, 1 FROM sent WHERE has_passive AND agents > 0
      UNION ALL SELECT doc_id, sent_idx, 5, 'subordinate_clause', NULL, NULL, CAST(subordinate_clauses AS DOUBLE), {TH['subordinate_clauses']} FROM sent WHERE subordinate_clauses > {TH['subordinate_clauses']}
      UNION ALL SELECT doc_id, sent_idx, 6, 'sentence_length', NULL, NULL, CAST(sent_length AS DOUBLE), {TH['sentence_length']} FROM sent WHERE sent_length > {TH['sentence_length']}""",
    "ranked": f"SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY {priority('type')}, ord, coalesce(i, -1)) AS round FROM trig",
    "dealt": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round, sent_idx) AS pick FROM ranked",
    "lines0": r"SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM docs",
    "lines": "SELECT doc_id, CAST(n AS INTEGER) AS n, trim(regexp_replace(line, '[ \\t]+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM lines0)",
    "kinds": "SELECT *, CASE WHEN line = '' THEN 'blank' WHEN " + CLOSED.format("line") + " THEN 'prose' ELSE 'heading' END AS type FROM lines",
}


# The parts that differ where documents are taken as blocks: hard-wrapped texts are rejoined, sentences stay within the prose
# lines of a text, short ones join the next, and what is a mere fragment without a score is no sentence.
_RAW = {f"{k}_raw": re.sub(r"\b(docs|lines0|lines|kinds)\b", r"\1_raw", PARTS[k]) for k in ("docs", "lines0", "lines", "kinds")}
UNWRAPPED = """SELECT doc_id, coalesce(u.text, docs_raw.text) AS text FROM docs_raw LEFT JOIN (SELECT doc_id, string_agg(p, chr(10) ORDER BY n) AS text FROM paras GROUP BY doc_id) u USING (doc_id)"""
BLOCKS: dict[str, str] = _RAW | {
    "wrapped": "SELECT doc_id FROM (SELECT doc_id, count(*) FILTER (line <> '' AND nxt <> '') AS j, count(*) FILTER (line <> '' AND nxt <> '' AND type = 'heading') AS s FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS nxt FROM kinds_raw) GROUP BY doc_id) WHERE j >= 3 AND s >= greatest(2, 0.4 * j)",
    "para_lines": "SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS para FROM kinds_raw WHERE doc_id IN (SELECT doc_id FROM wrapped)",
    "hyphens": r"SELECT *, CASE WHEN regexp_extract(line, '(\p{L}+)-$', 1) <> '' AND regexp_extract(coalesce(nxt, ''), '^(\p{Ll}\p{L}*)', 1) <> '' THEN lower(regexp_extract(line, '(\p{L}+)-$', 1) || regexp_extract(nxt, '^(\p{Ll}\p{L}*)', 1)) END AS joined FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id, para ORDER BY n) AS nxt FROM para_lines WHERE line <> '')",
    "paras": """SELECT doc_id, min(n) AS n, trim(string_agg(CASE WHEN w.word IS NOT NULL THEN left(line, length(line) - 1) WHEN joined IS NOT NULL THEN line ELSE line || ' ' END, '' ORDER BY n), ' ') AS p FROM hyphens LEFT JOIN word_freq w ON w.word = hyphens.joined GROUP BY doc_id, para
      UNION ALL SELECT doc_id, n, line FROM para_lines WHERE line = ''""",
    "docs": UNWRAPPED,
    "shown": """SELECT * FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY n) AS last, max(CASE WHEN type <> 'blank' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead,
      min(CASE WHEN type <> 'blank' THEN n END) OVER (PARTITION BY doc_id) AS first FROM kinds) WHERE (type <> 'blank' OR (last <> 'blank' AND ahead IS NOT NULL)) AND n >= first""",
    "b0": f"SELECT doc_id, n, unnest(toks) AS text, CAST(unnest(range(len(toks))) AS INTEGER) AS p FROM (SELECT doc_id, n, regexp_extract_all(line, '{T.TOKEN}') AS toks FROM kinds WHERE type = 'prose')",
    "b1": f"SELECT *, coalesce(sum(CASE WHEN text IN ('.', '!', '?', '…') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n ORDER BY p {PAST}), 0) AS seg FROM b0",
    "b2": "SELECT *, w <= 2 AND last NOT IN ('.', '!', '?') AND lead(seg) OVER (PARTITION BY doc_id, n ORDER BY seg) IS NOT NULL AS short FROM (SELECT doc_id, n, seg, count(*) FILTER (regexp_matches(text, '^[\\p{L}\\p{N}]')) AS w, arg_max(text, p) AS last FROM b1 GROUP BY 1, 2, 3)",
    "b3": "SELECT *, short AND (seg - coalesce(max(CASE WHEN NOT short THEN seg END) OVER (PARTITION BY doc_id, n ORDER BY seg), -1)) % 2 = 1 AS opens FROM b2",
    "b4": "SELECT doc_id, n, seg, CASE WHEN coalesce(lag(opens) OVER (PARTITION BY doc_id, n ORDER BY seg), false) THEN seg - 1 ELSE seg END AS grp FROM b3",
    "t1": """SELECT doc_id, n, text, lower(text) AS lower, NOT regexp_matches(text, '^[\\p{L}\\p{N}]') AS is_punct, regexp_matches(text, '^\\p{L}+$') AS is_alpha, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY n, grp) - 1 AS INTEGER) AS sent_idx,
      CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, p) - 1 AS INTEGER) AS i, coalesce(lag(lower(text)) OVER (PARTITION BY doc_id, n ORDER BY p), '') AS before FROM b1 JOIN b4 USING (doc_id, n, seg)""",
    "texts": "SELECT doc_id, sent_idx, string_agg(text, ' ' ORDER BY i) AS sentence FROM tok GROUP BY 1, 2",
    "kept": f"""SELECT *, CASE WHEN NOT fragment THEN CAST(sum(CASE WHEN fragment THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS INTEGER) END AS new_idx FROM (
      SELECT doc_id, sent_idx, sentence, score IS NULL AND (len(regexp_extract_all(sentence, '\\p{{L}}+')) <= 3 OR regexp_matches(sentence, ':\\s*$')) AS fragment FROM texts JOIN s0 USING (doc_id, sent_idx))""",
    "d0": PARTS["d0"].replace("FROM s0 GROUP", "FROM s0 JOIN kept USING (doc_id, sent_idx) WHERE new_idx IS NOT NULL GROUP"),
}


TIE = 1e-9


def steady(text: str) -> str:
    """The query with a small addend in every rounding to six digits, so that ties fall the same way everywhere."""
    out = []
    for m in re.finditer(r"\bround\(", text):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        if text[: end - 1].endswith(", 6"):
            out.append((m.end(), end - 4))
    for start, stop in reversed(out):
        text = f"{text[:start]}({text[start:stop]}) + {TIE}{text[stop:]}"
    return text


def sql(select: str, parts: dict[str, str] | None = None) -> str:
    """A query with the parts it names, and those they name; `parts` take the place of common ones of the same name."""
    known, need, seen = PARTS | (parts or {}), [], set()

    def pull(text: str) -> None:
        for name in known:
            if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                seen.add(name)
                pull(known[name])
                need.append(name)

    pull(select)
    if not need:
        return select
    if parts is None:
        need.sort(key=list(PARTS).index)
    recursive = {"climb", "up"}
    if select.lstrip().startswith("WITH "):
        select = "," + select.lstrip()[4:]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n in recursive else 'MATERIALIZED '}({known[n]})" for n in need) + "\n" + select


__all__ = ["PARTS", "TYPES", "sql"]
