"""Structure of sentences on trees written by hand and against brute force; features of the published example."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from leesmaat.operators import aggregate, features, syntax
from leesmaat.sources.lexicons import Lexicons

TOKEN = "doc_id long, sent_idx int, i int, text string, lower string, lemma string, pos string, tag string, dep string, head int, ent_type string, is_punct boolean, is_alpha boolean"

# The published example sentence; heads chosen to agree with its published dependency lengths.
EXAMPLE = [
    ("De", "DET", "LID|bep", "det", 1), ("Oudegracht", "PROPN", "SPEC|deeleigen", "nsubj", 5), ("is", "AUX", "WW|pv|tgw", "cop", 5), ("het", "DET", "LID|bep", "det", 5), ("sfeervolle", "ADJ", "ADJ|prenom", "amod", 5),
    ("hart", "NOUN", "N|soort|ev", "root", 5), ("van", "ADP", "VZ|init", "case", 8), ("de", "DET", "LID|bep", "det", 8), ("stad", "NOUN", "N|soort|ev", "nmod", 5), (".", "PUNCT", "LET", "punct", 5),
]


def tokens(spark, sentences, doc=1):
    rows = []
    at = 0
    for s, words in enumerate(sentences):
        for n, (text, pos, tag, dep, head) in enumerate(words):
            rows.append((doc, s, at + n, text, text.lower(), text.lower(), pos, tag, dep, at + head, None, pos == "PUNCT", text.isalpha()))
        at += len(words)
    return spark.createDataFrame(rows, TOKEN)


def lex(spark, nouns=(), frequency=(), skip=(), manner=()):
    one = lambda v: spark.createDataFrame([(x,) for x in v], "word string")
    return Lexicons(
        spark.createDataFrame(list(nouns), "word string, sem_type string, super_sem_type string, head string"), spark.createDataFrame(list(frequency), "word string, word_count double"), one(skip), one(manner), one(["kg"]), one([w for w, _ in frequency])
    )


def test_published_sentence(spark):
    p = syntax.parse(tokens(spark, [EXAMPLE]))
    assert [r["dep_length"] for r in p.orderBy("i").collect()] == [0, 3, 2, 1, 0, 0, 1, 0, 2, 0]
    lists = lex(spark, [("hart", "other", "undefined", None), ("stad", "place", "concrete", None)], [("hart", 5.293120582960477), ("stad", 5.435577664689725)], ["sfeervolle"])
    f = features.token_features(p, lists)
    s = aggregate.sentence_features(f).first()
    assert (s["content_words"], s["content_words_per_clause"], s["sent_length"], s["mean_clause_length"], s["proportion_of_concrete_nouns"], s["max_sdl"]) == (4, 4.0, 9, 9.0, 0.5, 3)
    assert s["score"] == pytest.approx(18.511612982419507, abs=1e-9) and s["level"] == 1
    assert s["modifiers_per_clause"] == 2.0 and not s["has_passive"] and s["subordinate_clauses"] == 0 and s["humans"] == 0


def test_conjuncts_share_a_head_and_subjects_have_all_of_a_coordination(spark):
    words = [("a", "NOUN", "N", "nsubj", 1), ("loopt", "VERB", "WW|pv", "root", 1), ("en", "CCONJ", "VG", "cc", 3), ("zingt", "VERB", "WW|pv", "conj", 1), ("en", "CCONJ", "VG", "cc", 5), ("danst", "VERB", "WW|pv", "conj", 3), ("b", "NOUN", "N", "conj", 0)]
    got = {r["i"]: (r["base"], sorted(r["heads"]), r["dep_length"]) for r in syntax.parse(tokens(spark, [words])).collect()}
    assert got[5][0] == 1 and got[3][0] == 1
    assert got[0][1] == [1, 3, 5] and got[0][2] == 4  # the farthest head counts
    assert got[6][:2] == (0, [1, 3, 5])


def brute(rows):
    by = {r["i"]: r for r in rows}

    def base(i):
        for _ in range(50):
            r = by[i]
            if r["dep"] != "conj" or r["head"] == i:
                return i
            i = r["head"]
        return i

    out = {}
    order = sorted(by)
    words = lambda a, b: sum(by[k]["dep"] != "punct" for k in order if a <= k < b)
    for i in by:
        b = base(i)
        h = by[b]["head"]
        heads = {h}
        if by[b]["dep"] == "nsubj":
            group = {k for k in by if base(k) == base(h)}
            if len(group) > 1:
                heads |= group
        far = max(words(min(i, x), max(i, x)) - 1 for x in heads)
        tree = {k for k in by if i in chain(by, k)}
        out[i] = (b, heads, 0 if by[i]["dep"] == "punct" else max(far, 0), len(tree), sum("WW" in by[k]["tag"] for k in tree))
    return out


def chain(by, k):
    seen = [k]
    while by[k]["head"] != k:
        k = by[k]["head"]
        seen.append(k)
    return seen


def test_against_brute_force(spark):
    rng = random.Random(3)
    sentences = []
    for _ in range(40):
        n = rng.randint(1, 14)
        root = rng.randrange(n)
        order = [root, *rng.sample([k for k in range(n) if k != root], n - 1)]
        words = [None] * n
        for place, k in enumerate(order):
            head = k if place == 0 else order[rng.randrange(place)]
            dep = "root" if place == 0 else rng.choice(["conj", "nsubj", "obj", "punct", "advcl"])
            words[k] = (f"w{k}", "NOUN", rng.choice(["N", "WW|pv"]), dep, head)
        sentences.append(words)
    rows = syntax.parse(tokens(spark, sentences)).collect()
    for s in range(len(sentences)):
        mine = [r for r in rows if r["sent_idx"] == s]
        want = brute(mine)
        assert {r["i"]: (r["base"], set(r["heads"]), r["dep_length"], r["subtree_size"], r["subtree_verbs"]) for r in mine} == want


def test_empty_table_and_foreign_heads(spark):
    assert syntax.parse(tokens(spark, [])).count() == 0
    lone = syntax.parse(tokens(spark, [[("a", "NOUN", "N", "nsubj", 40)]])).first()
    assert lone["dep_length"] == 0 and lone["base"] == 0


@pytest.mark.parametrize(("gap", "new"), [(49, False), (50, False), (51, True)])
def test_novelty_looks_back_fifty_words(spark, gap, new):
    words = [("ding" if k in (10, 10 + gap) else f"w{k}", "NOUN" if k in (10, 10 + gap) else "ADV", "N", "obj", 0) for k in range(70)]
    f = features.novelty(features.token_features(syntax.parse(tokens(spark, [words])), lex(spark)))
    assert f.filter(F.col("i") == 10 + gap).first()["is_new"] is (new if 10 + gap >= 50 else None)


def test_pronoun_without_person_equals_words_without_one(spark):
    words = [("ding" if k == 40 else ("het" if k == 60 else f"w{k}"), "NOUN" if k == 40 else ("PRON" if k == 60 else "ADV"), "VNW|pers|pron" if k == 60 else "N", "obj", 0) for k in range(62)]
    f = features.novelty(features.token_features(syntax.parse(tokens(spark, [words])), lex(spark)))
    assert f.filter("i = 60").first()["is_new"] is False


def test_numeral_and_copula_are_no_content_words_and_manner_adverbs_are(spark):
    words = [("twee", "ADJ", "TW|hoofd", "amod", 1), ("is", "VERB", "WW|pv", "cop", 2), ("snel", "ADV", "BW", "advmod", 2), ("vaak", "ADV", "BW", "advmod", 2)]
    f = features.token_features(syntax.parse(tokens(spark, [words])), lex(spark, manner=["snel"]))
    assert [r["is_content"] for r in f.orderBy("i").collect()] == [False, False, True, False]


def test_golden_document_arithmetic(spark):
    """Pooled frequency, mean of maxima, pooled noun share: not a mean of sentence scores."""
    s = spark.createDataFrame([(1, 0, 10.0, 2, 3, 4.0, 1, 1, 0, 30.0, 5), (1, 1, 4.0, 1, 5, 6.0, 0, 1, 2, 50.0, 6), (1, 2, None, 0, None, 1.0, 0, 0, 0, None, 1)], "doc_id long, sent_idx int, freq_sum double, freq_count int, max_sdl int, content_words_per_clause double, concrete int, abstract int, undefined int, score double, sent_length int")
    d = aggregate.document_features(s).first()
    assert d["mean_log_word_frequency"] == pytest.approx(14 / 3) and d["mean_max_sdl"] == 4.0 and d["mean_content_words_per_clause"] == pytest.approx(11 / 3) and d["proportion_of_concrete_nouns"] == pytest.approx(0.2)
    assert (d["min_score"], d["max_score"], d["sentence_count"]) == (30.0, 50.0, 3)
