"""Differences, decisions, clusters, answers of models, spelling."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from leesmaat.operators import editor, rewrite, spelling


def test_word_diff():
    assert editor.word_diff("De kat zit.".split(), "De hond zit.".split()) == [(1, 2, 1, 2)]
    assert editor.word_diff("a b".split(), "a b".split()) == []
    assert editor.word_diff([], "a".split()) == [(0, 0, 0, 1)] and editor.word_diff("a".split(), []) == [(0, 1, 0, 0)]
    assert editor.word_diff("zit de kat".split(), "Zit de kat".split()) == [(0, 1, 0, 1)]  # the same word that looks different


def test_diff_regions_rebuild_the_new_text():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 8))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 8))]
        out = list(a)
        for s, e, x, y in reversed(editor.word_diff(a, b)):
            out[s:e] = b[x:y]
        assert out == b


def test_apply_regions_keeps_marks_and_capitals():
    assert editor.apply_regions("De kat zit hier.".split(), [(0, 1, "een"), (3, 4, "daar")]) == "Een kat zit daar."


def test_clusters_are_connected_components(spark):
    rows = [(1, 0, "a", "x", [1, 2]), (1, 0, "b", "x", [2, 3]), (1, 0, "c", "x", [3]), (1, 0, "d", "x", [9]), (1, 0, "e", "connective", [1]), (1, 1, "f", "x", [1])]
    df = spark.createDataFrame(rows, "doc_id long, sent_idx int, id string, type string, words array<int>")
    assert {r["id"]: r["cluster"] for r in editor.clusters(df).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}


def log(rows):
    return pd.DataFrame(rows, columns=["doc_id", "seq", "id", "sent_idx", "cluster", "type", "action"])


def test_decisions():
    base = [(1, 0, "w1", 0, "w1", "word_frequency", "propose"), (1, 1, "r1", 0, "r1", "sentence_rewrite", "propose"), (1, 2, "w2", 1, "w2", "word_frequency", "propose"), (1, 3, "w3", 0, "w1", "word_frequency", "propose")]
    state = lambda extra: dict(editor.decide(log(base + extra))[["id", "state"]].to_numpy().tolist())
    assert state([(1, 4, "r1", 0, "r1", "sentence_rewrite", "accept")]) == {"w1": "ignored", "r1": "accepted", "w2": "pending", "w3": "ignored"}
    assert state([(1, 4, "w1", 0, "w1", "word_frequency", "accept")]) == {"w1": "accepted", "r1": "ignored", "w2": "pending", "w3": "ignored"}
    assert state([(1, 4, "r1", 0, "r1", "sentence_rewrite", "accept"), (1, 5, "r1", 0, "r1", "sentence_rewrite", "undo")]) == dict.fromkeys(["w1", "r1", "w2", "w3"], "pending")


def test_cluster_state_and_diagnosis(spark):
    m = spark.createDataFrame([(1, "a", "accepted"), (1, "a", "ignored"), (1, "b", "ignored"), (1, "c", "pending"), (1, "c", "ignored")], "doc_id long, cluster string, state string")
    assert {r["cluster"]: r["state"] for r in editor.cluster_state(m).collect()} == {"a": "accepted", "b": "ignored", "c": "pending"}
    d = m.withColumn("types", F.array(F.lit("passive"), F.lit("other")))
    assert [tuple(r) for r in editor.diagnose(d).collect()] == [(1, "density", 3, 1)]


def test_effective_score_falls_back(spark):
    cols = "doc_id long, sent_idx int, freq_sum double, freq_count int, max_sdl double, content_words_per_clause double, concrete int, abstract int, undefined int"
    s = spark.createDataFrame([(1, 0, 10.0, 2, 6.0, 8.0, 1, 1, 0), (1, 1, 5.0, 1, 4.0, 4.0, 1, 0, 0)], cols)
    acc = spark.createDataFrame([(1, 0, 2, 12.0, 2, 3.0, 4.0, 2, 0, 0), (1, 0, 1, 11.0, 2, 2.0, 3.0, 1, 0, 0)], cols.replace("sent_idx int", "sent_idx int, rank int"))
    gone = spark.createDataFrame([(1, 1)], "doc_id long, sent_idx int")
    e = editor.effective_sentences(s, acc, gone)
    assert [tuple(r) for r in e.collect()] == [(1, 0, 11.0, 2, 2.0, 3.0, 1, 0, 0)]
    original = spark.createDataFrame([(1, 40.0), (2, 55.0)], "doc_id long, score double")
    assert {r["doc_id"]: r["score"] for r in editor.effective_score(e, original).collect()}[2] == 55.0


def test_parsers():
    assert rewrite.parse_fields("<think>a: b</think>\n**VOORSTEL:** een zin\nmet vervolg\nTOELICHTING: [kort]") == {"VOORSTEL": "een zin met vervolg", "TOELICHTING": "kort"}
    assert rewrite.parse_fields(None) == {} and rewrite.parse_fields("los") == {}
    blocks = rewrite.parse_blocks("ZIN NUMMER: 1\nWOORD: a\n---\nREDEN: x\n---\nWOORD: b", "WOORD")
    assert [b["WOORD"] for b in blocks] == ["a", "b"] and blocks[0]["ZIN_NUMMER"] == "1"
    assert rewrite.parse_blocks("GEEN_FOUTEN", "WOORD") == [] and rewrite.parse_blocks("GEEN", "WOORD") == []


def test_jobs_keep_errors_beside_answers(spark):
    class Failing:
        model = "failing"

        def complete(self, system, user, max_tokens):
            if user == "stuk":
                raise ValueError("stuk")
            return user.upper()

    jobs = spark.createDataFrame([("1", "", "goed"), ("2", "", "stuk"), ("3", None, None)], "job string, s string, u string")
    out = {r["job"]: (r["content"], r["error"]) for r in rewrite.run_jobs(jobs, Failing, "job", "s", "u").collect()}
    assert out == {"1": ("GOED", None), "2": (None, "ValueError: stuk"), "3": ("", None)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_spelling_candidates_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(3, 7)))
    words, listed = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    w = spark.createDataFrame([(x,) for x in words], "word string")
    f = spark.createDataFrame([(x, 1.0) for x in listed], "word string, word_count double")
    got = {(r["word"], r["candidate"]) for r in spelling.candidates(w, f).collect()}
    want = {(a, b) for a in words for b in listed if 0 < distance(a, b) <= 2}
    assert got == want


def test_reject_reasons(spark):
    p = spark.createDataFrame([(0, "huiss", "huis", "het huiss staat"), (9, "a", "b", "a"), (0, "huis", "[woord]", "het huis"), (0, "huis", "huis klein", "het huis"), (0, "boom", "bomen", "het huis"), (0, "huis", "huis", "het huis"), (0, "inhuis", "in huis", "zij is inhuis"), (0, "huisx", "hui sx", "het huisx")], "sent_idx int, wrong string, right string, sentence string")
    f = spark.createDataFrame([("huis", 5.0), ("in", 6.0)], "word string, word_count double")
    got = {(r["wrong"], r["right"]): r["reject_reason"] for r in spelling.reject_reason(p, f, 2).collect()}
    assert got == {("huiss", "huis"): None, ("a", "b"): "range", ("huis", "[woord]"): "placeholder", ("huis", "huis klein"): "insertion", ("boom", "bomen"): "absent", ("huis", "huis"): "no_effect", ("inhuis", "in huis"): None, ("huisx", "hui sx"): "implausible"}


def test_enumerations_suppress_rewrites(spark):
    s = spark.createDataFrame([(1, 0, "enumeration"), (1, 0, "max_sdl"), (1, 0, "word_frequency"), (1, 1, "max_sdl")], "doc_id long, sent_idx int, type string")
    assert sorted((r["sent_idx"], r["type"]) for r in rewrite.without_enumerated(s).collect()) == [(0, "enumeration"), (0, "word_frequency"), (1, "max_sdl")]
