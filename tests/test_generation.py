"""The generation pass with a scripted model, exact rows; guards, merges, metrics."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from leesmaat.api import Readability
from leesmaat.operators import generation, rewrite, validation
from leesmaat.sources.lexicons import Lexicons, derived

SLOW = "De gemeente onderzoekt momenteel uitgebreid de klachten van bewoners over het vervoer."
TEXT = SLOW + " De man loopt over de straatt naar het huis. De vrouw koopt snel een brood bij de bakker."


class Scripted:
    """Answers by what the prompt asks for."""

    model = "scripted"

    def complete(self, system: str, user: str, max_tokens: int) -> str:
        assert "leesbaar" in system
        if user.startswith("Noem spelfouten"):
            n = re.search(r"(\d+)\. [^\n]*\bkoopt snel\b", user)
            return f"ZIN_NUMMER: {n[1]}\nWOORD: brood\nVERBETERING: broood\n---\nZIN_NUMMER: 99\nWOORD: man\nVERBETERING: mam" if n else "GEEN_FOUTEN"
        if user.startswith("Noem voor elk"):
            blocks = []
            for n, word, sentence in re.findall(r'(\d+)\. WOORD: "([^"]+)"\n   ZIN: ([^\n]+)', user):
                blocks.append(f"NUMMER: {n}\nVERVANGING: huis\nHERSCHRIJVING: {re.sub(word, 'huis', sentence, flags=re.I)}\nUITLEG: bekender")
            return "\n---\n".join([*blocks, "NUMMER: 99\nHERSCHRIJVING: x"])
        if user.startswith("Herschrijf"):
            sentence = user.split("ZIN: ")[1].split("\n")[0]
            return f"BEHOUDEND: {sentence.replace('de', 'het', 1)}\nVOLLEDIG: {sentence} Hij ziet het huis.\nUITLEG: korter"
        if user.startswith("Voeg twee"):
            m = re.search(r"(\d+)\. (De man[^|]*?) \. \|\| (De vrouw.*)", user)
            return f"NA_ZIN: {m[1]}\nRELATIE: Reden\nHERSCHRIJVING: {m[2]}, want {m[3].replace('De', 'de', 1)}\nUITLEG: verband" if m else "GEEN"
        return "OORDEEL: FOUT"


def lexicons(spark):
    words = "de man loopt over straat naar het huis vrouw koopt snel een brood bij bakker gemeente klachten van bewoners vervoer hij ziet want".split()
    f = spark.createDataFrame([(w, 5.0) for w in words], "word string, word_count double")
    d = derived(f)
    return Lexicons(nouns=d.nouns, frequency=f, skiplist=d.skiplist.filter("false"), manner=d.manner, units=d.units, dictionary=f.select("word").union(spark.createDataFrame([("onderzoekt",), ("momenteel",), ("uitgebreid",)], "word string")))


def analysis(spark):
    return Readability(lexicons(spark)).analyze(spark.createDataFrame([(1, TEXT), (2, None), (3, "Kort.")], "doc_id long, text string"))


def test_the_whole_pass(spark):
    got = [r.asDict(recursive=True) for r in generation.generate(analysis(spark), Scripted, cap=20).collect()]
    by = lambda t: sorted((r for r in got if r["type"] == t), key=lambda r: (r["sent_idx"], r["i"] or 0))
    spelled = [("straatt", "straat", "De man loopt over de straat naar het huis .", "dictionary"), ("brood", "broood", "De vrouw koopt snel een broood bij de bakker .", "scripted")]
    assert [(r["word"], r["replacement"], r["suggested"], r["model"]) for r in by("spelling")] == spelled
    words = by("word_frequency")
    assert [r["word"] for r in words] and all(r["replacement"] == "huis" and r["word"] not in r["suggested"] for r in words)
    assert [(r["sent_idx"], r["second"], r["relation"], r["suggested"]) for r in by("connective")] == [(1, 2, "reden", "De man loopt over de straatt naar het huis, want de vrouw koopt snel een brood bij de bakker .")]
    assert len({r["id"] for r in got}) == len(got) and {r["doc_id"] for r in got} == {1}


def test_judge_and_variants(spark):
    a = analysis(spark)
    s = generation.suggestions(spark.createDataFrame([(1, "word_frequency", 0, "w", "r", "x"), (1, "word_frequency", 1, "v", None, "y"), (1, "passive", 1, None, None, "z")], "doc_id long, type string, sent_idx int, word string, replacement string, suggested string"))
    assert sorted(r["suggested"] for r in generation.judged_swaps(s, Scripted).collect()) == ["y", "z"]
    ask = [(f"j{k}", 1, k, types, "De man loopt naar het huis.", c, "m") for k, (types, c) in enumerate([(["passive"], "BEHOUDEND: De man loopt over straat.\nVOLLEDIG: De man loopt. Hij ziet het huis."), (["passive", "max_sdl"], "HERSCHRIJVING: De man ziet het huis."), (["passive"], "VOLLEDIG: De man loopt naar het huis."), (["passive"], None), (["passive"], "VOLLEDIG: De man loopt naar het hiusje.")])]
    answers = spark.createDataFrame(ask, "job string, doc_id long, sent_idx int, types array<string>, sentence string, content string, model string")
    got = {r["sent_idx"]: (r["type"], r["suggested"], [v["key"] for v in r["variants"] or []]) for r in generation.rewrites(answers, a.lexicons).collect()}
    assert got == {0: ("passive", "De man loopt over straat.", ["conservative", "full"]), 1: ("sentence_rewrite", "De man ziet het huis.", [])}


def test_backstop(spark):
    rows = [("a", "De man loopt.", None), ("b", "De man loopt.", "Niet toegepast"), ("c", "De man loopt.", "de man loopt"), ("d", "Hij ziet het huis, maar de man loopt.", "Hij ziet het huis. De man loopt."), ("e", "Zie www.huis.nl voor brood.", "Zie huis voor brood."), ("f", "De man loopt.", "De man loopt snelll."), ("g", "De man loopt.", "De man ziet het huis."), ("h", "De man loopt.", "De Rood loopt.")]
    df = spark.createDataFrame(rows, "k string, o string, r string")
    got = {r["k"]: r["failure"] for r in validation.backstop(df, "k", "o", "r", lexicons(spark), lambda t: t.filter("key = 'g'")).collect()}
    assert got == {"a": "empty", "b": "marker", "c": "noop", "d": "conjunction", "e": "url", "f": "misspelling", "g": "agreement", "h": None}
    assert {r["k"]: r["failure"] for r in validation.backstop(df, "k", "o", "r", lexicons(spark), joins=True).collect()} == {"a": "empty", "b": "marker", "c": None, "d": None, "e": None, "f": "misspelling", "g": None, "h": None}


def test_composed_merges(spark):
    rows = [(1, "l", "connective", 0, "Alles stond stil. Er was een defect.", "Alles stond stil, want er was een defect."), (1, "r", "passive", 0, "Alles stond stil.", "Niets reed meer!"), (1, "w", "word_frequency", 0, "x", "y"), (1, "m", "connective", 3, "A b. C d.", "A b en c d."), (1, "n", "passive", 3, "A b.", "Q.")]
    df = spark.createDataFrame(rows, "doc_id long, id string, type string, sent_idx int, original string, suggested string")
    assert [tuple(r) for r in generation.composed(df).collect()] == [("l", "r", "Niets reed meer, want er was een defect.")]


def test_metrics_of_proposals(spark):
    t = spark.createDataFrame([("a", "De man loopt naar het huis. De vrouw koopt een brood."), ("b", None), ("c", "")], "id string, t string")
    got = generation.metrics(t, "id", "t", lexicons(spark)).collect()
    assert [r["id"] for r in got] == ["a"] and len(got[0]["sdl_values"]) == 2 == len(got[0]["cwpc_values"]) and got[0]["freq_count"] > 0


class Hanging:
    model = "hanging"

    def complete(self, system, user, max_tokens):
        if user == "hang":
            time.sleep(60)
        if user == "bad":
            raise ValueError("no")
        return user


def test_a_hanging_call_is_given_up_and_the_others_are_not(spark):
    df = spark.createDataFrame([("1", "s", "a"), ("2", "s", "hang"), ("3", "s", "bad"), ("4", "s", "b")], "k string, s string, u string").coalesce(1)
    began = time.monotonic()
    got = {r["k"]: (r["content"], r["error"]) for r in rewrite.run_jobs(df, Hanging, "k", "s", "u", deadline=2.0).collect()}
    assert got == {"1": ("a", None), "2": (None, "deadline"), "3": (None, "ValueError: no"), "4": ("b", None)} and time.monotonic() - began < 40


def test_level_constraint(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "l int").select(rewrite.level_constraint(F.col("l")).alias("c"))
    got = [r["c"] for r in df.collect()]
    assert "niveau 1 van 4" in got[0] and "Mik op niveau 1" in got[0] and "Mik op niveau 2" in got[1] and got[2] is None
