"""Proposals of models: links, lists, variants, inflection, attached marks, affected words."""

from __future__ import annotations

from pyspark.sql import functions as F

from leesmaat.operators import editor, punctuation, syntax, validation
from tests.test_syntax import EXAMPLE, tokens


def test_links(spark):
    rows = [
        ("reden", "De bus ging kapot. Wij lopen.", "Wij lopen omdat de bus kapotging.", None), ("opsomming", "A b.", "A b.", "weak relation"), (None, "A b.", "A b.", "weak relation"),
        ("gevolg", "Hij is ziek. Hij komt niet met een fiets.", "Hij is ziek, dus hij komt met geen fiets.", None), ("gevolg", "Hij is ziek. Hij blijft.", "Hij is ziek, dus de dokter komt.", "adds content"), ("reden", "A.", None, "nothing proposed"),
    ]
    df = spark.createDataFrame(rows, "rel string, o string, r string, want string")
    assert all(r[0] == r[1] for r in df.select(validation.link_failure(F.col("rel"), F.col("o"), F.col("r")), "want").collect())


def test_lists(spark):
    content = 'INLEIDING: "Neem mee"\nITEM: - een geldig paspoort\nITEM: een foto\n---\nITEM: het formulier\nUITLEG: korter'
    p = spark.createDataFrame([(content,), ("niets",), (None,)], "c string").select(validation.parse_list(F.col("c")).alias("p")).collect()
    assert p[0]["p"]["intro"] == "Neem mee" and p[0]["p"]["items"] == ["een geldig paspoort", "een foto", "het formulier"] and p[0]["p"]["explanation"] == "korter"
    assert p[1]["p"]["items"] == [] and p[1]["p"]["intro"] is None
    rows = [("Neem een paspoort, foto en formulier mee.", "Neem mee", ["paspoort", "een foto", "formulier"], None), ("Neem een foto mee.", "Neem", ["een foto", "een vis", "foto"], "invented item"), ("x", None, ["a"], "no introduction"), ("x", "y", ["a"], "too few items"), ("x", "y", None, "too few items")]
    df = spark.createDataFrame(rows, "o string, intro string, items array<string>, want string")
    assert all(r[0] == r[1] for r in df.select(validation.list_failure(F.col("o"), F.col("intro"), F.col("items")), "want").collect())
    assert df.select(validation.list_text(F.col("intro"), F.col("items"))).first()[0] == "Neem mee:\n- paspoort\n- een foto\n- formulier"


def test_variants(spark):
    rows = [
        ("1", "Een zin.", {"VOLLEDIG": "Iets nieuws.", "BEHOUDEND": "Iets anders."}), ("2", "Een zin.", {"VOLLEDIG": "Nieuw ding.", "BEHOUDEND": "nieuw  ding."}), ("3", "Een zin.", {"HERSCHRIJVING": '"Nieuw."'}),
        ("4", "Een zin.", {"VOLLEDIG": "een zin", "BEHOUDEND": "Anders."}), ("5", "Een zin.", {"VOLLEDIG": ""}), ("6", "Een zin.", {}),
    ]
    df = spark.createDataFrame(rows, "job string, sentence string, fields map<string,string>")
    got = {}
    for r in validation.variants(df).collect():
        got.setdefault(r["job"], []).append((r["key"], r["text"], r["primary"]))
    assert {k: sorted(v) for k, v in got.items()} == {"1": [("conservative", "Iets anders.", False), ("full", "Iets nieuws.", True)], "2": [("full", "Nieuw ding.", True)], "3": [("full", "Nieuw.", True)], "4": [("conservative", "Anders.", True)]}


def test_judge(spark):
    df = spark.createDataFrame([("OORDEEL: FOUT", False), ("Oordeel: **fout**", False), ("OORDEEL: GOED", True), (None, True)], "c string, want boolean")
    assert all(r[0] == r[1] for r in df.select(validation.keeps_swap(F.col("c")), "want").collect())


def test_inflection(spark):
    bad = [("buitenlandse", "ADJ", "ADJ|prenom|basis|met-e", "amod", 1), ("bezit", "NOUN", "N|soort|ev|basis|onz|stan", "root", 1)]
    good = [("het", "DET", "LID|bep|stan|evon", "det", 2), *[(t, p, g, d, h + 1) for t, p, g, d, h in bad]]
    got = validation.wrong_inflection(tokens(spark, [bad, good])).collect()
    assert [(r["sent_idx"], r["pair"]) for r in got] == [(0, "buitenlandse bezit")]


def test_attached_marks(spark):
    rows = [("uitslag", False, False), ("(", True, False), ("en", False, False), (")", True, False), (".", True, True), ("-", True, True), ("“", True, False), ("ja", False, False), ("”", True, True)]
    df = spark.createDataFrame([(1, 0, k, *r) for k, r in enumerate(rows)], "doc_id long, block_idx int, i int, text string, is_punct boolean, space_after boolean")
    got = {r["i"]: (r["leading"], r["trailing"], r["standalone"]) for r in punctuation.attach(df).collect()}
    assert got[0] == (None, None, None) and got[2] == ("(", ").", None) and got[5] == (None, None, "-") and got[7] == ("“", "”", None) and got[1] == (None, None, None)


def test_affected_words():
    assert editor.affected("De kat zit hier".split(), "De hond zit hier".split()) == [1]
    assert editor.affected("Nu gaat hij naar huis".split(), "Hij gaat nu naar school".split()) == [4]
    assert editor.affected("a b".split(), "b a".split()) != []
    assert editor.split_points("Een zin. Nog een. En meer".split(), 2) == [1] and editor.split_points([], 3) == []


def test_subtree_texts(spark):
    got = syntax.subtree_texts(tokens(spark, [EXAMPLE]), F.col("dep").isin("amod", "nmod")).collect()
    assert {r["span"] for r in got} == {"sfeervolle", "van de stad"}
