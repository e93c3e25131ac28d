"""String expressions, guards, blocks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leesmaat.functions import guards as G
from leesmaat.functions import text as T
from leesmaat.operators import blocks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("line", "like"),
    [("Een zin.", True), ("Een kop", False), ('Hij zei: "Kom."', True), ("Een regel. Met meer", True), ("Kijk op www.voorbeeld.nl", True), ("www.voorbeeld.nl", False), ("Zie:", False), ("", False)],
)
def test_sentence_like(spark, line, like):
    assert one(spark, line, T.ends_like_sentence) is like


def test_normalisation(spark):
    assert one(spark, "„a” ‘b’ «c»", T.straight_quotes) == '"a" "b" "c"'
    assert one(spark, "a  \n\tb", T.collapse) == "a b"
    assert one(spark, "<think>x\ny</think> z", T.strip_thinking) == "z"
    assert one(spark, '1. "Een zin."', T.clean_variant) == "Een zin."
    assert one(spark, "", T.is_fragment) is True and one(spark, "dit zijn vier woorden", T.is_fragment) is False
    assert one(spark, None, T.straight_quotes) is None


def test_replace_first(spark):
    df = spark.createDataFrame([("aba", "a", "x"), ("aba", "z", "x"), ("aba", "", "x")], "t string, o string, n string")
    assert [r[0] for r in df.select(T.replace_first(F.col("t"), F.col("o"), F.col("n"))).collect()] == ["xba", "aba", "aba"]


def test_guards(spark):
    df = spark.createDataFrame(
        [("Een zin.", "een  ZIN!", "noop"), ("Zie www.a.nl.", "Zie daar.", "url"), ("Hij kwam, maar zij niet.", "Hij kwam. Maar zij niet.", "conjunction"), ("Een zin.", "Iets anders.", None), ("Een zin.", " ", "empty"), ("Een zin.", None, "empty")],
        "o string, r string, want string",
    )
    assert all(r[0] == r[1] for r in df.select(G.first_failure(F.col("o"), F.col("r")), "want").collect())
    band = spark.createDataFrame([(2.5, 1.4, True), (2.5, 2.4, False), (3.5, 2.5, True)], "c double, o double, want boolean")  # half to even: 2, 4
    assert all(r[0] == r[1] for r in band.select(G.higher_band(F.col("c"), F.col("o")), "want").collect())
    fam = spark.createDataFrame([("fietsen", "fietser", True), ("fiets", "auto", False), ("werk", "werken", False)], "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in fam.select(G.same_family(F.col("a"), F.col("b")), "want").collect())


def test_blocks(spark):
    text = "\n\nKop\n\n\nEen zin.\nNog een zin.\n\n"
    df = spark.createDataFrame([(1, text, 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, n long")
    rows = [tuple(r) for r in blocks.blocks(df).orderBy("doc_id", "block_idx").collect()]
    assert rows == [(1, 0, "heading", "Kop"), (1, 1, "blank", ""), (1, 2, "prose", "Een zin."), (1, 3, "prose", "Nog een zin.")]


def test_unwrap(spark):
    wrapped = "De man loopt over de brug en kijkt naar het wa-\nter dat onder hem\ndoor stroomt naar\nde zee.\n\n\nNog een alinea."
    df = spark.createDataFrame([(1, wrapped), (2, "Een zin.\nNog een.")], "doc_id long, text string")
    words = spark.createDataFrame([("water",)], "word string")
    out = {r[0]: r[1] for r in blocks.unwrap(df, words).collect()}
    assert out[1] == "De man loopt over de brug en kijkt naar het water dat onder hem door stroomt naar de zee.\n\n\nNog een alinea."
    assert out[2] == "Een zin.\nNog een."
    kept = {r[0]: r[1] for r in blocks.unwrap(df, None).collect()}
    assert "wa-ter" in kept[1]


def test_markdown():
    text = "# Kop\n\nEen **vette** zin.\nVervolg.\n\n**Tussenkop**\n\n- een\n- twee\n  vervolg\n\n3. drie\n\n> citaat\n> meer\n\n```\ncode\n```\n"
    got = [b[:2] for b in blocks.markdown_blocks(text) if b[0] != "blank"]
    assert got == [("heading", "Kop"), ("prose", "Een vette zin. Vervolg."), ("heading", "Tussenkop"), ("list_item", "een"), ("list_item", "twee vervolg"), ("list_item", "drie"), ("quote", "citaat meer")]
    assert [b for b in blocks.markdown_blocks(text) if b[0] == "list_item"] == [("list_item", "een", False, 1), ("list_item", "twee vervolg", False, 2), ("list_item", "drie", True, 1)]
    assert blocks.markdown_blocks(None) == blocks.markdown_blocks("") == blocks.markdown_blocks("\n\n") == []


def test_short_sentences_join_the_next_and_never_chain(spark):
    df = spark.createDataFrame(
        [(1, 0, [("Nr. 3", 2, False), ("staat hier.", 2, True), ("Kort", 1, False), ("Ook", 1, False), ("Een lange zin hier.", 4, True)])],
        "doc_id long, block_idx int, s array<struct<text string, words int, closed boolean>>",
    )
    assert blocks.merge_short(df).first()["sentences"] == ["Nr. 3 staat hier.", "Kort Ook", "Een lange zin hier."]
