"""Decisions with links and lists, texts after edits, levels, what is shown."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from leesmaat.functions import score as S
from leesmaat.operators import editing, editor, structure


def test_of_equal_alignments_the_last_places_stay():
    assert editor.word_diff("a b a".split(), ["a"]) == [(0, 2, 0, 0)] and editor.affected("a b a".split(), ["a"]) == [0, 1]
    assert editor.word_diff(["a"], "a b a".split()) == [(0, 0, 0, 2)]


def lcs(a, b):
    if not a or not b:
        return 0
    return lcs(a[1:], b[1:]) + 1 if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))


def test_kept_words_are_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(150):
        a, b = [rng.choices("abc", k=rng.randint(0, 7)) for _ in range(2)]
        assert len(editor.anchors(a, b)) == lcs(a, b)


def states(rows):
    log = pd.DataFrame(rows, columns=["doc_id", "seq", "id", "sent_idx", "cluster", "type", "second", "action"])
    return dict(editor.decide(log)[["id", "state"]].to_numpy().tolist())


BASE = [(1, 0, "c", 0, "c", "connective", 1, "propose"), (1, 0, "r", 0, "r", "passive", None, "propose"), (1, 0, "w", 0, "w", "word_frequency", None, "propose"), (1, 0, "e", 0, "e", "enumeration", None, "propose"), (1, 0, "s", 1, "s", "max_sdl", None, "propose"), (1, 0, "x", 2, "x", "passive", None, "propose")]


def test_links_and_lists_in_decisions():
    act = lambda *moves: states(BASE + [(1, n, i, *next(b[3:7] for b in BASE if b[2] == i), a) for n, (i, a) in enumerate(moves, 1)])
    assert act(("c", "accept")) == {"c": "accepted", "r": "pending", "w": "ignored", "e": "ignored", "s": "ignored", "x": "pending"}
    assert act(("r", "accept"), ("c", "accept"))["r"] == "accepted"  # a link carries a rewrite of its first sentence
    assert act(("s", "accept"))["c"] == "ignored" and act(("w", "accept"))["c"] == "ignored"
    assert act(("w", "accept"))["e"] == "pending" and act(("w", "accept"), ("e", "accept"))["w"] == "ignored"
    assert act(("w", "accept"), ("r", "accept"))["w"] == "ignored"  # an accepted word change gives way to a rewrite
    assert act(("c", "accept"), ("c", "undo")) == dict.fromkeys("crwesx", "pending")


def test_variants(spark):
    v = [("conservative", "c", "voorzichtig"), ("full", "f", "ruim")]
    df = spark.createDataFrame([("a", "ruim", v), ("b", "ruim", v), ("d", "eigen", v[:1]), ("e", "eigen", None), ("g", "ruim", v)], "id string, suggested string, variants array<struct<key string,label string,text string>>")
    picks = spark.createDataFrame([("b", "full"), ("g", "onbekend")], "id string, key string")
    assert {r["id"]: r["suggested"] for r in editing.chosen(df, picks).collect()} == {"a": "voorzichtig", "b": "ruim", "d": "eigen", "e": "eigen", "g": "voorzichtig"}


SENTENCES = [(1, 0, "De oude man koopt snel een brood."), (1, 1, "Hij eet het op."), (1, 2, "Wij kopen melk, kaas en ham."), (1, 3, "Slot."), (2, 0, "Alleen.")]


def tables(spark, accepted):
    s = spark.createDataFrame(SENTENCES, "doc_id long, sent_idx int, sentence string")
    a = spark.createDataFrame(accepted, "doc_id long, sent_idx int, second int, id string, type string, original string, suggested string, list_intro string, list_items array<string>")
    return s, a


def test_sentences_with_edits(spark):
    s, a = tables(spark, [(1, 0, None, "b", "word_frequency", None, "De oude man koopt vlug een brood.", None, None), (1, 0, None, "a", "spelling", None, "De bejaarde man koopt snel een brood.", None, None), (1, 1, None, "z", "passive", None, None, None, None)])
    got = {(r["doc_id"], r["sent_idx"]): r["text"] for r in editing.current_sentences(s, a).collect()}
    assert got[1, 0] == "De bejaarde man koopt vlug een brood." and got[1, 1] == "Hij eet het op." and len(got) == 5


def test_spans_after_other_edits(spark):
    s = spark.createDataFrame([(1, 0, "a b c d e f")], "doc_id long, sent_idx int, sentence string")
    rows = [(1, 0, "x", "a b c D2 e f", "pending"), (1, 0, "y", "a b1 b2 b3 c d e f", "accepted"), (1, 0, "z", "a b c d e", "accepted")]
    df = spark.createDataFrame(rows, "doc_id long, sent_idx int, id string, suggested string, state string")
    assert {r["id"]: (r["start"], r["end"]) for r in editing.current_spans(s, df).collect()} == {"x": (5, 6), "y": (1, 2), "z": (7, 8)}


def test_documents_with_edits(spark):
    link = (1, 0, 1, "l", "connective", "De oude man koopt snel een brood. Hij eet het op.", "De oude man koopt snel een brood, want hij eet het op.", None, None)
    rewrite = (1, 0, None, "r", "passive", "De oude man koopt snel een brood.", "Een man haalt brood.", None, None)
    en = (1, 2, None, "e", "enumeration", SENTENCES[2][2], "Wij kopen:\n- melk", "Wij kopen:", ["melk", "kaas", "ham"])
    s, a = tables(spark, [link, rewrite, en])
    layout = spark.createDataFrame(
        [(1, 0, 0, "heading", "Kop", None, None, None), (1, 1, 0, "sentence", "", None, None, [0]), (1, 1, 1, "sentence", "", None, None, [1]), (1, 2, 0, "blank", "", None, None, None), (1, 3, 0, "sentence", "", None, None, [2]), (1, 4, 0, "list_item", "", True, 2, [3]), (1, 5, 0, "quote", "Woord", None, None, None), (2, 0, 0, "sentence", "", None, None, [0])],
        "doc_id long, block_idx int, part int, type string, text string, ordered boolean, number int, sentences array<int>",
    )
    got = {r["doc_id"]: r["text"] for r in editing.edited_documents(layout, s, a).collect()}
    assert got == {1: "Kop\nEen man haalt brood, want hij eet het op.\n\nWij kopen:\n- melk\n- kaas\n- ham\n2. Slot.\n> Woord", 2: "Alleen."}
    m = editing.merges(a, s).first()
    assert m["before"] == "Een man haalt brood. Hij eet het op." and [tuple(r) for r in editing.absorbed(a).collect()] == [(1, 1)]
    plain = {r["doc_id"]: r["text"] for r in editing.edited_documents(layout, s, a.filter("false")).collect()}
    assert plain[1] == "Kop\nDe oude man koopt snel een brood. Hij eet het op.\n\nWij kopen melk, kaas en ham.\n2. Slot.\n> Woord"
    assert editing.edited_documents(layout.filter("false"), s, a).count() == 0


def test_levels_of_parts(spark):
    cols = "doc_id long, sent_idx int, freq_sum double, freq_count int, sdl_values array<double>, cwpc_values array<double>, concrete int, abstract int, undefined int, score double"
    df = spark.createDataFrame([(1, 0, 10.4, 2, [3.0, 8.0], [4.5, 9.0], 6, 4, 0, 50.0), (1, 1, 0.0, 0, [3.0], [4.5], 1, 0, 0, 47.0), (1, 2, 5.0, 1, [], [], 1, 0, 0, None)], cols)
    one = lambda s, c: df.select(S.difficulty(F.lit(5.2), F.lit(s), F.lit(c), F.lit(0.6)).alias("x")).first()["x"]
    got = {(r["sent_idx"], r["part"]): (None if r["score"] is None else round(r["score"], 6), r["level"]) for r in editing.levels(df).collect()}
    assert got == {(0, 0): (21.020446, 1), (0, 1): (round(one(8.0, 9.0), 6), got[0, 1][1]), (1, 0): (47.0, 3), (2, 0): (None, None)}
    mean = {r["sent_idx"]: r["score"] for r in editing.mean_level(df).collect()}
    assert abs(mean[0] - one(5.5, 6.75)) < 1e-9 and mean[1] == 47.0 and mean[2] is None


def test_shown(spark):
    t = spark.createDataFrame([(1, 0, 0, "Hij", False, None, ",", None), (1, 0, 1, ",", True, None, None, None), (1, 0, 2, "ja", False, "(", ")", None), (1, 0, 3, "–", True, None, None, "–"), (1, 0, 4, "zo", False, None, ".", None)], "doc_id long, sent_idx int, i int, text string, is_punct boolean, leading string, trailing string, standalone string")
    assert editing.reconstructed(t).first()["text"] == "Hij,(ja) – zo."
    assert [(r["i"], r["place"]) for r in editing.word_places(t).orderBy("i").collect()] == [(0, 0), (2, 1), (3, 2), (4, 3)]
    d = spark.createDataFrame([(1, "density", 4, 2), (1, "frequency", 8, 6)], "doc_id long, dimension string, total long, remaining long")
    assert [(r["dimension"], r["share"]) for r in editing.summary_bars(d).orderBy("rank").collect()] == [("frequency", 75.0), ("density", 25.0)]
    s = spark.createDataFrame([(12.34,), (None,)], "x double")
    assert [r[0] for r in s.select(editing.shown_score(F.col("x"))).collect()] == ["12.3", "–"]
    assert structure.SHORT == 2


def test_only_the_fields_of_a_template_are_fields():
    from leesmaat.operators import rewrite

    text = "HERSCHRIJVING: Een zin.\nUITLEG: korter\nLET OP: dit hoort erbij"
    assert rewrite.parse_fields(text, rewrite.FIELDS["sentence_rewrite"]) == {"HERSCHRIJVING": "Een zin.", "UITLEG": "korter LET OP: dit hoort erbij"}


def test_written_tables_can_be_released(spark):
    import os

    from leesmaat import workspace

    since = workspace.mark(spark)
    t = workspace.cut(spark.range(3), "x")
    path = t.inputFiles()[0].removeprefix("file://")
    assert t.count() == 3 and workspace.mark(spark) == since + 1
    assert workspace.release(spark, since) == 1 and not os.path.exists(path) and workspace.mark(spark) == since
