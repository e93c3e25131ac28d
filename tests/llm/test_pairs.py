"""Defects of pairs, endings, field limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from leesmaat.llm import endings, langid, pairs, truncation

NL = "De gemeente stuurt u een brief over de nieuwe regels voor het afval in uw straat en wijk. "
EN = "The council sends you a letter about the new rules for the waste in your street and area. "
DE = "Die Gemeinde schickt Ihnen einen Brief über die neuen Regeln für den Müll in Ihrer Straße. "
FR = "La mairie vous envoie une lettre sur les nouvelles règles pour les déchets dans votre rue. "


def model():
    return langid.fit([(k, t) for k, t in (("nl", NL), ("en", EN), ("de", DE), ("fr", FR)) for _ in range(3)])


def test_language():
    m = model()
    assert m.language("De straat is nu weer open voor de auto.") == "nl"
    assert m.language("The street is now open for the cars.") == "en"
    assert m.language("ok") is None
    assert abs(m.posterior(NL).sum() - 1) < 1e-9
    assert [langid.code(x) for x in ("nl-NL", "NL", "dut", "", None)] == ["nl", "nl", "nl", None, None]


def test_a_wrong_label_is_outvoted():
    rows = [(k, t) for k, t in (("nl", NL * 3), ("en", EN * 3)) for _ in range(10)] + [("nl", EN * 3)]
    assert langid.fit(rows).language("The council sends a letter.") == "en"


ROWS = [
    ("1", "De man loopt over de straat.", None, "empty"), ("2", "De man loopt over de straat.", " — ", "empty"), ("3", "De man loopt over de straat.", "N/A", "empty"), ("4", "De man loopt over de straat.", "​", "empty"),
    ("5", "De man loopt over de straat.", "Sorry, hier kan ik niet mee helpen.", "refusal"), ("6", "De man loopt over de straat.", "I'm sorry, but I can't assist with that.", "refusal"), ("7", "Helaas kunnen wij u hier niet mee helpen.", "Wij kunnen u helaas niet helpen met dit.", None),
    ("7b", "Helaas kunnen wij u hier niet mee helpen.", "Ik kan aan dit verzoek helaas niet voldoen.", "refusal"), ("7c", "De man loopt.", "Ik heb te weinig informatie om iets te geven.", "refusal"), ("8", "De man loopt, over de straat.", "antwoord: de man loopt over de straat", "copy"), ("9", "De man loopt over de straat.", "De man loopt over de weg.", None),
    ("10", NL, EN, "wrong_language"), ("11", NL, "De gemeente stuurt een brief. Daarin staan de nieuwe reg", "truncated"), ("12", NL, "De gemeente stuurt:\n- een brief\n- een kaart", None), ("13", "Met vriendelijke groet, Noor", "Hartelijk dank. Met vriendelijke groet, Noor", None),
    ("14", None, "Een gewone zin over het weer.", None), ("15", "De man loopt.", "De gemeente zegt: “Kom naar het", "truncated"),
]


def test_defects(spark):
    more = [(f"m{k}", NL, f"De vrouw koopt:\n- een {a}\n- een {b}\n- een {c}", None) for k, (a, b, c) in enumerate([("brief", "kaart", "pas"), ("kaart", "brief", "pas")])]
    df = spark.createDataFrame([r[:3] for r in ROWS + more], "id string, o string, a string").withColumn("defect", F.lit("x"))
    got = {r["key"]: r["defect"] for r in pairs.all_defects(df, "id", "o", ["a"], model()).collect()}
    assert {k: got.get(k) for k, *_ in ROWS} == {r[0]: r[3] for r in ROWS}
    assert pairs.all_defects(df.filter("false"), "id", "o", ["a"], model()).count() == 0


def test_endings():
    assert endings.ending("Een hele zin.")[0] == "whole"
    assert endings.ending('{"a": "b"}')[0] == "whole" and endings.ending('{"a": "b')[0] == "cut"
    assert endings.ending("<think>nog bezig")[0] == "cut"
    assert endings.ending("Een halve")[0] == "cut" and endings.ending("GEEN")[0] == "whole"
    assert endings.ending("Hij zegt: “Kom.")[0] == "cut" and endings.ending("Het kost ca.")[0] == "mark"
    assert endings.ending("WOORD: a\nREDEN: b")[0] == "line" and endings.ending("- een\n- twee")[0] == "line"


def test_limits_stand_out(spark):
    rows = [(f"r{n}", "p", "m", "x" * (30 + n % 170)) for n in range(1700)] + [(f"c{n}", "p", "m", "y" * 100) for n in range(60)]
    df = spark.createDataFrame(rows, "row_key string, provider string, model string, value string")
    hit = truncation.limits(df, ["provider", "model"], "value").filter("limit").collect()
    assert [r["length"] for r in hit] == [100]
    assert truncation.limits(df.filter("false"), ["provider", "model"], "value").count() == 0


def test_truncated(spark):
    whole = [(f"w{n}", f"De man loopt over de straat nummer {n} en koopt het brood. Dan gaat de vrouw naar huis.") for n in range(30)]
    rows = [*whole, ("c1", "De man loopt over de str"), ("c2", "De man loopt over de..."), ("c3", "De man koopt het brood…"), ("n", None), ("b", "  "), ("g", "geen fouten gevonden")]
    df = spark.createDataFrame(rows, "row_key string, value string").select(F.lit("t").alias("src_table"), "row_key", F.lit("p").alias("provider"), F.lit(None).cast("string").alias("model"), "value", F.lit(None).cast("string").alias("original"))
    got = {r["row_key"] for r in truncation.truncated(df).filter("truncated").collect()}
    assert got == {"c1", "c2"}


def test_a_list_item_is_judged_by_the_share_of_line_ends(spark):
    counts = spark.createDataFrame([("de", 5000, 0, 1, 0), ("kaart", 500, 0, 200, 0), ("boom", 300, 0, 9, 0), ("nieuwe", 800, 0, 0, 0)], "token string, inside long, mark long, line long, block long")
    for times in (1, 10):  # whatever the size of the input
        grown = counts.select("token", *[(F.col(c) * times).alias(c) for c in ("inside", "mark", "line", "block")])
        vals = spark.createDataFrame([(w, f"De man koopt:\n- een brief\n- {w}") for w in ("de", "kaart", "boom", "nieuwe", "verzeker")], "k string, v string")
        got = {r["k"]: r["incomplete"] for r in endings.judged(vals, ["k"], "v", None, grown).collect()}
        assert got == {"de": True, "kaart": False, "boom": False, "nieuwe": True, "verzeker": True}
        lax = {r["k"]: r["incomplete"] for r in endings.judged(vals, ["k"], "v", None, grown, rare=0.05).collect()}
        assert lax == got | {"boom": True}


def test_a_limit_does_not_hide_another(spark):
    rows = [(f"r{n}", "p", "m", "x" * (30 + n % 170)) for n in range(1700)] + [(f"c{n}", "p", "m", "y" * (100 if n % 25 else 112)) for n in range(1000)]
    df = spark.createDataFrame(rows, "row_key string, provider string, model string, value string")
    got = truncation.limits(df, ["provider", "model"], "value")
    assert [r["length"] for r in got.filter("limit").orderBy("length").collect()] == [100, 112]
    assert got.filter("length = 112").first()["expected"] < 11


def test_a_long_refusal():
    original = "De gemeente stuurt u een brief over de nieuwe regels voor het afval in uw straat en wijk."
    long = "Sorry, hier kan ik niet mee helpen. " + "Mijn makers hebben vastgelegd welke taken bij mij passen, en daar hoort deze vraag niet bij; probeer het gerust nog eens met een ander verzoek, dan kijk ik graag opnieuw wat er mogelijk is. " * 2
    assert len(pairs.bare(long)) > pairs.REFUSAL_WORDS
    known = set(pairs.bare(original))
    assert pairs.refusal(original, long, known, pairs.bare(long))
    assert not pairs.refusal(original, long + original, known, pairs.bare(long + original))


def test_a_short_answer_in_another_language():
    m = langid.fit([(k, t * 20) for k, t in (("nl", NL), ("en", EN), ("de", DE), ("fr", FR)) for _ in range(3)])
    assert pairs.foreign(m.judge(NL), m.judge("The new waste")) and not pairs.foreign(m.judge(NL), m.judge("De wijk"))
    assert not pairs.foreign(m.judge(NL), m.judge("7"))


def test_scripts_with_their_own_closing_marks():
    burmese, khmer = "\u1000\u103b\u103d\u1014\u103a", "\u1781\u17d2\u1789\u17bb\u17c6"
    for word, mark in ((burmese, "\u104b"), (khmer, "\u17d4")):
        assert endings.ending(f"{word}{mark} {word}{mark}")[0] == "whole" and endings.ending(word)[0] == "whole"
        assert endings.ending(f"{word}{mark} {word}")[0] == "cut"
        assert endings.ending(f"{word}{mark}\n- {word}\n- {word}")[0] == "whole"
    assert endings.ending("\u0e01\u0e32\u0e23")[0] == "whole"


def test_many_texts_are_judged_as_each_is():
    import numpy as np

    m = model()
    texts = [NL, "", "  ", "Tel. 06-1", EN + langid.APART, "数", "de", FR * 40, "été"]
    scores, seen = m.judge_all(texts)
    for k, t in enumerate(texts):
        s, n = m.judge(t.replace(langid.APART, " "))
        assert np.allclose(scores[k], s, rtol=1e-3, atol=1e-2) and seen[k] == n
    assert m.judge_all([])[0].shape == (0, 4)


def test_words_named_in_quotation_marks_do_not_tell_the_language():
    known = {"vergunning", "straat"}
    assert pairs.own_words("The word 'vergunning' is rare.", known) == "The word   is rare."
    assert pairs.own_words("The word 'permit' isn't 'straat-'", known) == "The word 'permit' isn't 'straat-'"


def test_each_language_has_its_part_of_the_sample(spark):
    rows = [(k, "nl", NL) for k in range(300)] + [(1000 + k, "DE", DE) for k in range(3)] + [(2000, "fra", FR), (2001, None, EN), (2002, "en", "  "), (2003, " ", EN)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    m = langid.train(df, "lang", "text", "doc_id", sample=60)
    assert m.langs == ["de", "fr", "nl"] and m.language(DE) == "de" and m.language(FR) == "fr"
    assert set(langid.train(df.filter("false"), "lang", "text", "doc_id").langs) == set(langid.COMMON)


def test_the_last_n_gram_tells_an_end(spark):
    counts = spark.createDataFrame(
        [("straat", 900, 300, 0, 0, 310, 0), ("aang", 900, 0, 0, 0, 900, 0), ("noor", 40, 2, 0, 0, 2, 60), ("de", 5000, 0, 0, 0, 0, 1)], "token string, inside long, mark long, line long, block long, dotted long, bare long"
    )
    vals = [("a", "Hij woont in de straat."), ("b", "Dat besluit is aang."), ("c", "Met groet van Noor"), ("d", "Zij gaat naar de"), ("e", "Dat is een nieuwtje."), ("f", "Hij loopt op stra"), ("g", None), ("h", " ")]
    for times in (1, 100):  # whatever the size of the input
        grown = counts.select("token", *[(F.col(c) * times).alias(c) for c in counts.columns[1:]])
        got = {r["k"]: r["incomplete"] for r in endings.judged(spark.createDataFrame(vals, "k string, v string"), ["k"], "v", None, grown).collect()}
        assert got == {"a": False, "b": True, "c": False, "d": True, "e": False, "f": True}


def test_hazards_and_signals(spark):
    rng_lengths = [40 + (7 * n) % 90 for n in range(3000)]
    whole = [("r%d" % n, ("De man loopt. " * 12)[: k - 1].rstrip() + ".") for n, k in enumerate(rng_lengths)]
    limit = [("c%d" % n, (f"Nummer {n} is een lange zin over het nieuwe afval in onze straat en over de wijk" * 2)[:80]) for n in range(150)]
    rows = [*whole, *limit, ("t", "De man loopt over de str")]
    df = spark.createDataFrame(rows, "row_key string, value string").select(F.lit("t").alias("src_table"), "row_key", F.lit("p").alias("provider"), F.lit(None).cast("string").alias("model"), "value", F.lit(None).cast("string").alias("original"))
    lim = truncation.limits(df, ["src_table", "provider", "model"], "value")
    top = lim.filter("limit").collect()
    assert [r["length"] for r in top] == [80] and abs(top[0]["hazard"] - top[0]["n"] / top[0]["at_risk"]) < 1e-12
    got = {r["row_key"]: r["signal"] for r in truncation.signalled(df).filter("signal is not null").collect()}
    assert got["t"] == "transfer" and sum(v == "limit" for v in got.values()) >= 140 and not [k for k in got if k[0] == "r"]
    assert truncation.signalled(df.filter("false")).count() == 0
