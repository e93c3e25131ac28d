"""Personal information: kinds, places, disguises, what is none."""

from __future__ import annotations

import pytest

from leesmaat.llm import pii


def found(text):
    return [(h.kind, text[h.start : h.end]) for h in pii.detect(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mail jan.de-vries+x@post.voorbeeld.nl.", [("email", "jan.de-vries+x@post.voorbeeld.nl")]),
        ("Mail jan (at) post [punt] test graag", [("email", "jan (at) post [punt] test")]),
        ("Mail jan_x [at] mail [punt] wijk [punt] test, graag", [("email", "jan_x [at] mail [punt] wijk [punt] test")]),
        ("Mail jan @ post.test.", [("email", "jan @ post.test")]),
        ("Bel +31(0)6-00123456 of (020) 093 32 00.", [("phone", "+31(0)6-00123456"), ("phone", "(020) 093 32 00")]),
        ("Bel nul zes een twee drie vier vijf zes zeven acht.", [("phone", "nul zes een twee drie vier vijf zes zeven acht")]),
        ("Mijn BSN is 9992.87.035.", [("identity_number", "9992.87.035")]),
        ("Het rijbewijs heeft documentnummer XWB08M087.", [("identity_number", "XWB08M087")]),
        ("Ik woon op Lange Voorpad 12-2, 1234 AB Dorp.", [("street_address", "Lange Voorpad 12-2")]),
        ("Ik woon op Oude Haven 12 bis te Dorp.", [("street_address", "Oude Haven 12 bis")]),
        ("Hij betaalt. Tel. 06-00123456", [("phone", "06-00123456")]),
        ("De heer J.P. van der Berg schreef.", [("person_name", "J.P. van der Berg")]),
        ("Mevr. Fatima Jansen belde.", [("person_name", "Fatima Jansen")]),
        ("Vraag naar Jansen, Noor.", [("person_name", "Jansen, Noor")]),
        ("Dit is van sjoerd zwartemaat, zei men.", [("person_name", "sjoerd zwartemaat")]),
        ("HET GAAT OM RUBEN DE VRIES (X).", [("person_name", "RUBEN DE VRIES")]),
        ("Mail jаn@post.test", [("email", "jаn@post.test")]),  # a Cyrillic letter in the middle
    ],
)
def test_cases(text, want):
    assert found(text) == want


@pytest.mark.parametrize(
    "text",
    ["Bel 112 alleen bij nood.", "Kijk op www.info3.example/hulp.html.", "Uw zaaknummer is 954127.", "Het boek heeft ISBN 978-0-00-000071-0.", "Betaal met kenmerk 45120597031.", "De factuur met nummer 2083-00381 is betaald.", "De Kerkstraat is 12 dagen dicht.", "De Roos en de Merel staan in deel 9.", "De prijs @ 3 euro geldt nu.", "Artikel 06-12 kost € 10,95.", "Stichting Warme Buurt, balie 97.", "Ik ben te bereiken.", "Om drie vier uur.", "Het register telt 1.240.204.533 regels."],
)
def test_none(text):
    assert found(text) == []


def test_masks_keep_the_rest():
    assert pii.mask("Bel Noor Jansen op 06-00123456, graag!") == "Bel [NAME] op [PHONE], graag!"
    assert pii.mask(None) is None and pii.mask("") == ""


def test_table(spark):
    df = spark.createDataFrame([("1", None, "x"), ("2", "", "x"), ("3", "Mail a@b.test nu. " * 2000, "x"), ("4", "niets", "x")], "row_key string, text string, pii_type string")
    got = pii.find(df, ["row_key"], "text").collect()
    assert {r["row_key"] for r in got} == {"3"} and len(got) == 2000
    assert pii.masked(df, ["row_key"], "text").count() == 4
    assert pii.find(df.filter("false"), ["row_key"], "text").count() == 0


@pytest.mark.parametrize("sign", ["( at )", "[ at ]", "(a)", "{at}", "{ at }", "<at>"])
def test_a_spoken_dot_after_a_bracketed_sign(sign):
    assert found(f"Mail piet {sign} voorbeeld punt nl graag") == [("email", f"piet {sign} voorbeeld punt nl")]
    assert found("Bij vraag (a) eerste punt is dit goed") == []
