"""Units of texts in many scripts; chunks give what whole texts give."""

from __future__ import annotations

import random

import pytest

from leesmaat.llm import sentences as S


def cut(text):
    u = S.units(text)
    return [text[a:b].strip() for a, b in zip(u, [*u[1:], len(text)], strict=True)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dit is een zin. Dit ook.", ["Dit is een zin.", "Dit ook."]),
        ("Het kost ca. € 50,50 bij dhr. De Vries. Klaar!", ["Het kost ca. € 50,50 bij dhr. De Vries.", "Klaar!"]),
        ("Zie o.a. de afd. Zorg enz. De rest volgt.", ["Zie o.a. de afd. Zorg enz.", "De rest volgt."]),
        ("J.P. de Vries kwam om 8.30 uur. 's Avonds ging hij.", ["J.P. de Vries kwam om 8.30 uur.", "'s Avonds ging hij."]),
        ('Hij zegt: "Kom. Ga zitten." Zij zit.', ['Hij zegt: "Kom. Ga zitten."', "Zij zit."]),
        ("„Kom. Ga.”, zegt hij nu. Zij zit.", ["„Kom. Ga.”, zegt hij nu.", "Zij zit."]),
        ("Hij vroeg: ‘Kom je? Nu?’ en ging weg. Zij zit.", ["Hij vroeg: ‘Kom je? Nu?’ en ging weg.", "Zij zit."]),
        ("Kop\n\nEen zin\nover twee regels. Nog een.", ["Kop", "Een zin\nover twee regels.", "Nog een."]),
        ("# Kop\nTekst. Meer:\n- een. Twee\n- drie\n\nSlot.", ["# Kop", "Tekst.", "Meer:", "- een. Twee", "- drie", "Slot."]),
        ("Geen spatie.Toch twee zinnen.", ["Geen spatie.", "Toch twee zinnen."]),
        ("Mail jan@voorbeeld.nl of kijk op www.x.nl. Dag.", ["Mail jan@voorbeeld.nl of kijk op www.x.nl.", "Dag."]),
        ("La mairie dit: « Venez. Vite. » Le maire sort.", ["La mairie dit: « Venez. Vite. »", "Le maire sort."]),
        ("Das Amt öffnet nach dem 3. Mai. Der Bäcker sagt: „Gut. Ja.“ Er geht.", ["Das Amt öffnet nach dem 3. Mai.", "Der Bäcker sagt: „Gut. Ja.“", "Er geht."]),
        ("今天很好。明天呢？好！", ["今天很好。", "明天呢？", "好！"]),
        ("「行きます。また。」と彼は言いました。次です。", ["「行きます。また。」と彼は言いました。", "次です。"]),
        ("यह एक वाक्य है। यह दूसरा है।", ["यह एक वाक्य है।", "यह दूसरा है।"]),
        ("هل هذا سؤال؟ نعم. شكرا.", ["هل هذا سؤال؟", "نعم.", "شكرا."]),
        ("ครูอ่านหนังสือ หมอตรวจบัตร", ["ครูอ่านหนังสือ", "หมอตรวจบัตร"]),
        ('Een "open aanhaling. Nooit dicht. Ja.', ['Een "open aanhaling.', "Nooit dicht.", "Ja."]),
        ("Wat?! Echt... Ja… Nee.", ["Wat?!", "Echt...", "Ja…", "Nee."]),
    ],
)
def test_units(text, want):
    assert cut(text) == want


def test_blank_texts_have_none():
    assert S.units(None) == S.units("") == S.units(" \n\t ") == []


PIECES = ["Een zin. ", "Zegt hij: “Ja. Nee.” ", "Kop\n\n", "- punt\n", "ca. 3.5 uur ", "“Open. ", "‘Ja. Nee.’, zei zij. ", "村の。", "\n", "Wat? ", "# H\n"]


def test_chunks_compose_to_the_whole():
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60)))
        if not text.strip():
            continue
        size = rng.choice([5, 40, 120])
        functions = []
        for lo in range(0, len(text), size):
            functions.append(S.function(S.lex(text, lo, min(len(text), lo + size))))
        whole = S.scan(functions)[S.TEXT]
        assert sorted(set(whole.sure + whole.pending)) == S.units(text)


def test_long_documents_in_spark(spark):
    text = "Een zin over iets. Hij zegt: “Ja. Nee.” Dan weer verder.\n\n" * 300
    df = spark.createDataFrame([("a", text, 1), ("b", None, 1), ("c", "Kort. Twee.", 1), ("c", "Kort. Twee.", 1)], "id string, text string, start_pos int")
    got = [(r["id"], r["start_pos"]) for r in S.sentence_starts(df, ["id"], "text", long=1000).collect()]
    assert sorted(p for i, p in got if i == "a") == S.units(text)
    assert sorted(p for i, p in got if i == "c") == [0, 0, 6, 6]
    assert S.sentence_starts(df.filter("false"), ["id"], "text").count() == 0


def test_chunks_see_only_what_the_distributed_form_shows_them():
    rng = random.Random(5)
    item = "een punt over het afval in de straat en de wijk zonder een teken aan het eind van de regel " * 10
    listed = "".join(f"- {item.strip()}\n" for _ in range(39))
    quoted = "Hij zegt: “" + "Ja. Nee. " * 400 + "Klaar.” Zij zwijgt. Slot."
    never = "Hij zegt: “" + "Ja. Nee. " * 400 + "\n\nNieuw. Slot."
    heading = "# " + "kop " * 500 + "\nTekst. Meer.\n1. een\n2. twee\n"
    blanks = "Een zin." + " " * 1500 + "Nog een." + "\n" * 1200 + "- punt\n" + "\t" * 900 + "- punt. Ja"
    dots = "Wacht" + "." * 1400 + " Ja. " + "!" * 1300 + "Nee. 今天很好。" * 60
    mixed = ["".join(rng.choice(PIECES + [item[:300], "„Kom. Ga.”, zegt hij. ", "ครู หมอ ", "12. "]) for _ in range(120)) for _ in range(25)]
    for text in [listed, quoted, never, heading, blanks, dots, listed + quoted + heading, *mixed]:
        want = S.units(text)
        for size in (37, 150, 700, 1000, 5000):
            assert S.units_in_chunks(text, size) == want
    assert len(S.units(listed)) == 39


def test_long_lists_in_spark(spark):
    text = "".join(f"- {'een punt zonder teken ' * 40}\n" for _ in range(30)) + "Hij zegt: “" + "Ja. Nee. " * 300
    df = spark.createDataFrame([("a", text), ("b", text), ("b", text)], "id string, text string")
    got = sorted((r["id"], r["start_pos"]) for r in S.sentence_starts(df, ["id"], "text", long=700).collect())
    assert got == sorted((i, p) for i in "abb" for p in S.units(text))
