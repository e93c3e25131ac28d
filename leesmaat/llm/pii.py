"""Problem 1: personal information inside free text, found in disguise and replaced by typed placeholders.

A chain of small transducers rewrites disguises to plain characters (look-alike letters, full-width digits, spelled digits,
"(at)" and "[punt]", blanks around signs) and keeps for every character it writes the span of the source it stands for.
Identifiers are detected in the plain text; their spans are mapped back, so placeholders replace exactly the source
characters and everything else stays as it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leesmaat.llm.common import latest, per_row, spread, table

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁһկԛԝАВЕКМНОРСТХУІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι",
        "aeopcyxijsdhkqwABEKMHOPCTXYIJSABEZHIKMNOPTYXoavi",
        strict=True,
    )
)
# Digits in words.
DIGITS = {
    "nul": "0", "een": "1", "één": "1", "twee": "2", "drie": "3", "vier": "4", "vijf": "5", "zes": "6", "zeven": "7", "acht": "8", "negen": "9",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
# Common given names in Dutch-speaking countries.
GIVEN = frozenset(
    """
    aaliyah abdel abdullah achmed adam adriaan aisha albert alex alice ali amber amina amira amy an andré angela anna anne annelies annemarie annemiek anouk anton
    arend arie arjan arno arthur astrid aylin ayse bart bas bastiaan beatrix ben bente berend bert bianca bilal bo boris bram brigitte bruno carla carlijn carolien cas
    casper cees charlotte chris christiaan claudia cor cornelis daan daniel daphne david dennis diana diederik dirk djamila dylan eelco ellen els elise emma emre eric
    erik esra esther eva evelien evert fatima fatma fedde femke fenna fleur floor floris frank frans fred frederik gerard gerda gerrit gijs greet guus hanna hannah hannie hans
    harm harry hassan heleen hendrik henk herman hilde hugo ibrahim ilse imane ine inge ingrid iris isa isabel ivo jaap jacob jacqueline jan janneke jannie janny jasmijn jasper
    jayden jelle jeroen jesse jet johan johanna johannes jolanda joost joris josé joyce judith julia jurre karel karim karin kees khadija kim klaas kevin koen laura lars
    lena leo leon lieke lies liesbeth lina linda lisa lisanne lise lizzy loes lotte louis luca lucas luuk maaike maarten mandy marc marco margriet maria marieke marijke marijn
    marit marjan mark marleen marloes martijn martin matthijs max mehmet meike melissa menno merel mees mia michael michel mila milan mireille mo mohamed mohammed
    monique mustafa myrthe nadia naomi nathalie niels niek nienke nina noah noa noor nora omar otto pascal patricia paul paula peter petra pien pieter pim puck ralph ramon
    rachid ria rik rob robert robin roel rolf ronald roos rosa rosanne rob ruben ruud saar sabine said samira sander sandra sanne sara sarah saskia selin sem semra siem sien
    simon sjoerd sofia sofie sophie stefan sterre steven stijn suus suzanne sven sylvia tara teun tess tessa thea theo thijs thomas tijmen tim tineke tom toon trudy ton tristan
    truus vera victor vincent wendy wessel willem willemijn wilma wim wouter xander yara yasmin youssef yusuf yvonne zakaria zehra zeynep zoë
    aleksandra agnieszka andrzej anastasia olga ivan svetlana chen wei li ming john mary james emily
    """.split()
)
# Given names that are ordinary words when written small.
ALSO_WORDS = frozenset("ben max mark ton floor an mo li wei bo mees sterre frank tom ria rik thea tess els mila noah roos merel jet bas pim puck guus ming rob".split())
# Particles of surnames.
PARTICLE = r"(?:van|de|der|den|ter|ten|te|tot|het|in|op|aan|uit|uyt|'t|’t|el|al|ben|bin|von|zu|di|da|dos|la|le|du)"
# Forms of address and words that announce a name.
TITLES = r"(?:de heer|dhr\.?|mevrouw|mevr\.?|mw\.?|meneer|mijnheer|dr\.?|drs\.?|ir\.?|ing\.?|mr\.?|prof\.?|familie|fam\.?|aanvrager|aanvraagster|cliënt|patiënt|bewoner|mijn naam is|ik ben|ik heet|genaamd|groet(?:en)?,|hoogachtend,|ter attentie van|t\.a\.v\.)"
# Words after a given name in small letters or capitals that are no surname.
PLAIN = frozenset(
    """
    en of is was wil wilt kan heeft had zal zou moet mag gaat ging komt kwam staat staan stond zit ligt woont werkt krijgt kreeg geeft gaf zegt zei schreef schrijft belde belt
    vraagt vroeg heet doet deed maakt neemt nam koopt ziet zag vindt vond leest speelt loopt liep niet nog ook al wel geen die dat deze dit een het de den der van voor met naar bij
    op aan in uit om te ter ten tot door over onder als dan maar want dus want omdat hoewel toen wie wat waar hoe hij zij ze wij we ik je u uw hun haar zijn mijn ons onze worden wordt werd
    bloeit vliegt zingt groeit bloem bloemen vogel straat boot schip rood roze geel wit zwart blauw groen
    """.split()
)
# Capitalised words that start names of organisations and places, not of people.
ORGANISATION = frozenset("stichting gemeente vereniging dorpshuis buurthuis wijkcentrum bibliotheek ziekenhuis school basisschool college provincie ministerie bureau dienst afdeling bedrijf café restaurant hotel station park huis raad commissie team fonds".split())
STREET = r"(?:straat|laan|weg|plein|singel|hof|pad|kade|gracht|dijk|steeg|plantsoen|dreef|markt|baan|erf|allee|boulevard|wal|haven|park|ring|burg|brink|veld|hoek|kamp|akker|tuin|poort|oever|zoom|hage|gaarde|meent|stede|berg|laantje|straatje|weide|waard|pas|rak|burgwal|vest|bolwerk|kolk|werf)"
STREET_ENDS = tuple(STREET[3:-1].split("|"))
DIGIT = re.compile(r"\d")
BEFORE_NUMBER = re.compile(r"\s+(?=\d)")
POSTCODE = re.compile(r"\d{4}\s?[A-Z]{2}\b")
STREET_FIRST = r"(?:Oude|Nieuwe|Lange|Korte|Hoge|Lage|Grote|Kleine|Eerste|Tweede|Derde|Vierde|Voorste|Achterste|Noord|Zuid|Oost|West|Sint|St\.|Prins|Prinses|Koning|Koningin|Burgemeester|Burg\.|Dokter|Dr\.|Pastoor|Jan|Willem|Maria|Van|De|Het|Ds\.|Mr\.|Graaf|Hertog|Kardinaal|Professor|Prof\.)"


class Hit(NamedTuple):
    kind: str
    start: int
    end: int


class Plain(NamedTuple):
    """Text without disguises; character i stands for source[first[i]:last[i]]. None for both lists: the text as it is."""

    text: str
    first: list[int] | None
    last: list[int] | None

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.first is None else (self.first[start], self.last[end - 1])


def rewrite(plain: Plain, pattern: re.Pattern, replace) -> Plain:
    """One transducer: what `pattern` matches gives way to replace(match), None keeping it; spans are carried along."""
    out, first, last, at = [], [], [], 0
    t = plain.text
    for m in pattern.finditer(t):
        new = replace(m)
        if new is None or m.end() == m.start():
            continue
        a, b = m.span()
        if plain.first is None:
            first += range(at, a)
            last += range(at + 1, a + 1)
            fa, fb = a, b
        else:
            first += plain.first[at:a]
            last += plain.last[at:a]
            fa, fb = plain.first[a], plain.last[b - 1]
        out += (t[at:a], new)
        if len(new) == b - a and b > a:  # letter for letter
            first += range(a, b) if plain.first is None else plain.first[a:b]
            last += range(a + 1, b + 1) if plain.first is None else plain.last[a:b]
        else:
            first += [fa] * len(new)
            last += [fb] * len(new)
        at = b
    if not out:
        return plain
    first += range(at, len(t)) if plain.first is None else plain.first[at:]
    last += range(at + 1, len(t) + 1) if plain.first is None else plain.last[at:]
    return Plain("".join(out) + t[at:], first, last)


MIXED = re.compile(r"\w*[" + "".join(HOMOGLYPHS) + r"]\w*")
LOOKALIKE = re.compile("[" + "".join(HOMOGLYPHS) + "]")
WIDE = re.compile(r"[０-９＠．－＋（）]+")
INVISIBLE = re.compile("(?<=\\w)[\u00ad\u200b-\u200d\u2060\ufeff]+(?=\\w)")
SIGN = re.compile(r"(?<=[\w\]])\s{0,2}(?:\(\s?(?:at|apenstaartje|a)\s?\)|\[\s?(?:at|apenstaartje)\s?\]|\{\s?at\s?\}|<at>|\bapenstaartje\b|\s@\s|@)\s{0,2}(?=\w)|(?<=\w)\s@(?=\w)|(?<=\w)@\s(?=\w)", re.I)
BRACKETED = re.compile(r"[(\[{<]\s?(?:at|a)\b")
SPOKEN_AT = re.compile(r"(?<=\w)\s(?:at|bij)\s(?=[\w-]+\s(?:dot|punt)\s)", re.I)
DOT = re.compile(r"(?<=\w)\s{0,2}(?:\(\s?(?:dot|punt)\s?\)|\[\s?(?:dot|punt)\s?\]|\{\s?(?:dot|punt)\s?\})\s{0,2}(?=\w)", re.I)
SPOKEN_DOT = re.compile(r"(?<=\w)\s(?:dot|punt)\s(?=[a-z]{2,})", re.I)
AT_BEFORE = re.compile(r"(?:@|\bat\b|\bapenstaartje\b)[\s\])}>]{0,4}[\w.\-]*$", re.I)
LETTER_BEFORE = re.compile(r"\(\s?a\s?\)\s{0,2}[\w.\-]*$", re.I)  # also how parts of a sentence are lettered
NO_DOMAIN = re.compile(r"(?:aan|dat|die|door|een|en|gaat|geldt|het|in|is|met|of|om|ook|op|te|uit|van|voor|waar|wat|werd|wordt|zijn)\b", re.I)
SPELLED = re.compile(r"\b(?:" + "|".join(DIGITS) + r")\b(?:[\s,.\-]{1,2}(?:" + "|".join(DIGITS) + r")\b){5,}", re.I)


def _latin(m: re.Match) -> str | None:
    word = m.group()
    letters = [c for c in word if c.isalpha()]
    if not any("a" <= c.lower() <= "z" for c in letters) and not all(c in HOMOGLYPHS for c in letters):
        return None  # a word of its own script
    if not any("a" <= c.lower() <= "z" for c in letters):
        return None
    return "".join(HOMOGLYPHS.get(c, c) for c in word)


def plain(text: str) -> Plain:
    p = Plain(text, None, None)
    if not text.isascii():
        p = rewrite(p, INVISIBLE, lambda m: "")
        if LOOKALIKE.search(p.text):
            p = rewrite(p, MIXED, _latin)
        p = rewrite(p, WIDE, lambda m: "".join(chr(ord(c) - 0xFEE0) for c in m.group()))
    if sum(w in DIGITS for w in LETTERS.findall(p.text.lower())) >= 6:
        p = rewrite(p, SPELLED, lambda m: "".join(DIGITS[w] for w in re.findall(r"[^\W\d_]+", m.group().lower())))
    low = p.text.lower()
    if "punt" in low or "dot" in low:
        p = rewrite(p, SPOKEN_AT, lambda m: "@")
        p = rewrite(p, DOT, lambda m: ".")
        if "@" in p.text or "apenstaart" in low or BRACKETED.search(low):
            p = rewrite(p, SPOKEN_DOT, lambda m: "." if AT_BEFORE.search(p.text[max(0, m.start() - 80) : m.start()]) or not NO_DOMAIN.match(p.text, m.end()) and LETTER_BEFORE.search(p.text[max(0, m.start() - 80) : m.start()]) else None)
    if "@" in p.text or "apenstaart" in low or BRACKETED.search(low):
        p = rewrite(p, SIGN, lambda m: "@")
    return p


EMAIL = re.compile(r"(?<![\w.+%@-])[A-Za-z0-9](?:[\w.+%-]*\w)?@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}|[A-Z0-9](?:[A-Z0-9-]*[A-Z0-9])?(?:\.[A-Z0-9](?:[A-Z0-9-]*[A-Z0-9])?)*\.[A-Z]{2,}(?![a-z])|[A-Za-z0-9](?:[\w-]*\w)?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")
S = r"[\s.\-/]{0,3}"
PHONE = re.compile(
    rf"(?<![\w.,+-])(?:(?:\+|00)[1-9]\d{{0,2}}{S}(?:\(0\){S})?\d(?:{S}\d){{6,10}}|\(0\d{{1,3}}\){S}\d(?:{S}\d){{5,7}}|0[1-9]\d{{0,2}}{S}\d(?:{S}\d){{5,8}}|(?:0{S}6|06){S}\d(?:{S}\d){{7}})(?!\d|[.,-]\d)"
)
NUMBER = re.compile(r"(?<![\w.,+/-])(?:\d{9,10}|\d{4}\.\d{2}\.\d{3}|\d{3}[ .-]\d{3}[ .-]\d{3}|\d{4} \d{2} \d{3}|\d{2}[ .]\d{2}[ .]\d{2}[ .]\d{3})(?!\d|[.,/-]\d)")
DOCUMENT = re.compile(r"(?<![\w-])[A-Z]{2}[A-Z0-9]{6}\d(?![\w-])|(?<![\w-])[a-z]{2}[a-z0-9]{6}\d(?![\w-])")
IDENTITY_CUE = re.compile(r"(?:\bbsn\b|burgerservice|sofi|persoonsnummer|paspoort|rijbewijs|identiteit|\bid-?kaart|\bpas\b|document|ingeschreven|inschrijving|legitimatie)", re.I)
OTHER_CUE = re.compile(r"(?:kenmerk|factuur|zaaknummer|zaak|isbn|bestel|order|rekening|iban|kvk|klantnummer|artikel|polis|dossier|telt|betaal|betaling|tracking|barcode)\w*", re.I)
HOUSE = r"\d{1,5}(?!\d)(?:[-\s]?(?:hs|bis|huis|boven|[IVX]{1,3})(?!\w)|-\d{1,4}(?!\w)|[-\s]?[a-zA-Z](?!\w))?"
STREET_ALONE = "(?:" + "|".join(w.capitalize() for w in STREET_ENDS) + ")"
ADDRESS = re.compile(rf"(?<![\w'’-])(?:{STREET_FIRST}\s+){{1,3}}{STREET_ALONE}\s+{HOUSE}|(?<![\w'’-])(?:(?:{STREET_FIRST}\s+){{0,3}}(?:[A-Z][\w'’.-]*\s+(?:van\s+|de\s+|der\s+|den\s+)*)?)?[A-Z][\w'’-]*?{STREET}\s+{HOUSE}|(?<![\w'’-])(?:{STREET_FIRST}\s+){{1,3}}[A-Z][\w'’-]+\s+{HOUSE}(?=,?\s+(?:in\s+)?\d{{4}}\s?[A-Z]{{2}}\b)")
ADDRESS_ANY = re.compile(rf"(?<![\w'’-])(?:(?:oude|nieuwe|lange|korte|hoge|lage|grote|kleine)\s+)?(?:\w{{3,}}{STREET}|(?:voor|achter)pad|haven)\s+{HOUSE}", re.I)
LAST = r"(?:[A-Z][\w]+(?:['’-][A-Z]?[\w]+)*|[A-Z]['’][A-Z]\w+)"
PARTS = rf"(?:{PARTICLE}\s+){{0,3}}"
FIRST = r"[A-Z][^\W\d_]+(?:-[A-Z][^\W\d_]+)?"
INITIALS = r"(?:[A-Z][a-z]?\.\s?){1,5}"
NAME = re.compile(
    rf"(?<![\w@.'’+-])(?:"
    rf"(?P<initials>{INITIALS})\s?(?P<p1>{PARTS})(?P<l1>{LAST})"
    rf"|(?P<l2>(?:(?:[Vv]an|[Dd]e|[Tt]er)\s+(?:de[rn]?\s+)?)?{LAST}),\s+(?:(?P<g2>{FIRST})(?![\w@+-]|\.\w)|(?P<i2>(?:[A-Z]\.\s?){{1,5}}(?!\s?(?:{PARTS}){LAST})))(?:\s?{PARTICLE}(?:\s+{PARTICLE})*(?=[\s,.;)]))?"
    rf"|(?P<g3>{FIRST})(?:\s+(?:[A-Z]\.\s?)+)?(?:\s+(?P<mid>{FIRST}))?\s+(?P<p3>{PARTS})(?P<l3>{LAST})"
    rf")(?![\w@])"
)
LOWER = r"[^\W\d_]{4,}(?:-[^\W\d_]+)*"
NAME_ANY = re.compile(rf"(?<![\w@.'’+-])(?P<g>[^\W\d_]+)\s+(?P<p>(?:(?:van|de|der|den|ter|ten)\s+){{0,3}})(?P<l>{LOWER})(?![\w@]|\.\w|\s?@)", re.I)
CUE_BEFORE = re.compile(rf"(?:{TITLES}|van|aan|met|over|voor|door|nam|naar|volgens)\s+$", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
# A word of each form of address or announcement.
TITLE_WORDS = frozenset("heer dhr mevrouw mevr mw meneer mijnheer dr drs ir ing mr prof familie fam aanvrager aanvraagster cliënt patiënt bewoner naam ben heet genaamd groet groeten hoogachtend attentie".split())
CUED = re.compile(rf"(?i:\b{TITLES})\s+(?P<name>(?:{FIRST}\s+)?{PARTS}{LAST})(?![\w@])")
CUED_INITIALS = re.compile(rf"(?i:\b{TITLES})\s+(?P<name>(?:[a-z]\.\s?){{1,4}}{PARTS}[a-z]{{4,}}(?:-[a-z]+)*)(?![\w@])")


def eleven(digits: str) -> bool:
    """The public check of citizen service numbers."""
    return len(digits) == 9 and sum((9 - i) * int(d) for i, d in enumerate(digits[:8])) % 11 == int(digits[8]) % 11


def _before(t: str, at: int, reach: int = 48) -> str:
    """What stands before a place in the same sentence, abbreviations in front of numbers included."""
    return re.split(r"[.!?]\s+(?=[A-ZÀ-Þ])|\n\s*\n", t[max(0, at - reach) : at])[-1]


def _names(t: str) -> list[Hit]:
    hits: list[Hit] = []
    at = 0
    while m := NAME.search(t, at):
        hit = None
        if m["initials"]:
            if m["l1"].lower() not in ORGANISATION:
                # a form of address in front, written like an initial, is no part of the name
                lead = re.match(r"(?:Dr\.|Ir\.|Mr\.|Ds\.|St\.|Nr\.|Fa\.)\s?", m.group())
                hit = Hit("person_name", m.start() + (lead.end() if lead else 0), m.end())
        elif m["l2"]:
            if m["i2"] or m["g2"].lower() in GIVEN:
                hit = Hit("person_name", m.start(), m.end())
        else:
            first, particles, last = m["g3"].lower(), m["p3"].lower(), m["l3"].lower()
            street = re.search(rf"{STREET}$", last) and re.match(r"\s+\d", t[m.end() :])
            known = first in GIVEN
            inside = m.start() > 0 and not re.search(r"(?:^|[.!?:\n“„‘\"])\s*$", t[max(0, m.start() - 3) : m.start()])
            shaped = inside and first not in ORGANISATION and not m["g3"].isupper() and re.match(r"(?:van\s+de[rn]?|ter|ten)\s", particles)
            if (known or shaped) and last not in PLAIN and not street:
                hit = Hit("person_name", m.start(), m.end())
        if hit:
            hits.append(hit)
            at = m.end()
        else:  # go on behind the first word
            at = m.start() + re.match(r"[\w'’-]+[.,]?", m.group()).end()
    low = t.lower()
    seen = set(LETTERS.findall(low))
    at = 0
    for word in LETTERS.finditer(t) if not GIVEN.isdisjoint(seen) else ():  # names in small letters or in capitals
        g = word.group()
        if word.start() < at or g.lower() not in GIVEN or g == "ben" or not (m := NAME_ANY.match(t, word.start())):
            continue
        last = m["l"]
        if not (g.islower() or (g.isupper() and last.isupper())):
            continue
        if last.lower().split("-")[0] in PLAIN or (g.islower() and (not last.islower() or g in ALSO_WORDS and not m["p"] and not CUE_BEFORE.search(t[max(0, m.start() - 24) : m.start()]) and not re.match(r"\s(?:en|heeft|schreef|delen|was|niet|gaat|bellen)\b|\s?[,(.]|\s*$", t[m.end() :]))):
            continue
        hits.append(Hit("person_name", m.start(), m.end()))
        at = m.end()
    if TITLE_WORDS.isdisjoint(seen) and "t.a.v" not in low:
        return hits
    for pattern in (CUED, CUED_INITIALS):
        for m in pattern.finditer(t):
            words = re.findall(r"[^\W\d_]+", m["name"])
            if words and words[0].lower() not in ORGANISATION and words[-1].lower() not in PLAIN and len(words) >= (1 if re.match(r"(?i)de heer|dhr|mev|mw|meneer|fam", m.group()) else 2):
                hits.append(Hit("person_name", m.start("name"), m.end("name")))
    return hits


def detect(text: str) -> list[Hit]:
    """Identifiers of a text as non-overlapping source spans in order; kinds found first win: email, phone, number, address, name."""
    p = plain(text)
    t = p.text
    found: list[Hit] = [Hit("email", *m.span()) for m in EMAIL.finditer(t)] if "@" in t else []
    numbers = DIGIT.search(t) is not None  # without a digit only addresses of mail and names are left
    for m in PHONE.finditer(t) if numbers else ():
        digits = re.sub(r"\D", "", m.group())
        international = m.group()[0] == "+" or digits.startswith("00")
        if (9 <= len(digits) - 2 * digits.startswith("00") <= 15 if international else len(digits.replace("(0)", "")) == 10) and not OTHER_CUE.search(_before(t, m.start(), 24)):
            found.append(Hit("phone", *m.span()))
    for m in NUMBER.finditer(t) if numbers else ():
        digits = re.sub(r"\D", "", m.group())
        before = _before(t, m.start())
        cue, other = [list(c.finditer(before)) for c in (IDENTITY_CUE, OTHER_CUE)]
        if cue and (not other or other[-1].start() < cue[-1].start()) or (not other and eleven(digits)):
            found.append(Hit("identity_number", *m.span()))
    for m in DOCUMENT.finditer(t) if numbers else ():
        if sum(c.isdigit() for c in m.group()) >= 2 and (m.group()[0].isupper() or IDENTITY_CUE.search(t[max(0, m.start() - 40) : m.start()])) and not OTHER_CUE.search(_before(t, m.start(), 24)):
            found.append(Hit("identity_number", *m.span()))
    near_number = numbers and any(t[max(0, m.start() - 20) : m.start()].lower().endswith(STREET_ENDS) for m in BEFORE_NUMBER.finditer(t))
    if near_number or numbers and POSTCODE.search(t):
        found += [Hit("street_address", *m.span()) for m in ADDRESS.finditer(t)]
    for m in ADDRESS_ANY.finditer(t) if near_number else ():
        if m.group().upper() == m.group() or m.group().lower() == m.group():
            word = re.match(r"(?i)\s*\w+", m.group()).group().lower()
            if word in ("bij", "op", "onderweg", "halverwege") or not re.search(rf"(?i){STREET}\s+{HOUSE}$", m.group()):
                continue
            if m.group().islower() and not re.search(r"(?i)(?:straat|laan|weg|plein|singel|hof|kade|gracht|dijk|steeg|pad|haven|dreef)\s", m.group()):
                continue
            found.append(Hit("street_address", *m.span()))
    found += _names(t)
    rank = {"email": 0, "phone": 1, "identity_number": 2, "street_address": 3, "person_name": 4}
    taken: list[Hit] = []  # in order of place, none overlapping
    starts: list[int] = []
    for h in sorted(set(found), key=lambda h: (rank[h.kind], h.start, -h.end)):
        k = bisect_left(starts, h.start)
        if (not k or taken[k - 1].end <= h.start) and (k == len(taken) or h.end <= taken[k].start):
            taken.insert(k, h)
            starts.insert(k, h.start)
    return sorted((Hit(h.kind, *p.source(h.start, h.end)) for h in taken), key=lambda h: h.start)


# The placeholder of each type.
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}


def mask(text: str | None) -> str | None:
    """The text with a placeholder for each identifier; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for h in detect(text):
        out += (text[at : h.start], PLACEHOLDER[h.kind])
        at = h.end
    return "".join(out) + text[at:]


def find(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., pii_type, start_pos) per occurrence, keys as strings; null and empty texts give no rows."""
    schema = pa.schema([*((k, pa.string()) for k in keys), ("pii_type", pa.string()), ("start_pos", pa.int32())])
    src = df.filter(F.length(text) > 0).select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(text).alias("_text"))
    return spread(src).mapInArrow(lambda bs: per_row(bs, lambda *r: ((*r[:-1], h.kind, h.start) for h in detect(r[-1])), schema), ", ".join(f"{k} string" for k in keys) + ", pii_type string, start_pos int")


def masked(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., masked_text) of every row; null stays null."""
    schema = pa.schema([*((k, pa.string()) for k in keys), ("masked_text", pa.string())])
    src = df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(text).alias("_text"))
    return spread(src).mapInArrow(lambda bs: per_row(bs, lambda *r: [(*r[:-1], mask(r[-1]))], schema), ", ".join(f"{k} string" for k in keys) + ", masked_text string")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both text columns with the table and key they come from; a re-delivered row counts once."""
    requests = latest(table(spark, sf_dir, "analyze_requests").select("request_id", "text", "ingested_at"), ["request_id"], "ingested_at")
    suggestions = latest(table(spark, sf_dir, "suggestions").select("suggestion_id", "original_text", "ingested_at"), ["suggestion_id"], "ingested_at")
    return requests.select(F.lit("analyze_requests").alias("src_table"), F.col("request_id").cast("string").alias("row_key"), "text").unionByName(
        suggestions.select(F.lit("suggestions").alias("src_table"), F.col("suggestion_id").alias("row_key"), F.col("original_text").alias("text"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(texts(spark, sf_dir), ["src_table", "row_key"], "text").distinct()


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(texts(spark, sf_dir), ["src_table", "row_key"], "text")
