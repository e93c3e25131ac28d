"""Problem 2: broken pairs of a text and its answers, each with its defect.

Defects in the order they are looked for: empty, refusal, copy, wrong_language, truncated. Language: posteriors of a
character n-gram naive Bayes for both sides, trained on a bounded sample of tagged texts. Truncation: likelihood of an end
after the last words (endings)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leesmaat.llm import langid
from leesmaat.llm.common import cut, latest, spread, table
from leesmaat.llm.endings import STAND_INS, evidence, judged

# Ways to decline a task, by language.
REFUSALS = [
    # Dutch
    r"als (?:een )?(?:groot )?(?:ai|taal|kunstmatige|digitale|virtuele)[- ]?\w*(?: \w+)? (?:mag|kan|ben|heb|geef|doe)", r"\bik ben (?:een |slechts een |maar een )?(?:ai|taalmodel)", r"(?:kan|mag|wil|zal) ik (?:\w+ ){0,6}(?:niet|geen)\b(?: \w+){0,4} ?(?:helpen|herschrijven|voldoen|van dienst|beantwoorden|bewerken|maken|uitvoeren|geven|doen|meewerken|aanpassen|behandelen)?", r"\bik (?:kan|mag|wil|zal) (?:\w+ ){0,7}(?:niet|geen)\b", r"ik (?:moet|wil) (?:\w+ ){0,4}(?:weigeren|afwijzen)", r"verzoek (?:\w+ ){0,3}(?:weigeren|afwijzen|niet voldoen)", r"niet (?:mee|bij|van) (?:helpen|dienst)", r"(?:liever|kan) geen uitspraak", r"buiten wat ik", r"(?:richtlijnen|beleid|regels) (?:\w+ ){0,3}(?:niet toe|verbied)", r"vanwege mijn (?:beleid|richtlijnen|beperkingen)", r"geen (?:herschrijving|antwoord|tekst|voorstel) mogelijk", r"het spijt (?:me|mij)", r"kunnen (?:we|wij) u (?:hier )?(?:helaas )?niet", r"niet in staat om", r"weiger ik", r"(?:te weinig|onvoldoende|niet genoeg) (?:informatie|context|gegevens|tekst)", r"daar (?:ga|doe|geef) ik (?:\w+ ){0,3}(?:niet|geen)", r"ik (?:ga|doe|geef|schrijf|maak|behandel) (?:\w+ ){0,5}(?:niet|geen)\b",
    # English
    r"\bas an? (?:ai|artificial|language|large)\b", r"\bi(?:'|’)?m (?:sorry|unable|not able|afraid)", r"\bi am (?:sorry|unable|not able|afraid)", r"\bi (?:can(?:'|’)?t|cannot|can not|won(?:'|’)?t|will not|must decline|have to decline|decline|do not feel)", r"(?:can(?:'|’)?t|cannot|unable to) (?:assist|help|comply|rewrite|do that|fulfil)", r"against my (?:guidelines|policy)", r"my guidelines", r"not able to (?:help|assist|comply)", r"(?:not enough|insufficient|too little) (?:information|context)", r"beyond (?:my|what i)",
    # German
    r"als (?:ki|sprachmodell|künstliche)", r"(?:kann|darf|werde|möchte) ich (?:\w+ ){0,6}(?:nicht|keine)", r"\bich (?:kann|darf|werde|möchte) (?:\w+ ){0,6}(?:nicht|keine|leider)", r"tut mir leid", r"(?:anfrage|bitte) (?:\w+ ){0,3}ablehnen", r"nicht weiterhelfen", r"(?:zu wenig|nicht genug|nicht genügend) (?:information|angaben|kontext)",
    # French
    r"en tant qu(?:'|’)?\w*\s?(?:ia|modèle|assistant)", r"je (?:ne|n(?:'|’)) ?(?:peux|puis|suis|veux)", r"désolée?", r"je regrette", r"je dois (?:\w+ ){0,2}refuser", r"impossible de (?:\w+ ){0,2}(?:répondre|traiter|reformuler)",
    r"(?:pas assez|trop peu) d(?:'|’)(?:informations?|éléments)", r"(?:no hay|falta|no tengo) (?:suficiente )?información",
    # Spanish, Italian, Portuguese
    r"lo siento", r"no (?:puedo|podemos|me es posible)", r"como (?:modelo|ia|inteligencia)", r"debo (?:rechazar|negarme)", r"mi dispiace", r"non posso", r"não posso", r"desculpe",
    # other scripts
    r"не могу|не можем|извините|к сожалению|как (?:языковая|ии)|вынужден\w* отказ", r"لا (?:أستطيع|يمكنني|يمكن)|عذرا|عذرًا|آسف|أعتذر|نموذج لغ", r"क्षमा|नहीं कर सक|माफ़|असमर्थ|भाषा मॉडल", r"无法|抱歉|对不起|不能(?:协助|帮助|完成|提供|改写)|语言模型|拒绝", r"できません|申し訳|お断り|言語モデル|いたしかねます", r"ไม่สามารถ|ขออภัย|ขอโทษ|แบบจำลองภาษา",
]
REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS))  # on small letters
# Signs that a model declines its task, beside which it matters little what the original says.
OWN_TASK = re.compile(r"verzoek|herschrij|taalmodel|digitale assistent|richtlijn|mijn beleid|tekst (?:maken|bewerk)|uitspraak over|buiten wat ik|request|rewrite|comply|\bas an ai\b|language model|(?:weinig|onvoldoende) informatie")
REFUSAL_WORDS, PASSED_ON = 45, 0.25  # a longer answer does more than decline if it holds this share of the original's long words
LONG = 5  # letters of words that two texts don't share by chance
WORDS = re.compile(r"[^\W_]+")
LABEL = re.compile(r"^\s*[\"“„'*#_\[(]*[^:\n]{1,48}?[\])*_]*\s*:\s*")
IGNORED = re.compile("[​-‏⁠﻿­]")


def bare(text: str | None) -> list[str]:
    """The words of a text without regard to letter case."""
    if not text:
        return []
    return WORDS.findall((text if text.isascii() else IGNORED.sub("", text)).casefold())


def empty(answer: str | None) -> bool:
    words = bare(answer)
    return not words or len(words) <= 3 and " ".join(words) in STAND_INS


def refusal(original: str, answer: str, theirs: set[str], mine: list[str]) -> bool:
    """Whether the answer declines; a text that itself speaks so is merely passed on, and a long answer that holds words of
    the original does more than decline. theirs, mine: the words of both."""
    low, original = answer.lower(), original.lower()
    if not REFUSAL.search(low):
        return False
    if len(mine) > REFUSAL_WORDS or len(answer) > 12 * REFUSAL_WORDS:
        asked = {w for w in theirs if len(w) >= LONG} or theirs
        if asked and len(asked.intersection(mine)) >= PASSED_ON * len(asked):
            return False
    return not REFUSAL.search(original) or bool(OWN_TASK.search(low)) and not OWN_TASK.search(original)


def copies(theirs: list[str], answer: str, mine: list[str]) -> bool:
    """Whether an answer with the words `mine` repeats the words `theirs`, perhaps behind a label."""
    if not theirs or len(mine) < len(theirs) or mine[-1] != theirs[-1]:
        return False
    if mine == theirs:
        return True
    m = LABEL.match(IGNORED.sub("", answer))
    return bool(m) and bare(IGNORED.sub("", answer)[m.end() :]) == theirs


MENTION = re.compile(r"(?<![^\W_])['\"‘’“”„«»`]\s?([^\W_]+)\s?['\"’‘“”«»`](?![^\W_])")


def own_words(answer: str, known: set[str]) -> str:
    """The answer without words of the original that it only names, in quotation marks: they are not in its own language."""
    return MENTION.sub(lambda m: " " if m[1].casefold() in known else m.group(), answer)


def foreign(original: tuple[np.ndarray, int], answer: tuple[np.ndarray, int]) -> bool:
    """Whether the answer is in another language: each side beats the other's language by the margin on its own text, which
    short answers seldom do."""
    (o, n), (a, _) = original, answer
    if n < langid.LEAST_LETTERS:
        return False
    mine, theirs = int(a.argmax()), int(o.argmax())
    return mine != theirs and a[mine] - a[theirs] > langid.MARGIN and o[theirs] - o[mine] > langid.MARGIN


def defects(pairs: DataFrame, key: str, original: str, answers: list[str], model: langid.Model) -> DataFrame:
    """key (as a string), field, defect, original and answer of every answer; truncation, which needs counts over all
    answers, is left open. The original is judged once for all its answers."""
    held = pairs.sparkSession.sparkContext.broadcast(model)  # languages times BUCKETS numbers, whatever the data

    def plain(o: str, theirs: list[str], known: set[str], a: str | None) -> str | None:
        """The defect, None where the language must tell."""
        mine = bare(a)
        if not mine or len(mine) <= 3 and " ".join(mine) in STAND_INS:
            return "empty"
        if refusal(o, a, known, mine):
            return "refusal"
        return "copy" if copies(theirs, a, mine) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2_048):
                keys, originals, *given = (c.to_pylist() for c in b.slice(lo, 2_048).columns)
                rows, asked = [], []  # asked: row of the output, its original, answer
                for x, (k, o) in enumerate(zip(keys, originals, strict=True)):
                    theirs = bare(o)
                    known = set(theirs)
                    for f, values in zip(answers, given, strict=True):
                        a = values[x]
                        d = plain(o or "", theirs, known, a)
                        if d is None:
                            asked.append((len(rows), x, own_words(a, known)))
                        rows.append([k, f, d, o, a])
                if asked:
                    places = sorted({x for _, x, _ in asked})
                    at = {x: n for n, x in enumerate(places)}
                    o_score, o_letters = held.value.judge_all([originals[x] or "" for x in places])
                    a_score, a_letters = held.value.judge_all([a for *_, a in asked])
                    for n, (row, x, _) in enumerate(asked):
                        if foreign((o_score[at[x]], o_letters[at[x]]), (a_score[n], a_letters[n])):
                            rows[row][2] = "wrong_language"
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)

    schema = pa.schema([(c, pa.string()) for c in ("key", "field", "defect", "original", "answer")])
    src = pairs.select(F.col(key).cast("string").alias("key"), F.col(original).alias("_o"), *answers)
    return spread(src).mapInArrow(run, "key string, field string, defect string, original string, answer string")


def all_defects(pairs: DataFrame, key: str, original: str, answers: list[str], model: langid.Model) -> DataFrame:
    """key, field, defect of every defective answer, at most one each. A null original is compared as an empty text."""
    rows = cut(defects(pairs, key, original, answers, model), "defects")
    texts = rows.filter(F.col("defect").isNull()).select("answer").unionByName(pairs.select(F.col(original).alias("answer")))
    counts = cut(evidence(texts, "answer"), "answers")
    ends = judged(rows.filter(F.col("defect").isNull()), ["key", "field"], "answer", "original", counts)
    truncated = ends.filter("incomplete").select("key", "field", F.lit("truncated").alias("defect"))
    return rows.filter(F.col("defect").isNotNull()).select("key", "field", "defect").unionByName(truncated)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of both answers of each suggestion; a re-delivered suggestion counts once."""
    model = langid.train(table(spark, sf_dir, "documents"), "lang", "text", "doc_id")
    s = latest(table(spark, sf_dir, "suggestions").select("suggestion_id", "original_text", "suggested_text", "explanation", "ingested_at"), ["suggestion_id"], "ingested_at")
    return all_defects(s, "suggestion_id", "original_text", ["suggested_text", "explanation"], model).withColumnRenamed("key", "suggestion_id")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects per field, with their share of all answers."""
    total = table(spark, sf_dir, "suggestions").agg(F.countDistinct("suggestion_id")).first()[0]
    counts = p2_found(spark, sf_dir).groupBy("field", "defect").agg(F.count("*").alias("n"))
    return counts.withColumn("answers", F.lit(total)).withColumn("share", F.round(F.col("n") / F.col("answers"), 6))
