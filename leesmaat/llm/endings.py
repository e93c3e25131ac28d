"""How a text ends: form, closing mark, open brackets, and how likely its last n-gram is to end a text.

An ending is an n-gram of the last word (a number with the word before it) and what closes it: a full mark, dots, nothing
at the end of a list item or labelled line, nothing in running text. P(end | n-gram) is estimated over all values at places
that can't be cut off, since more text follows: how often a word stands inside text, before a full stop, before a mark that
what follows shows to have ended a sentence, at the end of a line or paragraph that others follow, and how often a label
closes a block. So cut values don't spoil the counts. Words that were seldom seen fall back on the share of all words with
the same closing. Brackets, quotation marks and structures that stay open need no estimate."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leesmaat.llm.common import per_row, spread
from leesmaat.llm.sentences import ABBREVIATIONS, ENDING, UNMARKED_CHAR

WORD = re.compile(r"[^\W\d_]+(?:[-'’.][^\W\d_]+)*|\d+(?:[.,:/]\d+)*")
FULL = ".!?…。！？؟।॥"
AROUND = ".,;:!?…\"'“”„‘’‚«»()[]{}*_`-–—"
CLOSERS = "\"'”’»)]“"
ENDERS = frozenset(FULL + CLOSERS)
MARKED = (("\u1000", "\u109f", frozenset("\u104b")), ("\u1780", "\u17ff", frozenset("\u17d4\u17d5\u17da")))  # Burmese, Khmer: their letters and closing marks; Thai and Lao have none
OPENS = re.compile(r"[\"“„‘«'(\[]*[A-ZÀ-Þ]")  # how a piece begins that can open a sentence
ITEM = re.compile(r"\s*(?:[-*•–]|\d{1,3}[.)])\s+\S")
OPEN_FORMS = re.compile(r"\{|```|<think>")  # their end is not that of a sentence
LABEL = re.compile(r"\s*(?:\*\*)?([A-ZÀ-Þ][\w ]{1,24}?)(?:\*\*)?:(?:\*\*)?\s")
# Whole answers that need no closing mark.
LABELLED = 8  # words of a labelled value that may stand without a mark; longer ones are sentences
SHORT = frozenset("geen ok oké ja nee klopt akkoord correct goed prima none no yes nee. n.v.t nvt n/a geen-fouten gereed klaar".split())
SHORT_TEXTS = frozenset(["geen fouten gevonden", "geen fouten", "geen suggesties", "geen voorstel", "geen wijziging", "geen wijzigingen", "geen opmerkingen", "niets gevonden", "geen verbetering nodig", "no errors found", "no changes", "in orde", "alles goed", "geen verbeteringen"])
# Stand-ins for "no value", without marks and in lower case.
STAND_INS = frozenset(
    ["null", "none", "nil", "nan", "na", "n a", "nvt", "n v t", "geen", "leeg", "niets", "empty", "undefined", "blank", "no value", "geen waarde", "geen tekst", "geen antwoord", "geen suggestie", "geen voorstel", "geen uitleg", "geen toelichting", "geen inhoud", "not available", "not applicable", "niet van toepassing", "niet beschikbaar", "onbekend", "missing", "void", "tbd", "todo", "keine angabe", "aucun", "ninguno", "unknown"]
)
PAIRS = (("“", "”"), ("„", "”“"), ("«", "»"), ("(", ")"), ("「", "」"), ("[", "]"))
CLOSING = "\"”’»)]」』*_`'"


def token(words: list[str], i: int) -> str:
    """The word as it is counted: in lower case; a number together with the word before it."""
    w = words[i].lower()
    if w[0].isdigit():
        return (words[i - 1].lower() if i and not words[i - 1][0].isdigit() else "") + "#"
    return w


def count_words(value: str, c: dict[str, Counter]) -> None:
    """Add a value's counts by kind: inside, before a mark, at the end of a line without one, and labels that close a block."""
    pieces = value.split()
    words = [p.strip(AROUND).lower() for p in pieces]
    inside, mark = c["inside"], c["mark"]
    before = ""
    for k, w in enumerate(words):
        if w and w[0].isdigit():
            w = ("" if not before or before[0].isdigit() else before) + "#"
        if k + 1 < len(words) and w:
            inside[w] += 1
            p = pieces[k]
            if p[-1] in ENDERS:
                end = p.rstrip(CLOSERS)
                if end and end[-1] == ".":
                    c["dotted"][w] += 1
                if end and end[-1] in FULL and OPENS.match(pieces[k + 1]) and not (len(w) == 1 and p.strip(AROUND).isupper()):
                    mark[w] += 1
        before = words[k]
    if "\n" not in value:
        return
    lines = value.split("\n")
    label = None
    for line, after in zip(lines[:-1], lines[1:], strict=True):
        m = LABEL.match(line)
        label = m[1].lower() if m else label
        if line.strip() == "---" or not line.strip():
            continue
        if not after.strip() and line.rstrip()[-1] not in ENDERS:
            last = WORD.findall(line)
            if last:
                c["bare"][token(last, len(last) - 1)] += 1
        found = WORD.findall(line)
        if found and line.rstrip()[-1] not in FULL and (ITEM.match(after) or LABEL.match(after) or after.strip() == "---") and (ITEM.match(line) or m):
            c["line"][token(found, len(found) - 1)] += 1
        if label and after.strip() == "---":
            c["block"][label] += 1


def evidence(values: DataFrame, column: str) -> DataFrame:
    """token, inside, mark, line, block, dotted, bare: counts over all values, pre-aggregated in each task."""
    schema = pa.schema([("kind", pa.string()), ("token", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = {k: Counter() for k in KINDS}
        for b in batches:
            for v in b.column(0).to_pylist():
                count_words(v, c)
            if sum(map(len, c.values())) > 200_000:
                yield _counted(c, schema)
                c = {k: Counter() for k in KINDS}
        yield _counted(c, schema)

    rows = spread(values.filter(F.col(column).isNotNull()).select(column)).mapInArrow(count, "kind string, token string, n bigint")
    return rows.groupBy("token").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in KINDS])


KINDS = ("inside", "mark", "line", "block", "dotted", "bare")
SEEN = 5.0  # weight of all words together against the counts of one
LIKELY = 0.5  # a word without a mark in running text ends it if this likely


def _counted(c: dict[str, Counter], schema: pa.Schema) -> pa.RecordBatch:
    rows = [(k, t, n) for k, counter in c.items() for t, n in counter.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.types[i]) for i in range(3)], schema=schema)


def ending(value: str, original: str | None = None) -> tuple[str, str, str]:
    """(verdict, token, label) of a value that isn't blank: whole, cut, or what must be looked up for the token or label:
    mark (a closing mark after a word or number that may not end sentences), dots (a word before dots), line (a list item or
    labelled line without a mark)."""
    text = value.rstrip()
    text = re.sub(r"[​﻿]+$", "", text).rstrip()
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1] if lines else ""
    words = WORD.findall(last)
    tok = token(words, len(words) - 1) if words else ""
    if not words and not any(c.isalnum() for c in text):
        return "whole", "", ""
    head = text.lstrip()
    if head.startswith(("{", "```")):
        return ("whole" if text.endswith(("}", "```", "]")) else "cut"), tok, ""
    if "<think>" in text and "</think>" not in text:
        return "cut", tok, ""
    body = text.rstrip(CLOSING + " \u00a0\u202f" + ("“‘" if "„" in text or "‚" in text else ""))
    if not body:
        return "whole", tok, ""
    end = body[-1]
    if original:  # an answer that ends as the original does ends where the original ends
        mine, theirs = WORD.findall(text.lower()), WORD.findall(original.lower())
        alike = original.rstrip(CLOSING + " ")[-1:]
        if mine[-2:] == theirs[-2:] and (alike == end or alike not in FULL) and len(mine) >= min(2, len(theirs)):
            return "whole", tok, ""
    if UNMARKED_CHAR.match(end):
        marks = next((m for a, z, m in MARKED if a <= end <= z), frozenset())
        unclosed = end not in marks and not marks.isdisjoint(body)  # its sentences have marks, the last one hasn't
        return ("cut" if unclosed and not ITEM.match(last) and not LABEL.match(last) else "whole"), tok, ""
    if end in FULL:
        for a, b in PAIRS:
            opened = sum(text.count(x) for x in a)
            closed = sum(text.count(x) for x in b)
            if a == "“" and "„" in text:
                continue
            if opened > closed and a != "[":
                return ("dots" if body.endswith(("...", "…")) and not a == "(" else "cut"), tok, ""
        if text.count('"') % 2:
            return "cut", tok, ""
        if body.endswith(("...", "…")):
            return "dots", tok, ""
        bare = re.search(r"(\S+?)[.]$", body)
        if bare and words and end == ".":
            raw = bare[1].lower().lstrip("(“„‘\"'«")
            if raw in ABBREVIATIONS and raw not in ENDING and len(WORD.findall(text)) > 1:
                return "mark", raw, ""
            if words[-1].isdigit() and body[-2].isdigit():
                return "mark", tok, ""
        return "whole", tok, ""
    if end in ",;:-–—(/&+" and not text.endswith(("---", "- -")):
        return "cut", tok, ""
    low = text.strip(" .*_-\"'[]()").lower()
    if low in SHORT or low in SHORT_TEXTS or " ".join(re.findall(r"[^\W_]+", low)) in STAND_INS:
        return "whole", tok, ""
    label = LABEL.match(last)
    if label and (len(lines) > 1 or re.match(r"[A-Z ]{3,}:", last.strip())) and len(WORD.findall(last)) <= LABELLED:
        blocks = re.split(r"(?m)^\s*---\s*$", text)
        return "line", tok, label[1].lower() if len(blocks) > 1 or len(lines) <= 4 else ""
    if ITEM.match(last) and (len(lines) > 1 or last.strip().startswith("-")):
        return "line", tok, ""
    if re.match(r"#{1,6}\s", last):
        return "whole", tok, ""
    return "cut", tok, ""


def judged(
    values: DataFrame, keys: list[str], column: str, original: str | None, counts: DataFrame, rare: float = 0.01, dots: float | None = None, at_limit: str | None = None, lax: tuple[float, float] = (0.05, 1.01)
) -> DataFrame:
    """keys and `incomplete` of every value that isn't blank. A value is incomplete if its ending stays open, or if its last
    n-gram makes an end unlikely: P(end | n-gram) under `rare` (`dots` before dots), or under the bars `lax` for values with the
    flag `at_limit`. Where the counts tell of no full stops and paragraphs, an ending is taken by its form there."""
    fields = [(k, pa.string()) for k in keys]
    schema = pa.schema([*fields, ("limit", pa.bool_()), ("verdict", pa.string()), ("token", pa.string()), ("label", pa.string()), ("closed", pa.string())])
    cols = [F.col(k).cast("string").alias(k) for k in keys]
    src = values.filter(F.length(F.trim(column)) > 0).select(*cols, (F.col(at_limit) if at_limit else F.lit(False)).alias("limit"), F.col(column).alias("_v"), (F.col(original) if original else F.lit(None).cast("string")).alias("_o"))

    def end(*r):
        *key, limit, value, given = r
        verdict, tok, label = ending(value, given)
        last = value.rstrip()[-1:]
        closed = "dot" if verdict == "whole" and last == "." else "none" if verdict == "cut" and last.isalnum() and not OPEN_FORMS.match(value.lstrip()) else ""
        return [(*key, limit, verdict, tok, label, closed)]

    ends = spread(src).mapInArrow(lambda bs: per_row(bs, end, schema), ", ".join(f"{k} string" for k in keys) + ", limit boolean, verdict string, token string, label string, closed string")
    labels = counts.filter("block > 0").select(F.col("token").alias("label"), F.col("block").alias("closes"))
    full = "dotted" in counts.columns
    known = counts.select("token", "inside", "mark", "line", *(("dotted", "bare") if full else ()))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda c: zero(c) / F.greatest(zero("inside"), zero(c), F.lit(1))  # noqa: E731  # what ends something stands inside too
    p_end: Column = share("mark")
    bar = F.when(F.col("limit"), lax[0]).otherwise(rare)
    bar_dots = F.when(F.col("limit"), lax[1]).otherwise(rare if dots is None else dots)
    verdict = (
        F.when(F.col("verdict") == "dots", p_end < bar_dots)
        .when(F.col("verdict") == "mark", (zero("inside") >= 5) & (p_end < bar))
        .when(F.col("verdict") == "line", (share("line") < bar) | ((F.col("label") != "") & F.col("closes").isNull()))
    )
    if full:
        total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("inside", "mark", "dotted", "bare")]).first()
        all_dots = (total["mark"] + 1.0) / (max(total["mark"], total["dotted"]) + 1.0)
        all_bare = (total["bare"] + 0.0) / (total["inside"] + 1.0)
        smooth = lambda n, of, p: (zero(n) + SEEN * p) / (F.greatest(zero(of), zero(n)) + SEEN)
        verdict = verdict.when(F.col("closed") == "dot", smooth("mark", "dotted", all_dots) < bar).when(F.col("closed") == "none", smooth("bare", "inside", all_bare) < LIKELY)
    looked = ends.join(known, "token", "left").join(labels, "label", "left")
    return looked.select(*keys, F.coalesce(verdict, F.col("verdict") == "cut").alias("incomplete"))
