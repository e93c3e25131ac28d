"""String expressions of segmentation and normalisation. Java's classes are ASCII only, so Unicode ones are spelled out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leesmaat import constants as K

# A word with a suffix in brackets, such as kind(eren) or auto('s), is one token.
TOKEN = r"\p{L}+\([\x27’]?\p{L}+\)|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SPACE = r"[\s   -     　]+"
# Fixed value: a web or mail address.
URL = r"(?i:(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+\.[\w.-]+)"
CLOSERS = r"[\"')\]”’ ]*$"


def straight_quotes(text: Column) -> Column:
    """Every kind of quotation mark as the plain double one."""
    return F.translate(text, K.QUOTES, '"' * len(K.QUOTES))


def collapse(text: Column) -> Column:
    """Runs of white space, no-break spaces included, as one blank."""
    return F.regexp_replace(text, SPACE, " ")


def tokens(text: Column) -> Column:
    """Words, numbers and single other marks."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)


def bare_words(text: Column) -> Column:
    """Blank-separated pieces without marks at their ends, empty ones left out."""
    trimmed = F.transform(F.split(text, " "), lambda t: F.regexp_replace(t, r"^[^0-9A-Za-zÀ-ſ]+|[^0-9A-Za-zÀ-ſ]+$", ""))
    return F.filter(trimmed, lambda t: t != "")


def ends_like_sentence(line: Column) -> Column:
    """Whether a line ends in a closing mark (behind quotes and brackets), holds a whole sentence, or ends in an address behind text."""
    bare = F.regexp_replace(line, CLOSERS, "")
    closed = bare.rlike(r"[.!?…]$")
    inner = (bare != "") & line.rlike(r"[.!?…]\s")
    address = bare.rlike(rf"\S\s+{URL}$")
    return F.coalesce(closed | inner | address, F.lit(False))


def is_fragment(text: Column) -> Column:
    """No letters, a colon at the end, or at most three words: nothing that can be scored as a sentence."""
    words = F.size(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1))
    return (words <= 3) | text.rlike(r":\s*$")


def urls(text: Column) -> Column:
    """Web and mail addresses without marks at their end."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({URL})"), 1), lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", ""))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """The first occurrence of a string replaced; the text itself where there is none or the string is empty."""
    at = F.instr(text, old)
    done = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))
    return F.when((at > 0) & (F.length(old) > 0), done).otherwise(text)


def strip_thinking(text: Column) -> Column:
    """A model's answer without its thinking part."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def strip_list_marker(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*(?:[-*•]|\d+[.)])\s+", "")


def strip_brackets(text: Column) -> Column:
    """A value wholly in square brackets without them."""
    return F.regexp_replace(F.trim(text), r"^\[(.*)\]$", "$1")


def clean_variant(text: Column) -> Column:
    """A proposed rewrite without list marker, quotes around it and brackets."""
    return F.trim(F.regexp_replace(strip_brackets(strip_list_marker(text)), r"^[\"“”']+|[\"“”']+$", ""))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    longest = F.array_max(F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)))
    return F.coalesce(longest, F.lit(0))
