"""Checks of proposed rewrites as Boolean columns: true means the rewrite fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leesmaat import constants as K
from leesmaat.functions import text as T


def is_noop(original: Column, rewrite: Column) -> Column:
    """Equal apart from letter case, white space and marks at the end."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(T.collapse(c))), r"[\s.!?…\"']+$", "")
    return norm(original) == norm(rewrite)


def alters_url(original: Column, rewrite: Column) -> Column:
    """An address of the original is missing."""
    return ~F.forall(T.urls(original), lambda u: F.contains(rewrite, u))


def breaks_conjunction(original: Column, rewrite: Column) -> Column:
    """A clause joined by a coordinating conjunction lost it."""
    lost = [F.contains(F.lower(original), F.lit(f", {w} ")) & ~F.contains(F.lower(rewrite), F.lit(f", {w} ")) for w in K.CLAUSE_CONJUNCTIONS]
    return lost[0] | lost[1] | lost[2]


def same_family(a: Column, b: Column) -> Column:
    """Words that share five letters at the start and differ in at most three behind."""
    p = T.common_prefix(F.lower(a), F.lower(b))
    return (p >= 5) & (F.length(a) - p <= 3) & (F.length(b) - p <= 3)


def higher_band(candidate: Column, original: Column) -> Column:
    """Whether a frequency, rounded half to even, lies in a higher band."""
    return F.bround(candidate, 0) > F.bround(original, 0)


def plausible(wrong: Column, right: Column, f_wrong: Column, f_right: Column) -> Column:
    """Whether a correction may be meant: long common start, both short, or more frequent; unlisted words have the default
    frequency. For a correction in several words only the frequency counts here; splits of the word itself are `split_of`."""
    p = T.common_prefix(wrong, right)
    shorter = F.least(F.length(wrong), F.length(right))
    miss = F.lit(K.MISSING_FREQUENCY)
    alike = (p >= F.greatest(F.lit(3), shorter - 2)) | ((F.length(wrong) <= 4) & (F.length(right) <= 4))
    return alike & ~F.contains(right, F.lit(" ")) | (F.coalesce(f_right, miss) > F.coalesce(f_wrong, miss))


def split_of(wrong: Column, right: Column) -> Column:
    """Whether a correction only sets blanks into the word."""
    return F.contains(right, F.lit(" ")) & (F.regexp_replace(right, " ", "") == wrong)


def passes_band(word: Column, replacement: Column, f_word: Column, f_replacement: Column) -> Column:
    """Whether a replacement for a rare word is worth it: several words only for a long compound, else a word of another
    family in a higher band. A null replacement passes."""
    several = F.contains(F.trim(replacement), F.lit(" "))
    single = ~same_family(word, F.trim(replacement)) & higher_band(F.coalesce(f_replacement, F.lit(K.MISSING_FREQUENCY)), f_word)
    return F.when(replacement.isNull() | (replacement == ""), True).when(several, F.length(word) >= K.COMPOUND_LEAST).otherwise(single)


def first_failure(original: Column, rewrite: Column) -> Column:
    """Name of the first check a rewrite fails; null for none."""
    return F.coalesce(
        F.when(rewrite.isNull() | (F.trim(rewrite) == ""), "empty"),
        F.when(is_noop(original, rewrite), "noop"),
        F.when(alters_url(original, rewrite), "url"),
        F.when(breaks_conjunction(original, rewrite), "conjunction"),
    )
