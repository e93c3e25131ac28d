"""The linear difficulty score and its levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leesmaat import constants as K


def difficulty(frequency: Column, dependency: Column, content_words: Column, concrete: Column) -> Column:
    """100 minus the linear prediction, kept within 0 and 100; null if any input is null."""
    raw = K.INTERCEPT + K.W_FREQUENCY * frequency + K.W_DEPENDENCY * dependency + K.W_CONTENT_WORDS * content_words + K.W_CONCRETE * concrete
    complete = frequency.isNotNull() & dependency.isNotNull() & content_words.isNotNull() & concrete.isNotNull()
    return F.when(complete, F.greatest(F.least(100 - raw, F.lit(100.0)), F.lit(0.0)))


def level(score: Column) -> Column:
    """1 (easy) to 4; null for null."""
    a, b, c = K.LEVEL_BOUNDS
    return F.when(score < a, 1).when(score < b, 2).when(score < c, 3).when(score.isNotNull(), 4)


def readers_struggling(lvl: Column) -> Column:
    """Share of adult readers, in per cent, for a level."""
    out = F.lit(None).cast("int")
    for k, v in K.READERS_STRUGGLING.items():
        out = F.when(lvl == k, v).otherwise(out)
    return out
