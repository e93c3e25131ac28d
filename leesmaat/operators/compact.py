"""Sentences of whole documents in one pass: tokens are gathered by document, which moves nothing when they were dealt by
document before, and leave as sums of their sentences and the words that are asked for. No table of tokens is written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leesmaat import constants as K
from leesmaat.functions import score as S
from leesmaat.functions import text as T
from leesmaat.operators import aggregate
from leesmaat.operators.syntax import structure

FLAGS = {"content_words": "is_content", "finite_verbs": "is_finite", "constituents": "is_constituent", "modifiers": "is_modifier", "humans": "is_human", "alpha_words": "is_alpha"}
CLASSES = ("concrete", "abstract", "undefined", "unknown")
TOKEN = ["sent_idx", "i", "text", "lower", "lemma", "pos", "tag", "dep", "head", "is_punct", "frequency", "noun_class", "is_passive_aux", *FLAGS.values()]
COUNTS = ["sent_length", "freq_count", *CLASSES, *FLAGS, "agents", "subordinate_clauses", "_inner"]
WORD = pa.struct([("i", pa.int32()), ("text", pa.string()), ("lower", pa.string()), ("lemma", pa.string()), ("pos", pa.string()), ("tag", pa.string()), ("frequency", pa.float64()), ("noun_class", pa.string()), ("dep_length", pa.int32())])
SENTENCE = pa.struct([("sent_idx", pa.int32()), ("sentence", pa.string()), ("freq_sum", pa.float64()), ("_sdl", pa.int32()), ("has_passive", pa.bool_()), *((c, pa.int64()) for c in COUNTS), ("words", pa.list_(WORD))])
DDL = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}


def _kind(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{_kind(t.value_type)}>"
    return f"struct<{', '.join(f'{f.name}: {_kind(f.type)}' for f in t)}>" if pa.types.is_struct(t) else DDL[t]


def _batch(b: pa.RecordBatch, rarer: float | None) -> pa.RecordBatch:
    """Documents with their sentences, in order; words: all, or those rarer than given."""
    lists = b.column("t")
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    sent, i = flat.field("sent_idx").to_numpy(), flat.field("i").to_numpy()
    order = np.lexsort((i, sent, doc))
    flat, doc, sent, i = flat.take(pa.array(order)), doc[order], sent[order], i[order]
    opens = np.ones(len(i), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (sent[1:] != sent[:-1])
    row, first = np.cumsum(opens) - 1, np.flatnonzero(opens)
    n = len(first)
    text = lambda c: flat.field(c).fill_null("").to_numpy(zero_copy_only=False)
    flag = lambda c: flat.field(c).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    count = lambda x: np.bincount(row[x], minlength=n)
    dep, word = text("dep"), ~flag("is_punct")
    verb = pc.match_substring(flat.field("tag").fill_null(""), "WW").to_numpy(zero_copy_only=False).astype(np.int64)
    found = structure(row, i, flat.field("head").fill_null(-1).to_numpy(), dep, verb)
    known = flat.field("frequency").is_valid().to_numpy(zero_copy_only=False)
    frequency = flat.field("frequency").fill_null(0.0).to_numpy()
    steady = np.floor(frequency * aggregate.STEP) / aggregate.STEP
    classed = text("noun_class")
    passive = flat.field("is_passive_aux").is_valid().to_numpy(zero_copy_only=False)
    counted = {
        "sent_length": count(word), "freq_count": count(known), "agents": count(dep == "obl:agent"), **{k: count(classed == k) for k in CLASSES}, **{k: count(flag(c)) for k, c in FLAGS.items()},
        "subordinate_clauses": count(np.isin(found["base_dep"].astype(str), list(K.SUBORDINATE)) & (found["subtree_verbs"] > 0)),
        "_inner": np.bincount(row, np.where(flag("is_modifier"), found["subtree_conj"], 0), n).astype(np.int64),
    }
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row[word], found["dep_length"][word])
    ends = np.append(first, len(i)).astype(np.int32)
    kept = np.flatnonzero(known & (frequency < rarer)) if rarer is not None else np.arange(len(i))
    words = flat if rarer is None else flat.take(pa.array(kept))
    inner = [words.field(f.name).cast(f.type) if f.name != "dep_length" else pa.array(found["dep_length"][kept], pa.int32()) for f in WORD]
    places = np.searchsorted(kept, ends).astype(np.int32)
    columns = {
        "sent_idx": pa.array(sent[first], pa.int32()),
        "sentence": pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), flat.field("text")), " "),
        "freq_sum": pa.array(np.bincount(row, steady, n), mask=counted["freq_count"] == 0),
        "_sdl": pa.array(longest.astype(np.int32), mask=counted["sent_length"] == 0),
        "has_passive": pa.array(count(flag("is_passive_aux")) > 0, mask=count(passive) == 0),
        **{c: pa.array(counted[c], pa.int64()) for c in COUNTS},
        "words": pa.ListArray.from_arrays(pa.array(places), pa.StructArray.from_arrays(inner, fields=list(WORD))),
    }
    sentences = pa.StructArray.from_arrays([columns[f.name] for f in SENTENCE], fields=list(SENTENCE))
    held = np.searchsorted(doc[first], np.arange(len(lists) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(held), sentences)], names=["doc_id", "sentences"])


def documents(tokens: DataFrame, structured: bool, rarer: float | None = None) -> DataFrame:
    """doc_id, sentences: their features as aggregate.sentence_features has them, score, level, and their words (all, or those
    of a frequency below the given one). tokens: annotated, with token features, not parsed. structured leaves out fragments
    and numbers the other sentences anew."""
    gathered = tokens.groupBy("doc_id").agg(F.collect_list(F.struct(*TOKEN)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield _batch(pa.RecordBatch.from_arrays([part.column(0), pa.concat_arrays([part.column(1)])], names=["doc_id", "t"]), rarer)

    d = gathered.mapInArrow(run, f"doc_id bigint, sentences {_kind(pa.list_(SENTENCE))}")
    names = [f.name for f in SENTENCE if f.name not in ("_sdl", "_inner")]
    d = d.withColumn("sentences", F.transform("sentences", lambda s: F.struct(*[s[c].alias(c) for c in names], *[x.alias(c) for c, x in aggregate.sentence_means(lambda c: s[c]).items()])))
    scored = lambda s: S.difficulty(s["mean_log_word_frequency"], s["max_sdl"], s["content_words_per_clause"], s["proportion_of_concrete_nouns"])
    d = d.withColumn("sentences", F.transform("sentences", lambda s: s.withField("score", scored(s))))
    d = d.withColumn("sentences", F.transform("sentences", lambda s: s.withField("level", S.level(s["score"]))))
    if structured:
        d = d.withColumn("sentences", F.filter("sentences", lambda s: ~(s["level"].isNull() & T.is_fragment(s["sentence"]))))
        d = d.withColumn("sentences", F.transform("sentences", lambda s, n: s.withField("sent_idx", n)))
    return d.filter(F.size("sentences") > 0)


def scores() -> dict[str, Column]:
    """What aggregate.document_features has of a document's sentences, but the score and level, from their array."""
    each = lambda c: F.filter(F.transform("sentences", lambda s: s[c]), lambda x: x.isNotNull())
    total = lambda c: F.aggregate(each(c), F.lit(0.0), lambda a, x: a + x)
    mean = lambda c: F.aggregate(each(c), F.lit(0.0), lambda a, x: a + aggregate.steady(x)) / F.nullif(F.size(each(c)), F.lit(0))
    classed = total("concrete") + total("abstract") + total("undefined")
    return {
        "sentence_count": F.size("sentences").cast("long"),
        "mean_log_word_frequency": total("freq_sum") / F.nullif(total("freq_count"), F.lit(0.0)),
        "mean_max_sdl": mean("max_sdl"),
        "mean_content_words_per_clause": mean("content_words_per_clause"),
        "proportion_of_concrete_nouns": F.when(classed > 0, total("concrete") / classed),
        "min_score": F.array_min(each("score")),
        "max_score": F.array_max(each("score")),
    }
