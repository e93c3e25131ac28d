"""The editing model: word differences, clusters of competing suggestions, decisions, effective scores, the edited text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leesmaat.functions import score as S

STRIP = ".,;:!?…\"'“”‘’„()[]"


def normal(token: str, strip: str = STRIP) -> str:
    return token.lower().strip(strip)


def anchors(old: list[str], new: list[str], strip: str = STRIP) -> list[tuple[int, int]]:
    """Pairs of places of words that stay as they are, along a longest common subsequence of normalised words. Of equal
    alignments it is the one that keeps the last places: it is followed from the ends, and skips new words before old ones."""
    a, b = [normal(x, strip) for x in old], [normal(x, strip) for x in new]
    best = [[0] * (len(b) + 1)]
    for x in a:
        row, last = [0], best[-1]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else max(last[j], row[-1]))
        best.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            if old[i] == new[j]:
                out.append((i, j))
        elif best[i][j - 1] >= best[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def word_diff(old: list[str], new: list[str], strip: str = STRIP) -> list[tuple[int, int, int, int]]:
    """Regions (old start, old end, new start, new end) between the words that stay; kept words that look different count as
    changed."""
    out, i, j = [], 0, 0
    for k, m in [*anchors(old, new, strip), (len(old), len(new))]:
        if i < k or j < m:
            out.append((i, k, j, m))
        i, j = k + 1, m + 1
    return out


def affected(old: list[str], new: list[str], strip: str = STRIP) -> list[int]:
    """Places of the old words that a rewrite changes. Words that only move don't count, unless all do."""
    regions = word_diff(old, new, strip)
    spare: dict[str, int] = {}
    for _, _, a, b in regions:
        for w in new[a:b]:
            spare[normal(w, strip)] = spare.get(normal(w, strip), 0) + 1
    raw = [k for a, b, _, _ in regions for k in range(a, b)]
    changed = []
    for k in raw:
        w = normal(old[k], strip)
        if spare.get(w, 0) > 0:
            spare[w] -= 1
        else:
            changed.append(k)
    return changed or raw


def split_points(words: list[str], parts: int) -> list[int]:
    """Words behind which a sentence shown in so many parts is divided: a closing mark before a capital, at most parts - 1."""
    found = [k for k in range(len(words) - 1) if re.search(r"[.!?]$", words[k]) and re.match(r"[A-ZÀ-ÖØ-Þ]", words[k + 1])]
    return found[: max(0, parts - 1)]


def affected_words(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key, words (array of places in the old text) of each pair of texts; null texts count as empty."""
    schema = pa.schema([("key", pa.string()), ("words", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            rows = [(k, affected((o or "").split(), (n or "").strip("\"“”").split())) for k, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    src = pairs.select(F.col(key).cast("string").alias("key"), F.col(old).alias("o"), F.col(new).alias("n"))
    return src.mapInArrow(run, "key string, words array<int>").withColumnRenamed("key", key)


DIFF = pa.schema([("key", pa.string()), ("old_start", pa.int32()), ("old_end", pa.int32()), ("new_start", pa.int32()), ("new_end", pa.int32()), ("old_text", pa.string()), ("new_text", pa.string())])


def diffs(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key and one row per changed region of two texts; equal texts give none, a null text counts as empty."""

    def run(batches):
        for b in batches:
            rows = []
            for k, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a, c = (o or "").split(), (n or "").split()
                rows += [(k, *r, " ".join(a[r[0] : r[1]]), " ".join(c[r[2] : r[3]])) for r in word_diff(a, c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(DIFF.types)], schema=DIFF)

    src = pairs.select(F.col(key).cast("string").alias("key"), F.col(old).alias("o"), F.col(new).alias("n"))
    return src.mapInArrow(run, "key string, old_start int, old_end int, new_start int, new_end int, old_text string, new_text string").withColumnRenamed("key", key)


def apply_regions(tokens: list[str], regions: list[tuple[int, int, str]]) -> str:
    """Tokens with accepted regions (start, end, text) put in, from right to left; closing marks of the replaced words and a
    capital at the start are kept."""
    out = list(tokens)
    for start, end, text in sorted(regions, reverse=True):
        new = text.split()
        gone = out[start:end]
        if gone and new:
            tail = re.search(r"[.,;:!?…]+$", gone[-1])
            if tail and not re.search(r"[.,;:!?…]$", new[-1]):
                new[-1] += tail[0]
            if gone[0][:1].isupper() and start == 0:
                new[0] = new[0][:1].upper() + new[0][1:]
        out[start:end] = new
    return " ".join(out)


def clusters(suggestions: DataFrame) -> DataFrame:
    """doc_id, sent_idx, id, cluster: suggestions of a sentence that share a word form one cluster, named after its smallest id.

    suggestions: doc_id, sent_idx, id, words (array<int>). Links and enumerations stand alone. Each sentence is one small
    union-find; a sentence's suggestions are few by the planner's cap."""

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("sent_idx", pa.int32()), ("id", pa.string()), ("cluster", pa.string())])
        for b in batches:
            rows = []
            for d, s, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                up: dict[str, str] = {x["id"]: x["id"] for x in items}

                def find(x, up=up):
                    while up[x] != x:
                        up[x] = up[up[x]]
                        x = up[x]
                    return x

                owner: dict[int, str] = {}
                for x in sorted(items, key=lambda x: x["id"]):
                    if x["type"] in ("connective", "enumeration"):
                        continue
                    for w in x["words"] or []:
                        if w in owner:
                            a, c = sorted((find(owner[w]), find(x["id"])))
                            up[c] = a
                        else:
                            owner[w] = x["id"]
                rows += [(d, s, x, find(x)) for x in up]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    g = suggestions.groupBy("doc_id", "sent_idx").agg(F.collect_list(F.struct("id", "type", "words")).alias("items"))
    return g.mapInArrow(union, "doc_id bigint, sent_idx int, id string, cluster string")


def cluster_state(members: DataFrame) -> DataFrame:
    """doc_id, cluster, state: accepted if any member is, ignored if all are, else pending. members: doc_id, cluster, state."""
    return members.groupBy("doc_id", "cluster").agg(
        F.when(F.bool_or(F.col("state") == "accepted"), "accepted").when(F.bool_and(F.col("state") == "ignored"), "ignored").otherwise("pending").alias("state")
    )


def state_counts(states: DataFrame, by: list[str]) -> DataFrame:
    return states.groupBy(*by).agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("pending", "accepted", "ignored")])


SENTENCE_SCOPED = {"sentence_rewrite", "sentence_length", "max_sdl", "content_words_per_clause", "abstract_nouns", "passive", "subordinate_clause", "enumeration"}
COMPOSABLE = SENTENCE_SCOPED - {"enumeration"}  # rewrites that a link to the next sentence can carry


def conflicts(accepted: tuple, other: tuple, other_state: str) -> bool:
    """Whether accepting a suggestion sets another aside. Each is (sent_idx, cluster, type, second sentence of a link or None).

    The rest of a cluster goes. Rewrites of a whole sentence and changes of words in it exclude each other, accepted ones
    too; a list that is still open stays beside word changes. A link sets aside what is open on its second sentence, and on
    its first what it can't carry; and is set aside, while open, by what is accepted there."""
    sent, cluster, kind, second = accepted
    o_sent, o_cluster, o_kind, o_second = other
    pending = other_state == "pending"
    if kind == "connective":
        return pending and (o_sent == second or o_sent == sent and o_kind not in COMPOSABLE)
    if o_kind == "connective":
        return pending and (sent == o_second or sent == o_sent and kind not in COMPOSABLE)
    if pending and cluster == o_cluster:
        return True
    scoped, o_scoped = kind in SENTENCE_SCOPED, o_kind in SENTENCE_SCOPED
    if sent != o_sent or o_kind == "enumeration" and not scoped and other_state != "accepted":
        return False
    return (scoped or o_scoped) and other_state != "ignored"


def decide(log: pd.DataFrame) -> pd.DataFrame:
    """States of one document's suggestions after its decisions in order. Accepting one sets aside what conflicts with it;
    undoing brings back the open ones that this acceptance had set aside. A link needs the column `second`."""
    state: dict[str, str] = {}
    info: dict[str, tuple] = {}
    aside: dict[str, list[str]] = {}
    seconds = log["second"] if "second" in log.columns else pd.Series([None] * len(log), index=log.index)
    rows = log.assign(second=seconds).sort_values("seq")
    for r in rows.itertuples():
        second = None if r.second is None or pd.isna(r.second) else int(r.second)
        info[r.id] = (r.sent_idx, r.cluster, r.type, second)
        state.setdefault(r.id, "pending")
    for r in rows.itertuples():
        if r.action == "accept":
            lost = [x for x in info if x != r.id and state[x] != "ignored" and conflicts(info[r.id], info[x], state[x])]
            aside[r.id] = [x for x in lost if state[x] == "pending"]
            state.update(dict.fromkeys(lost, "ignored"))
            state[r.id] = "accepted"
        elif r.action == "ignore":
            state[r.id] = "ignored"
        elif r.action == "undo":
            for other in aside.pop(r.id, []):
                if state[other] == "ignored":
                    state[other] = "pending"
            state[r.id] = "pending"
    doc = int(log.doc_id.iloc[0])
    return pd.DataFrame({"doc_id": [doc] * len(state), "id": list(state), "state": list(state.values())})


def decisions(log: DataFrame) -> DataFrame:
    """doc_id, id, state. log: doc_id, seq, id, sent_idx, cluster, type, action (propose, accept, ignore, undo), and second for
    the second sentence of a link."""
    return log.groupBy("doc_id").applyInPandas(decide, "doc_id bigint, id string, state string")


def effective_sentences(sentences: DataFrame, accepted: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Features of each sentence as edited: those of its first accepted rewrite that has some, else its own; sentences absorbed by an accepted merge are gone.

    accepted: doc_id, sent_idx, rank and the mergeable features; absorbed: doc_id, sent_idx."""
    cols = ["freq_sum", "freq_count", "max_sdl", "content_words_per_clause", "concrete", "abstract", "undefined"]
    first = accepted.groupBy("doc_id", "sent_idx").agg(F.min_by(F.struct(*cols), "rank").alias("r"))
    j = sentences.join(absorbed, ["doc_id", "sent_idx"], "left_anti").join(first, ["doc_id", "sent_idx"], "left")
    return j.select("doc_id", "sent_idx", *[F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def effective_score(effective: DataFrame, original: DataFrame) -> DataFrame:
    """doc_id, score, level over effective features; where these lack an input, the original score."""
    classed = F.sum("concrete") + F.sum("abstract") + F.sum("undefined")
    e = effective.groupBy("doc_id").agg(
        F.expr("sum(freq_sum) / nullif(sum(freq_count), 0)").alias("f"), F.avg("max_sdl").alias("s"), F.avg("content_words_per_clause").alias("c"), F.when(classed > 0, F.sum("concrete") / classed).alias("p")
    )
    new = S.difficulty(F.col("f"), F.col("s"), F.col("c"), F.col("p"))
    j = original.select("doc_id", F.col("score").alias("_o")).join(e, "doc_id", "left").select("doc_id", F.coalesce(new, F.col("_o")).alias("score"))
    return j.withColumn("level", S.level(F.col("score")))


#: Dimension of the score that a type of suggestion works on.
DIMENSION = {"word_frequency": "frequency", "spelling": "frequency", "max_sdl": "dependency", "sentence_length": "dependency", "subordinate_clause": "dependency", "content_words_per_clause": "density", "passive": "density", "abstract_nouns": "concreteness"}


def diagnose(suggestions: DataFrame) -> DataFrame:
    """doc_id, dimension, total, remaining: clusters per dimension, and those still pending. suggestions: doc_id, cluster, state, types."""
    mapping = F.create_map(*[F.lit(x) for kv in DIMENSION.items() for x in kv])
    e = suggestions.select("doc_id", "cluster", "state", F.explode("types").alias("t")).withColumn("dimension", F.element_at(mapping, F.col("t"))).filter(F.col("dimension").isNotNull())
    return e.groupBy("doc_id", "dimension").agg(F.countDistinct("cluster").alias("total"), F.countDistinct(F.when(F.col("state") == "pending", F.col("cluster"))).alias("remaining"))


def edited_text(layout: DataFrame) -> DataFrame:
    """doc_id, text: a document put together again, list markers and quotation signs included. layout: doc_id, block_idx, type, text, ordered, number."""
    line = (
        F.when(F.col("type") == "list_item", F.concat(F.when(F.col("ordered"), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("- "), F.col("text")))
        .when(F.col("type") == "quote", F.concat(F.lit("> "), F.col("text")))
        .when(F.col("type") == "blank", F.lit(""))
        .otherwise(F.col("text"))
    )
    return layout.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
