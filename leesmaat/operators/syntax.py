"""Dependency structure: chains of conjuncts, heads, dependency length, subtrees.

Sentences are gathered into arrays, which moves nothing when tokens are already dealt by document, and a whole batch of
them is worked on at once: links are followed for all tokens side by side, so the cost is the depth of the trees, not the
square of the sentence length. Nothing is joined and no pair of tokens is written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GUARD = 50  # links of a chain of conjuncts that are followed
DEEPEST = 10_000  # links to the root; a cycle is cut off here


def _places(row: np.ndarray, i: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of token wanted[k] of row[k] in (row, i), which is sorted; the place k itself where there is none."""
    span = int(i.max()) + 2 if len(i) else 2
    keys = row.astype(np.int64) * span + i
    at = np.searchsorted(keys, row.astype(np.int64) * span + np.clip(wanted, 0, span - 1))
    at = np.minimum(at, len(keys) - 1)
    return np.where((row[at] == row) & (i[at] == wanted), at, np.arange(len(i)))


def structure(row: np.ndarray, i: np.ndarray, head: np.ndarray, dep: np.ndarray, verb: np.ndarray) -> dict[str, np.ndarray | list]:
    """The added columns of tokens sorted by sentence and place."""
    n = len(i)
    here = np.arange(n)
    up = _places(row, i, head)
    conj = (dep == "conj") & (up != here)
    base = here.copy()
    for _ in range(GUARD):
        step = np.where(conj[base], up[base], base)
        if (step == base).all():
            break
        base = step
    # a running count of words turns a distance between words into a difference
    word = (dep != "punct").astype(np.int64)
    before = np.cumsum(word) - word
    main = up[base]
    members = np.bincount(base, minlength=n)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(low, base, before)
    np.maximum.at(high, base, before)
    group = base[main]
    many = (dep[base] == "nsubj") & (members[group] > 1)
    lo, hi = np.where(many, low[group], before[main]), np.where(many, high[group], before[main])
    far = np.maximum(np.abs(hi - before), np.abs(before - lo)) - 1
    length = np.where(word == 1, np.maximum(far, 0), 0)
    size, verbs, conjs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    is_conj = (dep == "conj").astype(np.int64)
    alive, at = here, here
    for _ in range(DEEPEST):
        size += np.bincount(at, minlength=n)
        verbs += np.bincount(at, verb[alive], n).astype(np.int64)
        conjs += np.bincount(at, is_conj[alive], n).astype(np.int64)
        on = (up[at] != at) & (up[at] != alive)
        alive, at = alive[on], up[at[on]]
        if not len(at):
            break
    order = np.argsort(base, kind="stable")
    first = np.searchsorted(base[order], here)
    heads = [[h] for h in i[main].tolist()]
    for k in np.flatnonzero(many).tolist():
        g = group[k]
        heads[k] = sorted({*heads[k], *i[order[first[g] : first[g] + members[g]]].tolist()})
    return {"base": i[base], "base_dep": dep[base], "dep_length": length, "subtree_size": size, "subtree_verbs": verbs, "subtree_conj": conjs, "heads": heads}


def parse(tokens: DataFrame) -> DataFrame:
    """tokens with base (end of the chain of conj links), base_dep, heads (all heads a token counts as having), dep_length
    (most words between it and one of them, 0 for marks), and the size, verbs and conjuncts of its subtree.

    A conjunct has the head of its base; if the base is a subject of coordinated words, all of these are heads. A head that
    is not in the sentence counts as none."""
    names = [c for c in tokens.columns if c not in ("doc_id", "sent_idx")]
    sentences = tokens.groupBy("doc_id", "sent_idx").agg(F.collect_list(F.struct(*names)).alias("t"))
    inner = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in tokens.schema if f.name in names)
    kinds = [("base", pa.int32()), ("base_dep", pa.string()), ("dep_length", pa.int32()), ("subtree_size", pa.int32()), ("subtree_verbs", pa.int32()), ("subtree_conj", pa.int32()), ("heads", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column("t")
            offsets = t.offsets.to_numpy()
            flat = t.flatten()
            row = np.repeat(np.arange(len(t)), np.diff(offsets))
            get = lambda c: flat.field(c)
            i = get("i").to_numpy()
            head = get("head").fill_null(-1).to_numpy()
            dep = get("dep").fill_null("").to_numpy(zero_copy_only=False)
            verb = pc.match_substring(get("tag").fill_null(""), "WW").to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((i, row))
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            out = structure(row[order], i[order], head[order], dep[order], verb[order])
            lists = pa.array(offsets - offsets[0], pa.int32())
            added = []
            for name, kind in kinds:
                values = pa.array([out[name][k] for k in back] if isinstance(out[name], list) else out[name][back], kind)
                added.append(pa.ListArray.from_arrays(lists, values))
            plain = pa.ListArray.from_arrays(lists, flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), plain, *added], names=["doc_id", "sent_idx", "t", *(n for n, _ in kinds)])

    ddl = f"doc_id bigint, sent_idx int, t array<struct<{inner}>>, base array<int>, base_dep array<string>, dep_length array<int>, subtree_size array<int>, subtree_verbs array<int>, subtree_conj array<int>, heads array<array<int>>"
    done = sentences.mapInArrow(run, ddl)
    zipped = F.arrays_zip("t", *[n for n, _ in kinds])
    flat = done.select("doc_id", "sent_idx", F.explode(zipped).alias("x"))
    return flat.select("doc_id", "sent_idx", *[F.col(f"x.t.{n}").alias(n) for n in names], *[F.col(f"x.{n}").alias(n) for n, _ in kinds])


def heads(parsed: DataFrame) -> DataFrame:
    """doc_id, sent_idx, i, head: a row per token and head."""
    return parsed.select("doc_id", "sent_idx", "i", F.explode("heads").alias("head"))


def subtree_texts(parsed: DataFrame, where) -> DataFrame:
    """doc_id, sent_idx, i, span: the words of the subtree of every token that meets a condition, in text order."""
    schema = pa.schema([("doc_id", pa.int64()), ("sent_idx", pa.int32()), ("i", pa.int32()), ("span", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, s, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                items.sort(key=lambda x: x["i"])
                up, wanted = {x["i"]: x["head"] for x in items}, {x["i"]: [] for x in items if x["wanted"]}
                for x in items:
                    at, seen = x["i"], set()
                    while at in up and at not in seen:
                        seen.add(at)
                        if at in wanted:
                            wanted[at].append(x["text"])
                        at = up[at]
                rows += [(d, s, i, " ".join(words)) for i, words in wanted.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    items = F.collect_list(F.struct("i", "head", "text", F.coalesce(where, F.lit(False)).alias("wanted")))
    g = parsed.groupBy("doc_id", "sent_idx").agg(items.alias("t")).filter(F.exists("t", lambda x: x["wanted"]))
    return g.mapInArrow(run, "doc_id bigint, sent_idx int, i int, span string")
