"""Problem 8: evaluation items whose passages stand in documents.

Latent semantic retrieval. A document's passages are the stretches of words that occur in the items at all; only such a
stretch of RUN words or more can hold a case. Windows of passages and all RUN-word grams of items become TF-IDF vectors
in the space of a distributed randomised SVD. An item's gram is a candidate for a window if their cosine reaches the
window's own threshold: the lowest cosine between the window and any gram it contains. A gram that stands in the window
is as near as the window's own copy of it, so no case falls below. Candidates are then checked for the longest run of
words they share.

Near cases have words that no item uses, and no cosine bounds a longest common subsequence, so they are searched over all
words of a document: a window that has NEAR_WORDS of a gram has one of any RUN - NEAR_WORDS + 1 places of it, so the rarest
ones lead to every candidate."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leesmaat.llm.common import bounded_rows, cut, per_row, spread, table

RUN = 12  # consecutive words that make a case
WINDOW, STRIDE = 16, 5  # every run of RUN words lies whole in a window: STRIDE = WINDOW - RUN + 1
DIMENSIONS, OVERSAMPLE, POWER = 64, 8, 2
ITEMS = 20_000  # items that are searched for in one pass over the documents; more are taken in blocks
BLOCK = 20_000  # grams of items that are searched in one pass
SLACK = 1e-3  # rounding of cosines
NEAR_WORDS = 10  # a paraphrase: WINDOW consecutive words hold so many of a gram's RUN words in the same order
CELLS = 4_000_000  # numbers of a dense block of TF-IDF or cosines

WORD = re.compile(r"[^\W_]+")
MARKS = re.compile("[̀-ͯ]+")


def words(text: str) -> list[str]:
    """Runs of letters or digits in lower case without accents."""
    t = text.lower()
    return WORD.findall(t if t.isascii() else MARKS.sub("", unicodedata.normalize("NFKD", t)))


def passages(codes: list[int]) -> Iterator[list[int]]:
    """Stretches of at least RUN known words; -1 stands for an unknown one."""
    at = 0
    for i, c in enumerate([*codes, -1]):
        if c < 0:
            if i - at >= RUN:
                yield codes[at:i]
            at = i + 1


@dataclass
class Space:
    """A latent vector for each word of the items' vocabulary, and the items' grams."""

    latent: np.ndarray
    grams: np.ndarray
    owner: np.ndarray
    unit: np.ndarray


def _units(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.where(n > 1e-6, v / np.maximum(n, 1e-6), 0).astype(np.float32)


def _windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a list column, and for each window its row, start and end in them."""
    ends, codes = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
    codes, ends = codes[ends[0] : ends[-1]], ends - ends[0]
    n = (ends[1:] - ends[:-1] - RUN) // STRIDE + 1
    row = np.repeat(np.arange(len(n)), n)
    start = ends[:-1][row] + STRIDE * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    return codes, row, start, np.minimum(start + WINDOW, ends[1:][row])


def _cells(codes: np.ndarray, start: np.ndarray, end: np.ndarray, pad: int) -> np.ndarray:
    """The codes of each window in a row of WINDOW, padded."""
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], codes[np.minimum(at, len(codes) - 1)], pad)


def _window_rows(batches: Iterator[pa.RecordBatch], size: int, limit: int = CELLS // WINDOW) -> Iterator[np.ndarray]:
    """Padded word codes of windows in blocks of bounded memory."""
    for b in batches:
        codes, _, start, end = _windows(b.column("codes"))
        for lo in range(0, len(start), limit):
            yield _cells(codes, start[lo : lo + limit], end[lo : lo + limit], size)


def document_frequencies(runs: DataFrame, size: int) -> np.ndarray:
    """Windows that hold each word, and their number at the end; one row per word and task is added up."""
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(size + 1, np.int64)
        for w in _window_rows(batches, size):
            ranked = np.sort(w, axis=1)
            once = np.ones(w.shape, bool)
            once[:, 1:] = ranked[:, 1:] != ranked[:, :-1]  # a window counts once for a word
            held = np.bincount(ranked[once], minlength=size + 1)
            held[size] = len(w)
            total += held
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], schema=schema)

    out = np.zeros(size + 1, np.int64)
    for r in runs.mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():  # vocabulary rows
        out[r["word"]] = r["n"]
    return out


def _gram_product(runs: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'(A q) of the TF-IDF matrix A of all windows, rows of unit length; each task returns one partial product."""
    size = len(idf)
    held = runs.sparkSession.sparkContext.broadcast((idf.astype(np.float32), q.astype(np.float32)))
    schema = pa.schema([("word", pa.int32()), ("axis", pa.int32()), ("value", pa.float64())])

    def product(batches):
        weight, basis = held.value
        z = np.zeros((size + 1, basis.shape[1]), np.float64)
        for w in _window_rows(batches, size, max(600, CELLS // (size + 1))):
            words, place = np.unique(w, return_inverse=True)  # a block has columns for its own words only
            flat = (place.reshape(w.shape) + np.arange(len(w))[:, None] * len(words)).ravel()
            a = np.bincount(flat, minlength=len(w) * len(words)).reshape(len(w), len(words)).astype(np.float32)
            a *= np.where(words < size, weight[np.minimum(words, size - 1)], 0)  # the padding weighs nothing
            a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
            z[words] += a.T @ (a @ basis[np.minimum(words, size - 1)])
        z = z[:size]
        used = np.flatnonzero(z.any(1))
        r, c = np.repeat(used, z.shape[1]), np.tile(np.arange(z.shape[1]), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(z[used].ravel())], schema=schema)

    out = np.zeros(q.shape)
    for r in runs.mapInArrow(product, "word int, axis int, value double").groupBy("word", "axis").agg(F.sum("value").alias("value")).collect():  # vocabulary x dimensions
        out[r["word"], r["axis"]] = r["value"]
    return out


def latent_space(runs: DataFrame, size: int, grams: np.ndarray) -> np.ndarray:
    """Latent vector of each word: idf times its row of the leading right singular vectors of the windows' TF-IDF matrix."""
    df = document_frequencies(runs, size)
    in_items = np.bincount(np.unique(grams + np.arange(len(grams))[:, None] * size) % size, minlength=size) if len(grams) else np.zeros(size)
    idf = np.log((df[size] + len(grams) + 1.0) / (df[:size] + in_items + 1.0)) + 0.05
    rank = min(size, DIMENSIONS + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((size, rank)))[0]
    for _ in range(POWER):
        z = _gram_product(runs, idf, q)
        q = np.linalg.qr(z + 1e-9 * q)[0]
    z = _gram_product(runs, idf, q)
    values, vectors = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    basis = q @ vectors[:, np.argsort(values)[::-1][:DIMENSIONS]]
    return (idf[:, None] * basis).astype(np.float32)


def _search(space: Space, doc: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, gram) of the candidates of some passages whose longest common run with the gram is RUN words."""
    codes, row, start, end = _windows(column)
    sums = np.concatenate([np.zeros((1, space.latent.shape[1])), np.cumsum(space.latent[codes], 0, dtype=np.float64)])
    own, vectors = _units(sums[RUN:] - sums[:-RUN]), _units(sums[end] - sums[start])
    limit = np.full(len(start), 2.0, np.float32)
    for s in range(WINDOW - RUN + 1):  # the window's own grams; one that vanishes in the space lets every candidate in
        at = np.flatnonzero(start + s + RUN <= end)
        g = own[start[at] + s]
        limit[at] = np.minimum(limit[at], np.where(g.any(1), np.einsum("ij,ij->i", g, vectors[at]), -2))
    limit -= SLACK
    step, found = max(1, CELLS // max(1, len(space.unit))), []
    for lo in range(0, len(start), step):
        at, gram = np.nonzero(vectors[lo : lo + step] @ space.unit.T >= limit[lo : lo + step, None])
        cells = _cells(codes, start[lo : lo + step], end[lo : lo + step], -1)[at]
        same = np.zeros(len(at), bool)
        for s in range(WINDOW - RUN + 1):
            same |= (cells[:, s : s + RUN] == space.grams[gram]).all(1)
        found.append((doc[row[lo + at[same]]], gram[same]))
    return (np.concatenate([d for d, _ in found]), np.concatenate([g for _, g in found])) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def lcs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows; one programme runs for all pairs."""
    best = np.zeros((len(a), b.shape[1] + 1), np.int16)
    for x in range(a.shape[1]):
        new = best.copy()
        same = a[:, x : x + 1] == b
        np.maximum(new[:, 1:], np.where(same, best[:, :-1] + 1, 0), out=new[:, 1:])
        best = np.maximum.accumulate(new, axis=1)
    return best[:, -1]


@dataclass
class Seeds:
    """The items' grams with the number of their item, and for each word (from start[w] to start[w + 1]) the grams and the
    places in them that it leads to. `order` has a gram's places from the rarest on."""

    grams: np.ndarray
    owner: np.ndarray
    order: np.ndarray
    start: np.ndarray
    gram: np.ndarray
    place: np.ndarray


def seeds(grams: np.ndarray, owner: np.ndarray, frequency: np.ndarray) -> Seeds:
    """Every gram under its RUN - NEAR_WORDS + 1 rarest places: a case misses RUN - NEAR_WORDS at most, so it has one."""
    order = np.argsort(frequency[grams], axis=1, kind="stable")
    place = order[:, : RUN - NEAR_WORDS + 1]
    word = np.take_along_axis(grams, place, 1).ravel()
    by = np.argsort(word, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(frequency)))]).astype(np.int64)
    return Seeds(grams, owner, order, start, by // place.shape[1], place.ravel()[by])


def _near(s: Seeds, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, exact) of the words of some documents: exact ones hold a whole gram of the item, the others WINDOW words
    with NEAR_WORDS of a gram in their order."""
    ends, values = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
    n = np.diff(ends)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) + WINDOW * (row + 1)  # gaps around each document keep windows inside it
    codes = np.full(len(row) + WINDOW * (len(n) + 1), -1, np.int64)
    codes[at] = values[ends[0] : ends[-1]]
    first, many = s.start[codes[at]], np.where(codes[at] < 0, 0, s.start[codes[at] + 1] - s.start[codes[at]])
    at, row, first, many = (x[many > 0] for x in (at, row, first, many))
    upto, most, lo = np.cumsum(many), CELLS // (2 * WINDOW), 0
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))]
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        m = many[lo:hi]
        e = np.repeat(first[lo:hi] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        p, r, g, o = np.repeat(at[lo:hi], m), np.repeat(row[lo:hi], m), s.gram[e], s.place[e]
        missing = np.zeros(len(p), np.int8)
        for k in range(RUN):  # words of the gram that don't stand in any window of the seed
            w, absent = s.grams[g, s.order[g, k]], np.ones(len(p), bool)
            for x in range(1 - WINDOW, WINDOW):
                absent &= codes[p + x] != w
            missing += absent
            keep = missing <= RUN - NEAR_WORDS
            p, r, g, o, missing = p[keep], r[keep], g[keep], o[keep], missing[keep]
        exact = (codes[(p - o)[:, None] + np.arange(RUN)] == s.grams[g]).all(1)
        pair = r * (s.owner.max() + 1) + s.owner[g]
        found.append((r[exact], s.owner[g[exact]], np.ones(exact.sum(), bool)))
        rest = ~np.isin(pair, pair[exact])
        begin = (p[rest, None] - np.arange(WINDOW)).ravel()
        r, g = np.repeat(r[rest], WINDOW), np.repeat(g[rest], WINDOW)
        _, once = np.unique(begin * len(s.grams) + g, return_index=True)
        for x in range(0, len(once), most):
            i = once[x : x + most]
            i = i[lcs(codes[begin[i, None] + np.arange(WINDOW)], s.grams[g[i]]) >= NEAR_WORDS]
            found.append((r[i], s.owner[g[i]], np.zeros(len(i), bool)))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def near_leaks(documents: DataFrame, rows: list[tuple[int, list[int]]], vocabulary: dict[str, int], key: str, text: str, item: str) -> DataFrame:
    """(key, item) of every document that holds no RUN consecutive words of the item, but WINDOW with NEAR_WORDS of such a
    run in their order. rows: the items' numbers and words."""
    spark = documents.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)  # words of the evaluation set
    schema = pa.schema([("doc", pa.int64()), ("codes", pa.list_(pa.int32()))])

    def read(k, t):
        get = known.value.get
        codes = [get(w, -1) for w in words(t)]
        return [(k, codes)] if sum(c >= 0 for c in codes) >= NEAR_WORDS else []

    src = documents.filter(F.length(text) > 0).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    coded = cut(spread(src).mapInArrow(lambda bs: per_row(bs, read, schema), "doc bigint, codes array<int>"), "codes")
    frequency = np.zeros(len(vocabulary), np.int64)
    for r in coded.select(F.explode("codes").alias("word")).filter("word >= 0").groupBy("word").count().collect():  # vocabulary rows
        frequency[r["word"]] = r["count"]
    ids = np.array([i for i, _ in rows], np.int64)
    found = [(n, ws[a : a + RUN]) for n, (_, ws) in enumerate(rows) for a in range(len(ws) - RUN + 1)]
    grams, owner = np.array([g for _, g in found], np.int64).reshape(-1, RUN), np.array([n for n, _ in found], np.int64)
    out_schema = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("exact", pa.bool_())])
    hits = None
    for lo in range(0, max(1, len(grams)), BLOCK):  # a block of item grams against all documents
        held = spark.sparkContext.broadcast((ids, seeds(grams[lo : lo + BLOCK], owner[lo : lo + BLOCK], frequency)))

        def search(batches, held=held):
            ids, s = held.value
            for b in batches:
                for at in range(0, b.num_rows, 1_024):
                    part = b.slice(at, 1_024)
                    d, i, exact = _near(s, part.column("codes"))
                    doc, owner = part.column("doc").to_numpy()[d], ids[i]
                    pairs = np.unique(np.stack([doc, owner, exact.astype(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64()), pa.array(pairs[2] > 0)], schema=out_schema)

        found_here = spread(coded).mapInArrow(search, "doc bigint, item bigint, exact boolean")
        hits = found_here if hits is None else hits.unionByName(found_here)
    return hits.groupBy("doc", "item").agg(F.max("exact").alias("exact")).filter("not exact").select(F.col("doc").alias(key), F.col("item").alias(item))


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", near: bool = False, block: int = ITEMS) -> DataFrame:
    """(key, item) of every document that holds RUN consecutive words of an item. Null and short texts hold none; items
    that share a passage are all named; equal rows give one. Both keys are integers. With `near`, instead, documents with a
    passage that has most of RUN words of an item in their order, but no such run. More than `block` items are searched for
    in several passes over the documents, so that what is broadcast stays bounded."""
    texts = items.select(F.col(item).alias("i"), F.col("text").alias("t")).filter(F.col("t").isNotNull() & F.col("i").isNotNull()).distinct()
    passes = max(1, -(-texts.count() // block))
    out = None
    for n in range(passes):
        part = texts if passes == 1 else texts.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == n)
        found = _leaks(documents, bounded_rows(part, 2 * block + 100, "a block of the evaluation set"), key, text, item, near)
        out = found if out is None else out.unionByName(found)
    return out


def _leaks(documents: DataFrame, rows: list, key: str, text: str, item: str, near: bool) -> DataFrame:
    spark = documents.sparkSession
    worded = [(r["i"], words(r["t"])) for r in rows]
    vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in worded for w in ws}))}
    if near:
        return near_leaks(documents, [(i, [vocabulary[w] for w in ws]) for i, ws in sorted(worded)], vocabulary, key, text, item)
    found = [(i, [vocabulary[w] for w in ws[a : a + RUN]]) for i, ws in sorted(worded) for a in range(len(ws) - RUN + 1)]
    grams = np.array([g for _, g in found], np.int64).reshape(-1, RUN)
    owner = np.array([i for i, _ in found], np.int64)
    schema = pa.schema([("doc", pa.int64()), ("codes", pa.list_(pa.int32()))])
    known = spark.sparkContext.broadcast(vocabulary)  # words of the evaluation set

    def read(k, t):
        get = known.value.get
        return ((k, p) for p in passages([get(w, -1) for w in words(t)]))

    src = documents.filter(F.length(text) > 0).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    runs = cut(spread(src).mapInArrow(lambda bs: per_row(bs, read, schema), "doc bigint, codes array<int>"), "passages")
    latent = latent_space(runs, len(vocabulary), grams)
    out_schema = pa.schema([("doc", pa.int64()), ("item", pa.int64())])
    hits = None
    for lo in range(0, max(1, len(grams)), BLOCK):  # a block of item grams against all passages
        g = grams[lo : lo + BLOCK]
        unit = _units(latent[g].sum(1, dtype=np.float64))
        held = spark.sparkContext.broadcast(Space(latent, g, owner[lo : lo + BLOCK], unit))

        def search(batches, held=held):
            space = held.value
            for b in batches:
                for at in range(0, b.num_rows, 2_048):
                    part = b.slice(at, 2_048)
                    d, g = _search(space, part.column("doc").to_numpy(), part.column("codes"))
                    pairs = np.unique(np.stack([d, space.owner[g]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], schema=out_schema)

        found_here = spread(runs).mapInArrow(search, "doc bigint, item bigint")
        hits = found_here if hits is None else hits.unionByName(found_here)
    return hits.distinct().select(F.col("doc").alias(key), F.col("item").alias(item))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an item with a few words changed, and the passage itself nowhere."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), near=True)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: its suite and split, and how many documents hold a passage of it; items that no document holds have 0."""
    items = table(spark, sf_dir, "heldout_items").select("item_id", "suite", "split")
    n = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.join(n, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
