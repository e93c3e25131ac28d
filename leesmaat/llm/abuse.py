"""Problem 9: abusive, hateful and sexual language.

FTRL-proximal logistic regression over hashed word n-grams and skip-grams of sentences. Its per-coordinate rates suit the
few labels, and its L1 term leaves so few weights that they travel to every executor. Readers label documents, not
sentences, so training goes in rounds: first every sentence of a labelled document counts, then those that the model of the
round before finds responsible. A document's score for a category is that of its worst sentence; every word of every text
is read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leesmaat.llm.common import bounded_rows, spread, table

CATEGORIES = ("abusive", "hateful", "sexual")
SAMPLE_POSITIVE, SAMPLE_NONE = 1_500, 2_500  # labelled documents the model is fitted on, at most
BITS = 22
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.6, 0.5
FOLDS, EPOCHS, BATCH = 3, 3, 128
LIFT = 1.5  # how much more frequent a feature must be in texts of a category than in all
LEAST_TEXTS = 2  # texts a feature must occur in
CLEAN_QUANTILES = (0.998, 0.9993, 0.9996)  # by round: a responsible sentence scores above this share of the sentences of clean texts
THRESHOLD = 0.5
LEAST_CONFIRMED = 3  # texts of a category with a sentence that others confirm; with fewer there is no model for it
MOST_WRONG = 0.01  # share of clean texts that a model of other texts may score at THRESHOLD; with more there is none either

# Digits and signs that stand for letters.
LEET = str.maketrans("0134579@$!", "oieastgasi")
SIGNS = re.compile(r"(?<=[^\W\d_])[@$!]+(?=[^\W_])|(?<![\w.@])[@$](?=[^\W\d_]{3,}\b(?!\.|@))")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_*·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_]|[.\-_*·][^\W_])")
STARS = re.compile(r"(?<![\w*])[^\W\d_]\w*\*+\w*(?![\w*])")
REPEAT = re.compile(r"([^\W\d_])\1{2,}")
MASKED = "maskedword"
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?…]+(?=[\s\"”’»)]|$)|[.!?](?=[A-ZÀ-Þ])|\n\s*\n|[。！？।]")
EDGE = np.uint64(0x51ED270B7F1A3C95)  # a sentence's edge

def reveal(text: str) -> str:
    """The text without disguises that cross the bounds of words: spaced and dotted letters, stars, signs for letters."""
    t = SPACED.sub(lambda m: re.sub(r"[\W_]", "", m.group()), text)
    if "*" in t:
        t = STARS.sub(lambda m: MASKED, t)
    if "@" in t or "$" in t or "!" in t:
        t = SIGNS.sub(lambda m: m.group().translate(LEET), t)
    return t


def plain_word(word: str) -> str:
    """A word without disguises inside it: digits for letters, where it has two letters at least, and stretched letters."""
    if re.search(r"\d", word) and sum(c.isalpha() for c in word) >= 2:
        word = word.translate(LEET)
    return REPEAT.sub(r"\1", word)


class Numbers(dict):
    """Running numbers of words, and the hash behind each; marks between sentences are one word, number 0."""

    def __init__(self):
        super().__init__()
        self.hashes = [int(EDGE)]

    def __missing__(self, w: str) -> int:
        if not w or not w[0].isalnum():
            n = 0
        elif (bare := plain_word(w)) != w:
            n = self[bare]
        else:
            n = len(self.hashes)
            self.hashes.append(xxhash.xxh64_intdigest(w))
        self[w] = n
        return n


class Reader:
    """Turns texts into word hashes, remembering the words it has met up to a limit."""

    LIMIT = 500_000

    def __init__(self):
        self.known = Numbers()

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, each followed by an edge, and the text each stands in."""
        if len(self.known) > self.LIMIT:
            self.known = Numbers()
        numbers, sizes, number = [], [], self.known.__getitem__
        for t in texts:
            tokens = "\0".join(TOKEN.findall(reveal(t))).lower().split("\0")
            numbers += map(number, tokens)
            numbers.append(0)
            sizes.append(len(tokens) + 1)
        return np.array(self.known.hashes, np.uint64)[np.array(numbers, np.int64)], np.repeat(np.arange(len(texts)), sizes)


SHIFT = np.uint64(64 - BITS)
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def grams(h: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sentence number of each word, and (bucket, position) of unigrams, bigrams, trigrams and skip-grams within sentences."""
    edge = h == EDGE
    sentence = np.cumsum(edge) - edge
    inside = ~edge
    out = []
    with np.errstate(over="ignore"):
        at = np.flatnonzero(inside)
        out.append(((h[at] * K1) >> SHIFT, at))
        at = np.flatnonzero(inside[1:]) + 1  # the first word pairs with the edge before it
        out.append(((((h[at - 1] * K2) ^ h[at]) * K1) >> SHIFT, at))
        for gap in (2, 3):
            ok = inside[gap:] & inside[:-gap] & (sentence[gap:] == sentence[:-gap])
            at = np.flatnonzero(ok) + gap
            out.append(((((h[at - gap] * K2) ^ (h[at] * np.uint64(2 * gap + 1))) * K3) >> SHIFT, at))
        ok = inside[2:] & (sentence[2:] == sentence[1:-1]) & inside[1:-1]
        at = np.flatnonzero(ok) + 2
        out.append(((((((h[at - 2] * K3) ^ h[at - 1]) * K2) ^ h[at]) * K1) >> SHIFT, at))
    return sentence, [(b.astype(np.int64), p) for b, p in out]


@dataclass
class Ftrl:
    """One model per category; z and n are the state of FTRL-proximal, weights follow from them."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls) -> Ftrl:
        return cls(np.zeros((len(CATEGORIES), (1 << BITS) + 1), np.float32), np.zeros((len(CATEGORIES), (1 << BITS) + 1), np.float32))

    def weights(self, c: int, at: np.ndarray) -> np.ndarray:
        z, n = self.z[c, at], self.n[c, at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0, w)

    def update(self, c: int, at: np.ndarray, row: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        """One step over a few sentences: (row, at) are their features."""
        u, back = np.unique(at, return_inverse=True)
        w = self.weights(c, u)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[back], len(target)), -30, 30)))
        g = np.bincount(back, ((p - target) * weight)[row], len(u)).astype(np.float32)
        n = self.n[c, u]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[c, u] += g - sigma * w
        self.n[c, u] = n + g * g


BIAS = 1 << BITS


@dataclass
class Sentences:
    """Features of the training sentences in rows, and the text each is from."""

    bucket: np.ndarray
    starts: np.ndarray
    home: np.ndarray

    def features(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(local row, bucket) of all features of the sentences ids, with the bias."""
        n = self.starts[ids + 1] - self.starts[ids]
        local = np.repeat(np.arange(len(ids)), n)
        flat = np.arange(len(local)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[ids], n)
        return np.concatenate([local, np.arange(len(ids))]), np.concatenate([self.bucket[flat], np.full(len(ids), BIAS)])


def _train_one(model: Ftrl, c: int, s: Sentences, ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
    model.z[c], model.n[c] = 0, 0
    rng = np.random.default_rng(7)
    ids = ids[weight[ids] > 0]
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(ids), max(1, len(ids) // BATCH)):
            local, at = s.features(part)
            model.update(c, at, local, target[part], weight[part])


def _score(model: Ftrl, c: int, s: Sentences, ids: np.ndarray) -> np.ndarray:
    local, at = s.features(ids)
    u, back = np.unique(at, return_inverse=True)
    return np.bincount(local, model.weights(c, u)[back], len(ids))


def fit(texts: list[str], labels: list[dict[str, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse weights (buckets, values) of each category. labels: share of a text's votes by category; all none: {}.

    Features that are no more frequent in texts of the category than elsewhere are left out. In each round the texts are
    split in folds; the sentences of a fold are judged by a model of the other folds, so that a wrongly labelled text, whose
    sentences nothing elsewhere confirms, drops out instead of being learnt by heart. A category with too few confirmed
    texts, or whose models of other folds fail on clean texts, gets no weights: nothing is found for it."""
    nothing = (np.empty(0, np.int64), np.empty(0, np.float32))
    if not texts:
        return [nothing] * len(CATEGORIES)
    h, doc = Reader().read(texts)
    sentence, parts = grams(h)
    total, count = int(sentence[-1]) + 1, len(texts)
    all_bucket = np.concatenate([b for b, _ in parts])
    all_row = np.concatenate([sentence[p] for _, p in parts])
    home = np.zeros(total, np.int64)
    home[sentence] = doc
    once = np.unique(all_bucket * count + home[all_row])
    of_bucket, of_text = once // count, once % count
    everywhere = np.bincount(of_bucket, minlength=1 << BITS)
    clean = np.array([not x for x in labels])
    fold = np.arange(count) % FOLDS
    result, model = [], Ftrl.empty()
    for c, name in enumerate(CATEGORIES):
        vote = np.array([x.get(name, 0.0) for x in labels])
        inside = np.bincount(of_bucket[vote[of_text] > 0], minlength=1 << BITS)
        share = max(1, np.count_nonzero(vote)) / count
        keep = ((inside >= LEAST_TEXTS) & (inside > LIFT * share * everywhere))[all_bucket]
        bucket, row = all_bucket[keep], all_row[keep]
        order = np.argsort(row, kind="stable")
        s = Sentences(bucket[order], np.searchsorted(row[order], np.arange(total + 1)), home)
        used = np.flatnonzero(s.starts[1:] > s.starts[:-1])
        positive = vote[home] > 0
        other = ~positive & ~clean[home]  # a text with another category only tells little about this one
        size = np.bincount(home[used], minlength=count)
        target = positive.astype(np.float64)
        weight = np.where(positive, vote[home] * 4 / np.maximum(size[home], 4), np.where(other, 0.25, 1.0))
        for quantile in (*CLEAN_QUANTILES, None):  # the last pass only judges
            score = np.full(total, -50.0)
            for f in range(FOLDS):
                held = fold[home[used]] == f
                _train_one(model, c, s, used[~held], target, weight)
                score[used[held]] = _score(model, c, s, used[held])
            if quantile is None:
                break
            lines = score[used][clean[home[used]]]
            floor = np.quantile(lines, quantile) if len(lines) else -50.0
            chosen = positive & (score > floor)
            target = chosen.astype(np.float64)
            weight = np.where(chosen, 2.0 * np.maximum(vote[home], 0.5), np.where(positive, 0.0, np.where(other, 0.25, 1.0)))
        _train_one(model, c, s, used, target, weight)
        found = np.bincount(home[score >= 0.0], minlength=count) > 0  # by models of other texts
        confirmed, wrong = np.count_nonzero(found & (vote > 0)), np.count_nonzero(found & clean)
        bias = float(model.weights(c, np.array([BIAS]))[0])
        if confirmed < LEAST_CONFIRMED or wrong > MOST_WRONG * max(1, np.count_nonzero(clean)) or bias >= 0:
            result.append(nothing)
            continue
        at = np.flatnonzero(np.abs(model.z[c]) > L1)
        result.append((at, model.weights(c, at).astype(np.float32)))
    return result


class Scorer:
    def __init__(self, sparse: list[tuple[np.ndarray, np.ndarray]]):
        self.reader, self.dense = Reader(), np.zeros((len(CATEGORIES), (1 << BITS) + 1), np.float32)
        for c, (at, w) in enumerate(sparse):
            self.dense[c, at] = w
            if not len(at):
                self.dense[c, BIAS] = -50.0  # no model, no score
        self.any = (self.dense[:, :BIAS] != 0).any(0)  # a small table that tells the few buckets that matter

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability by text and category: that of the worst sentence."""
        if not texts:
            return np.zeros((0, len(CATEGORIES)))
        h, doc = self.reader.read(texts)
        sentence, parts = grams(h)
        total = int(sentence[-1]) + 1
        home = np.zeros(total, np.int64)
        home[sentence] = doc
        out = np.zeros((len(texts), len(CATEGORIES)))
        hits = [(b[hit], sentence[p[hit]]) for b, p in parts for hit in [np.flatnonzero(self.any[b])]]
        bucket, row = np.concatenate([b for b, _ in hits]), np.concatenate([r for _, r in hits])
        for c in range(len(CATEGORIES)):
            s = np.bincount(row, self.dense[c, bucket], total) + float(self.dense[c, BIAS])
            best = np.full(len(texts), -50.0)
            np.maximum.at(best, home, s)
            out[:, c] = 1 / (1 + np.exp(-np.clip(best, -50, 50)))
        return out


def train(documents: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights from labelled documents: at most SAMPLE_POSITIVE with a category and SAMPLE_NONE without, by hash order."""
    votes = labels.filter(F.col("doc_id").isNotNull() & F.col("category").isNotNull()).groupBy("doc_id").agg(
        *[(F.count(F.when(F.col("category") == c, 1)) / F.count("*")).alias(c) for c in CATEGORIES]
    )
    positive = sum((F.col(c) for c in CATEGORIES), F.lit(0.0)) > 0

    def pick(df: DataFrame, limit: int) -> DataFrame:
        return df.orderBy(F.xxhash64("doc_id")).limit(limit)

    sample = pick(votes.filter(positive), SAMPLE_POSITIVE).unionByName(pick(votes.filter(~positive), SAMPLE_NONE))
    rows = bounded_rows(documents.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(sample), "doc_id"), SAMPLE_POSITIVE + SAMPLE_NONE, "the sample")
    rows = sorted(rows, key=lambda r: r["doc_id"])
    texts = [r["text"] for r in rows]
    shares = [{c: float(r[c]) for c in CATEGORIES if r[c]} for r in rows]
    return fit(texts, shares)


def scores(documents: DataFrame, weights: list[tuple[np.ndarray, np.ndarray]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and a score from 0 to 1 for each category; null and blank texts score 0."""
    held = documents.sparkSession.sparkContext.broadcast(weights)  # bounded by L1 and the sample, not by the corpus
    schema = pa.schema([("key", pa.int64()), *((c, pa.float64()) for c in CATEGORIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                s = scorer.score(texts)
                s[[not t.strip() for t in texts]] = 0.0
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(s[:, c]) for c in range(len(CATEGORIES)))], schema=schema)

    src = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return spread(src).mapInArrow(run, "key bigint, " + ", ".join(f"{c} double" for c in CATEGORIES)).withColumnRenamed("key", key)


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scores(documents, train(documents, table(spark, sf_dir, "content_labels")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.filter(F.array(*[F.when(F.col(c) >= THRESHOLD, F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull())
    return p9_scores(spark, sf_dir).select("doc_id", F.explode(hit).alias("category"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and share of each category per source; a null source is one of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    s = p9_scores(spark, sf_dir).join(docs, "doc_id")
    rate = [F.round(F.avg((F.col(c) >= THRESHOLD).cast("double")), 6).alias(f"{c}_rate") for c in CATEGORIES]
    return s.groupBy("source").agg(F.count("*").alias("documents"), *rate)
