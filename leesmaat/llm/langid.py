"""Language posteriors by naive Bayes over hashed character n-grams, trained on a bounded sample of labelled texts.

A language with few texts has many n-grams its texts don't show, which would make every short text look like the language
with the most. So each language's distribution is mixed with that of its most frequent words and with the mean of all
languages, which bounds what a single unseen n-gram can say."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leesmaat.llm.common import bounded_rows

SAMPLE = 4_000  # labelled texts, about; the sample is the same for the same table
TAGS = 1_000  # different language tags at most
BUCKETS = 1 << 15
ORDERS = (2, 3)
BLOCK = 200_000  # characters judged at once
APART = chr(0x10FFFF)  # stands between texts that are judged at once; no text has this non-character
LEAST_LETTERS = 8  # fewer letters say nothing about the language
MARGIN = 4.0  # nats by which one language must beat another
COMMON_SHARE = 0.2  # weight of the most frequent words against that of a language's texts
BACKGROUND, FLOOR = 0.1, 0.1  # share of the mean of all languages in each, and of the even distribution in that
# The most frequent words of languages that share a script, forty each.
COMMON = {
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit door over ze hij naar heeft wordt deze wat kan was worden geen meer of die",
    "en": "the of and to a in is that for it was on are with as be at one by this have from or an they which you were all we who their has more when so not what can does",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas ne ce il avec sont se aux cette mais ou son leur elle été nous vous comme peu autre deux",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ha me si sin sobre este entre cuando muy también hasta desde otra poco",
}
# Other codes of a language.
CODES = {"dut": "nl", "nld": "nl", "eng": "en", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "rus": "ru", "ara": "ar", "hin": "hi", "jpn": "ja", "zho": "zh", "chi": "zh", "tha": "th"}


def code(lang: str | None) -> str | None:
    """Two-letter code of a language tag, None for none."""
    if not lang or not lang.strip():
        return None
    low = lang.strip().lower()
    return CODES.get(low, CODES.get(low[:3], low[:2]) if len(low) == 3 else low[:2])


@lru_cache(maxsize=1)
def _apart() -> np.ndarray:
    """By code point: whether it is neither a letter nor a mark on one. Points beyond the first plane count as letters."""
    out = np.array([unicodedata.category(chr(i))[0] not in "LM" for i in range(1 << 16)])
    out[-1] = False
    return out


def _codes(text: str) -> np.ndarray:
    """Code points of the letters in lower case, words set apart by one blank."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    apart = _apart()[np.minimum(codes, 0xFFFF)]
    keep = ~apart
    keep[1:] |= apart[1:] & ~apart[:-1]
    keep[0] = True
    return np.where(apart, np.uint32(32), codes)[keep].astype(np.uint64)


def features(text: str) -> np.ndarray:
    """Bucket numbers of the character n-grams of a text."""
    return _features(_codes(text))


def _by_order(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for n in ORDERS:
        if len(codes) < n:
            break
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h * np.uint64(1_000_003)) ^ codes[j : len(codes) - n + 1 + j]
        h ^= h >> np.uint64(17)
        h *= np.uint64(0x9E3779B97F4A7C15)
        yield n, ((h >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


def _features(codes: np.ndarray) -> np.ndarray:
    out = [b for _, b in _by_order(codes)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def letters(text: str) -> int:
    return int((_codes(text) != 32).sum())


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # log probability by bucket and language
    prior: np.ndarray

    def scores(self, text: str) -> np.ndarray:
        return self.judge(text)[0]

    def judge(self, text: str) -> tuple[np.ndarray, int]:
        """Log posteriors, up to a constant, and the number of letters they rest on."""
        codes = _codes(text)
        # n-grams of one text depend on each other: their mean over orders behaves like independent evidence
        return self.weights[_features(codes)].sum(0) / len(ORDERS) + self.prior, int((codes != 32).sum())

    def judge_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for many texts at once: rows of log posteriors, and letters."""
        scores, seen, at = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK):
                size += len(texts[to])
                to += 1
            codes = _codes(f" {APART} ".join(t.replace(APART, " ") for t in texts[at:to]))
            between = codes == ord(APART)
            home = np.cumsum(between)
            inside = codes != 32
            seen[at:to] = np.bincount(home[inside & ~between], minlength=to - at)
            for n, buckets in _by_order(codes):
                ok = ~between[: len(buckets)]
                for j in range(1, n):
                    ok &= ~between[j : j + len(buckets)]
                row, w = home[: len(buckets)][ok], self.weights[buckets[ok]]
                if len(row):
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    scores[at + row[first]] += np.add.reduceat(w, first, axis=0, dtype=np.float64)
            at = to
        return scores / len(ORDERS) + self.prior, seen

    def posterior(self, text: str) -> np.ndarray:
        s = self.scores(text)
        p = np.exp(s - s.max())
        return p / p.sum()

    def language(self, text: str) -> str | None:
        return self.langs[int(self.scores(text).argmax())] if letters(text) >= LEAST_LETTERS else None


def fit(texts: list[tuple[str, str]], sizes: dict[str, int] | None = None) -> Model:
    """Model of (language, text) pairs; a second round leaves out texts whose label the first round strongly denies.
    sizes: how many texts of each language there are, where the pairs are a sample that doesn't show it."""
    common = {x: np.bincount(features(t), minlength=BUCKETS) for x, t in COMMON.items()}
    model = None
    for _ in range(2):
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for lang, text in texts:
            if model is not None:
                s = model.scores(text)
                if s.max() - s[model.langs.index(lang)] > 20:
                    continue
            counts.setdefault(lang, np.zeros(BUCKETS)).__iadd__(np.bincount(features(text), minlength=BUCKETS))
            docs[lang] = docs.get(lang, 0) + 1
        langs = sorted(counts)
        own = np.stack([counts[x] / max(1.0, counts[x].sum()) + (COMMON_SHARE * common[x] / common[x].sum() if x in common else 0.0) for x in langs])
        own /= np.maximum(own.sum(1, keepdims=True), 1e-9)
        shared = own.mean(0) + FLOOR / BUCKETS
        weights = np.log((1 - BACKGROUND) * own + BACKGROUND * shared / shared.sum())
        n = np.array([(sizes or docs).get(x, 0) + 1.0 for x in langs])
        prior = np.log(n / n.sum())
        model = Model(langs, np.ascontiguousarray(weights.T, np.float32), prior)
    return model


def train(labelled: DataFrame, lang: str, text: str, key: str, sample: int = SAMPLE) -> Model:
    """Model of a table with language tags; rows without tag or text are left out, wrong tags are outvoted. Every language has
    the same part of the sample, or all its texts if they are fewer; a row is drawn by the hash of its key, so that only the
    sample itself is ever sent anywhere. Without any such row, the frequent words are all there is."""
    tags = bounded_rows(labelled.filter(F.col(lang).isNotNull()).groupBy(lang).agg(F.count("*").alias("n")), TAGS, "the set of language tags")
    sizes: dict[str, int] = {}
    for tag, n in tags:
        if code(tag):
            sizes[code(tag)] = sizes.get(code(tag), 0) + n
    if not sizes:
        return fit(list(COMMON.items()))
    quota = sample / len(sizes)
    share = F.create_map(*[F.lit(x) for tag, _ in tags if code(tag) for x in (tag, min(1.0, quota / sizes[code(tag)]))])
    drawn = labelled.filter((F.length(F.trim(text)) >= 20) & (F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < share[F.col(lang)] * (1 << 30)))
    rows = bounded_rows(drawn.select(lang, text), 2 * sample, "the sample")  # of which about half is expected
    return fit(sorted((code(a), t) for a, t in rows if code(a)) or list(COMMON.items()), sizes)
