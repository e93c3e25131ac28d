"""The classifier: disguises, learning, scoring as a whole."""

from __future__ import annotations

import random

import numpy as np

from leesmaat.llm import abuse


def bare(text):
    return " ".join(map(abuse.plain_word, abuse.reveal(text).split()))


def test_disguises():
    assert bare("d3b13l m i s l u k k e l i n g h.a.l.v.e g--k eiiiikel") == "debiel mislukkeling halve g--k eikel"
    assert bare("r*t en **vet** op 27a, 3e") == f"{abuse.MASKED} en **vet** op 27a, 3e"
    assert bare("kl@tz@k leuk!") == "klatzak leuk!"
    numbers = abuse.Numbers()
    assert numbers["d3b13l"] == numbers["debiel"] != numbers["eikel"] and numbers["."] == 0


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["De man loopt over de straat.", "Het brood ligt op de tafel.", "De rat woont in de kelder.", "Morgen regent het weer.", "De school is open."]
    bad = {"abusive": ["Jij bent een vieze {}.", "Rot op, stomme {}!"], "hateful": ["Alle {} moeten weg.", "Stuur die {} terug."], "sexual": ["Hij kreunde en likte haar {}.", "Geile {} zoeken seks."]}
    slot = ["rat", "varken", "mensen", "buren"]
    texts, labels = [], []
    for _ in range(n):
        t = [rng.choice(plain) for _ in range(6)]
        label = {}
        if rng.random() < 0.4:
            c = rng.choice(list(bad))
            t.insert(rng.randrange(6), rng.choice(bad[c]).format(rng.choice(slot)))
            label = {c: 1.0}
        texts.append(" ".join(t))
        labels.append(label)
    for k in range(0, n, 25):  # wrong labels
        labels[k] = {} if labels[k] else {"abusive": 1.0}
    return texts, labels


def test_held_out_accuracy():
    texts, labels = corpus(400, 1)
    model = abuse.fit(texts, labels)
    held, truth = corpus(200, 2)
    p = abuse.Scorer(model).score(held)
    right = [[(x >= abuse.THRESHOLD) == bool(t.get(c)) for x, c in zip(row, abuse.CATEGORIES, strict=True)] for k, (row, t) in enumerate(zip(p, truth, strict=True)) if k % 25]
    assert np.mean(right) > 0.97


def test_table(spark):
    texts, labels = corpus(200, 3)
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)] + [(900, None, 1.0), (901, " ", 1.0), (902, (texts[0] + " ") * 300, 1.0)], "doc_id long, text string, sexual double")
    votes = spark.createDataFrame([(k, c) for k, x in enumerate(labels) for c in (x or {"none": 1})] + [(None, "abusive"), (3, None)], "doc_id long, category string")
    s = abuse.scores(docs, abuse.train(docs, votes)).collect()
    assert len(s) == 203 and all(0 <= r[c] <= 1 for r in s for c in abuse.CATEGORIES)
    assert all(r["abusive"] == 0 for r in s if r["doc_id"] in (900, 901))
    assert abuse.scores(docs.filter("false"), abuse.train(docs, votes.filter("false"))).count() == 0


def test_too_few_labels_find_nothing():
    texts, labels = corpus(30, 5)
    few = [x if k == next(i for i, y in enumerate(labels) if y) else {} for k, x in enumerate(labels)]
    for weights in (abuse.fit(texts, few), abuse.fit(texts, [{} for _ in texts]), abuse.fit([], [])):
        p = abuse.Scorer(weights).score(texts)
        assert p.shape == (30, 3) and (p < abuse.THRESHOLD).all()
