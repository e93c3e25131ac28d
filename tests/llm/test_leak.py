"""Leaked passages against brute force."""

from __future__ import annotations

import random

from leesmaat.llm import leak


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = leak.words(t or "")
        for k in range(len(w) - leak.RUN + 1):
            grams.setdefault(tuple(w[k : k + leak.RUN]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leak.words(t or "")
        for k in range(len(w) - leak.RUN + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + leak.RUN]), ())}
    return out


def test_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["de", "het", "een", "café", "naar", "met", *(f"w{k}" for k in range(40))])
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 40)))) for i in range(30)] + [(90, None), (91, "")]
    items.append((92, items[0][1]))  # the same passage in two items
    docs = [(0, None), (1, ""), (2, "kort")]
    for d in range(3, 80):
        parts = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            src = rng.choice(items[:30])[1].split()
            k = rng.randrange(len(src))
            parts[rng.randint(0, len(parts)) :] = [w.upper().replace("É", "E") for w in src[k : k + rng.randint(8, 30)]] + parts[:5]
        docs.append((d, ",\n".join(parts)))
    docs.append((80, docs[10][1]))
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leak.leaks(d, i).collect()}
    assert got == brute(docs, items) and got


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    assert leak.leaks(d, i).count() == 0
    full = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "doc_id long, text string")
    assert leak.leaks(full, i.filter("false")).count() == 0
    assert [tuple(r) for r in leak.leaks(full, i).collect()] == [(1, 1)]


def test_longest_common_subsequence():
    import numpy as np

    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, (200, 9)), rng.integers(0, 5, (200, 6))

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for p in x:
            before = 0
            for j, q in enumerate(y, 1):
                before, row[j] = row[j], (before + 1 if p == q else max(row[j], row[j - 1]))
        return row[-1]

    assert leak.lcs(a, b).tolist() == [plain(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_paraphrases(spark):
    item = [f"w{k}" for k in range(30)]
    changed = item[5:17]
    changed[6] = "w6"  # one word of twelve is another of the passage
    d = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(item[3:20])), (3, " ".join(reversed(item)))], "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert (1, 7) in [tuple(r) for r in leak.leaks(d, i, near=True).collect()]
    assert [tuple(r) for r in leak.leaks(d, i).collect()] == [(2, 7)]


def brute_near(docs, items):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for p in x:
            before = 0
            for j, q in enumerate(y, 1):
                before, row[j] = row[j], (before + 1 if p == q else max(row[j], row[j - 1]))
        return row[-1]

    grams = {(i, tuple(w[k : k + leak.RUN])) for i, t in items for w in [leak.words(t or "")] for k in range(len(w) - leak.RUN + 1)}
    windows = {(d, tuple(w[k : k + leak.WINDOW])) for d, t in docs for w in [leak.words(t or "")] for k in range(max(1, len(w) - leak.WINDOW + 1))}
    return {(d, i) for d, w in windows for i, g in grams if len(set(w) & set(g)) > 4 and lcs(w, g) >= leak.NEAR_WORDS} - brute(docs, items)


def test_paraphrases_against_brute_force(spark):
    item = [f"w{k}" for k in range(30)]
    items = [(7, " ".join(item)), (8, "kort"), (9, None)]
    rng = random.Random(3)
    docs = [
        (1, " ".join([*item[4:10], "onbekend", *item[11:16]])),  # a word that no item uses in the middle
        (2, " ".join([*item[20:28], *item[2:6], "w25", *item[7:12], "w29", *item[13:15], *item[20:28]])),  # inside a longer stretch of known words
        (3, " ".join([*item[3:7], "x", "y", *item[7:11], "z", *item[11:14]])),  # unknown words inserted
        (4, " ".join([*item[3:7], "x", "y", "z", *item[10:14]])),  # three of twelve replaced
        (5, " ".join(item[3:20])),
        (6, None),
    ]
    for d in range(10, 60):
        k = rng.randrange(18)
        part = [w if rng.random() < 0.85 else rng.choice(["x", "y", *item]) for w in item[k : k + 12]]
        docs.append((d, " ".join([*rng.choices([*item, "x"], k=rng.randint(0, 20)), *part, *rng.choices([*item, "y"], k=rng.randint(0, 20))])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leak.leaks(d, i, near=True).collect()}
    assert got == brute_near(docs, items)
    assert {(1, 7), (2, 7), (3, 7)} <= got and not {(4, 7), (5, 7)} & got
    assert leak.leaks(d.filter("false"), i, near=True).count() == 0 and leak.leaks(d, i.filter("false"), near=True).count() == 0


def test_items_in_several_passes(spark):
    items = [(i, " ".join(f"w{i}_{k}" for k in range(20))) for i in range(9)]
    docs = [(i, "x y " + " ".join(t.split()[3:17])) for i, t in items]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in leak.leaks(d, i, block=3).collect()) == [(k, k) for k in range(9)]


def test_the_product_of_few_words_equals_that_of_the_matrix(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    size = 30
    codes = [rng.integers(0, size, rng.integers(12, 40)).tolist() for _ in range(12)]
    runs = spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "doc long, codes array<int>")
    idf, q = rng.uniform(0.5, 3, size), rng.standard_normal((size, 5))
    rows = []
    for c in codes:
        for at in range(0, len(c) - leak.RUN + 1, leak.STRIDE):
            x = np.bincount(c[at : at + leak.WINDOW], minlength=size) * idf
            rows.append(x / np.linalg.norm(x))
    a = np.array(rows)
    assert np.allclose(leak._gram_product(runs, idf, q), a.T @ (a @ q), rtol=1e-4, atol=1e-4)
    df = leak.document_frequencies(runs, size)
    assert df[size] == len(a) and (df[:size] == (a > 0).sum(0)).all()
