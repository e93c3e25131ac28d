"""Sentences of blocks: joins of short ones, fragments, the layout, Markdown; all against plain rules."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from leesmaat.api import Readability
from leesmaat.operators import structure
from leesmaat.sources import lexicons


def joined(sentences):
    """Sentences as lists of tokens, the short ones joined to the next, one after the other."""
    out, k = [], 0
    while k < len(sentences):
        s = sentences[k]
        if sum(t[0].isalnum() for t in s) <= 2 and s[-1] not in ".!?" and k + 1 < len(sentences):
            out.append(s + sentences[k + 1])
            k += 2
        else:
            out.append(s)
            k += 1
    return out


def test_short_sentences_join_in_pairs(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for block in range(60):
        sentences = [[rng.choice(["de", "kat", "12", ","]) for _ in range(rng.randint(1, 5))] + ([rng.choice("…….!?")] if k < 8 else []) for k in range(rng.randint(1, 9))]
        flat = [t for s in sentences for t in s]
        split, at = [], []
        for t in flat:
            at.append(t)
            if t in ".!?…":
                split.append(at)
                at = []
        split += [at] if at else []
        want[block] = [" ".join(s) for s in joined(split)]
        rows += [(1, block, i, t) for i, t in enumerate(flat)]
    df = spark.createDataFrame(rows, "doc_id long, block_idx int, i int, text string")
    got = structure.sentence_texts(structure.numbered(structure.merged(structure.segmented(df)))).orderBy("sent_idx").collect()
    assert [r["sentence"] for r in got] == [s for b in sorted(want) for s in want[b]]
    assert [r["sent_idx"] for r in got] == list(range(len(got)))


MARKDOWN = "# Een kop\n\n- de **rode** kat slaapt op de mat\n- de hond\n\n```\ncode = hier\n```\n\nDe man loopt over de straat. Hij ziet het huis.\n\n> Een citaat van een ander."


def analysis(spark, text, **more):
    freq = spark.createDataFrame([("straat", 4.0), ("mat", 3.0), ("huis", 4.5), ("kat", 3.3)], "word string, word_count double")
    docs = spark.createDataFrame([(5, text, 1)], "doc_id long, text string, sent_idx int")
    return Readability(lexicons.derived(freq)).analyze(docs, **more)


def test_markdown_reaches_tokens_and_scores(spark):
    a = analysis(spark, MARKDOWN, format="markdown")
    sentences = [r["sentence"] for r in a.kept.orderBy("sent_idx").collect()]
    assert sentences == ["de rode kat slaapt op de mat", "de hond", "De man loopt over de straat .", "Hij ziet het huis ."]
    words = {r["text"] for r in a.tokens.collect()}
    assert not words & {"`", "-", "#", "code", "kop", "citaat"}
    shown = [(r["type"], r["text"]) for r in a.layout.orderBy("block_idx", "part").collect() if r["type"] != "blank"]
    assert shown[0] == ("heading", "Een kop") and shown[1][0] == "list_item" and shown[-1] == ("quote", "Een citaat van een ander.")
    assert a.scores.first()["sentence_count"] == a.sentences.count()
    assert [r["sent_idx"] for r in a.sentences.orderBy("sent_idx").collect()] == list(range(a.sentences.count()))
    plain = analysis(spark, MARKDOWN, structure=False)
    assert plain.tokens.filter("text = 'code'").count() == 1


def test_fragments_leave_and_become_headings(spark):
    a = analysis(spark, "De man loopt over de straat naar het huis.\nJa hoor.\nHij ziet het grote huis en de rode kat.")
    kept = [(r["sentence"], r["new_idx"]) for r in a.kept.orderBy("sent_idx").collect()]
    assert kept == [("De man loopt over de straat naar het huis .", 0), ("Ja hoor .", None), ("Hij ziet het grote huis en de rode kat .", 1)]
    assert [(r["type"], r["sentences"]) for r in a.layout.orderBy("block_idx", "part").collect()] == [("sentence", [0]), ("heading", None), ("sentence", [1])]
    assert {r["sent_idx"] for r in a.features.collect()} == {0, 1} == {r["sent_idx"] for r in a.tokens.collect()}
    assert [r["paragraph"] for r in structure.paragraphs(a.layout).orderBy("sent_idx").collect()] == [0, 1]


def test_an_annotator_gets_blocks(spark):
    def parser(blocks):
        t = blocks.select("doc_id", "block_idx", F.posexplode(F.split("text", " ")).alias("i", "text"))
        return t.select("doc_id", "block_idx", F.lit(0).alias("sent_idx"), "i", "text", F.lower("text").alias("lower"), F.lower("text").alias("lemma"), F.lit("NOUN").alias("pos"), F.lit("N").alias("tag"), F.when(F.col("i") == 0, "root").otherwise("nmod").alias("dep"), F.lit(0).alias("head"), F.lit(None).cast("string").alias("ent_type"), F.lit(False).alias("is_punct"), F.lit(True).alias("is_alpha"))

    freq = spark.createDataFrame([("straat", 4.0)], "word string, word_count double")
    docs = spark.createDataFrame([(1, "kop\nde man loopt nu.\n\nhij ziet het huis."), (2, None), (3, "")], "doc_id long, text string")
    t = Readability(lexicons.derived(freq), annotator=parser).analyze(docs).tokens.orderBy("i").collect()
    assert [(r["sent_idx"], r["i"], r["text"], r["head"]) for r in t] == [(0, 0, "de", 0), (0, 1, "man", 0), (0, 2, "loopt", 0), (0, 3, "nu.", 0), (1, 4, "hij", 4), (1, 5, "ziet", 4), (1, 6, "het", 4), (1, 7, "huis.", 4)]
