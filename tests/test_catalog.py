"""Queries against their SQL, the facade, streams."""

from __future__ import annotations

import json
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from leesmaat import catalog, workspace
from leesmaat.api import Readability
from leesmaat.operators import triggers
from leesmaat.sources import lexicons
from leesmaat.streaming import scoring


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6f}" if isinstance(v, int | float | Decimal) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalog.SQL:
        assert df.columns
        return
    cursor = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    places = [names.index(c) for c in df.columns]
    assert Counter(tuple(norm(r[i]) for i in places) for r in cursor.fetchall()) == Counter(tuple(map(norm, r)) for r in rows)


def test_null_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "   ", "z"), (4, "De kat loopt over de straat.", "q")], "doc_id long, text string, sent_idx string")
    freq = spark.createDataFrame([("straat", 4.0)], "word string, word_count double")
    a = Readability(lexicons.derived(freq)).analyze(docs)
    assert [r["doc_id"] for r in a.scores.collect()] == [4]
    assert a.payload().count() == 1 and a.plan(cap=3).filter("doc_id <> 4").count() == 0
    empty = Readability(lexicons.derived(freq)).analyze(docs.filter("false"))
    assert empty.scores.count() == 0 and empty.triggers().count() == 0 and empty.blocks.count() == 0


def test_document_streams(spark, tmp_path):
    freq = spark.createDataFrame([("straat", 4.0)], "word string, word_count double")
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "De kat loopt over de straat."), (2, None)], "doc_id long, text string").write.parquet(src)
    q = scoring.score_stream(spark.readStream.schema("doc_id long, text string").parquet(src), lexicons.derived(freq), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_decision_stream(spark, tmp_path):
    src, schema = str(tmp_path / "log"), "doc_id long, seq long, id string, sent_idx int, cluster string, type string, action string"
    rows = [(1, 0, "a", 0, "a", "sentence_rewrite", "propose"), (1, 1, "b", 0, "b", "word_frequency", "propose"), (1, 2, "a", 0, "a", "sentence_rewrite", "accept")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    out = scoring.decision_stream(spark.readStream.schema(schema).parquet(src))
    q = out.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["id"], r["state"]) for r in spark.sql("select * from states").collect()} == {("a", "accepted"), ("b", "ignored")}


def test_payload_writes_no_tokens(spark, sf):
    catalog.forget()
    since = workspace.mark(spark)
    got = catalog.QUERIES["q_payload"](spark, sf)
    assert workspace.mark(spark) == since  # tokens and features took many times the room of the texts
    assert got.count() == catalog.analysis(spark, sf).scores.count()


def test_payload_of_blocks_leaves_fragments_out(spark):
    docs = spark.createDataFrame([(1, "De kat loopt snel over de brede straat.\n\nZie hier: Het kind werd door de grote hond gezien."), (2, "Lees dit:\n\nDe vrouw leest een mooi boek in de tuin. Ja."), (3, "Titel")], "doc_id long, text string")
    freq = spark.createDataFrame([("straat", 4.0), ("hond", 5.5), ("boek", 3.25)], "word string, word_count double")
    a = Readability(lexicons.derived(freq)).analyze(docs)
    got = {r["doc_id"]: json.loads(r["payload"]) for r in a.payload().collect()}
    scores = {r["doc_id"]: r for r in a.scores.collect()}
    assert set(got) == set(scores)
    rows = {(r["doc_id"], r["sent_idx"]): r for r in a.sentences.collect()}
    assert {(d, s["sent_idx"]) for d, p in got.items() for s in p["sentences"]} == set(rows)
    for d, p in got.items():
        assert p.get("document_score") == scores[d]["score"] and p.get("min_score") == scores[d]["min_score"]
        for s in p["sentences"]:
            r = rows[d, s["sent_idx"]]
            assert (s.get("lint_score"), s.get("max_sdl"), s["content_words_per_clause"]) == (r["score"], r["max_sdl"], r["content_words_per_clause"])


def test_structured_triggers_write_no_tokens(spark, sf):
    catalog.forget()
    since = workspace.mark(spark)
    got = catalog.QUERIES["q_structured_triggers"](spark, sf).collect()
    written = {p.rsplit("/", 1)[-1].split("-")[1] for p in workspace._written[spark.sparkContext.applicationId][since:]}
    assert written == {"unwrapped", "rare"}  # tokens and features took many times the room of the texts
    a = catalog.by_blocks(spark, sf)
    whole = triggers.detect(a.sentences, a.features, a.lexicons)
    assert Counter((r["doc_id"], r["sent_idx"], r["type"], r["i"], r["word"]) for r in got) == Counter((r["doc_id"], r["sent_idx"], r["type"], r["i"], r["word"]) for r in whole.collect())
