"""Queries without SQL over the tables, each against a plain restatement."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict

from leesmaat import catalog
from leesmaat.operators import editor


def changes(spark, sf):
    return {r["suggestion_id"]: ((r["o"] or "").split(), (r["r"] or "").split()) for r in catalog.pairs(spark, sf).collect()}


def test_differences_rebuild_every_suggestion(spark, sf):
    both = changes(spark, sf)
    regions = defaultdict(list)
    for r in catalog.QUERIES["q_word_diff"](spark, sf).collect():
        assert (r["old_text"], r["new_text"]) == tuple(" ".join(x) for x in (both[r["suggestion_id"]][0][r["old_start"] : r["old_end"]], both[r["suggestion_id"]][1][r["new_start"] : r["new_end"]]))
        regions[r["suggestion_id"]].append((r["old_start"], r["old_end"], r["new_start"], r["new_end"]))
    for key, (old, new) in both.items():
        out = list(old)
        for a, b, x, y in sorted(regions[key], reverse=True):
            out[a:b] = new[x:y]
        assert out == new


def test_affected_words_are_words_that_are_gone(spark, sf):
    both = changes(spark, sf)
    rows = catalog.QUERIES["q_affected_words"](spark, sf).collect()
    assert {r["suggestion_id"] for r in rows} == set(both)
    for r in rows:
        old, new = both[r["suggestion_id"]][0], [w for w in " ".join(both[r["suggestion_id"]][1]).strip("\"“”").split()]
        left = Counter(map(editor.normal, new))
        gone = Counter(map(editor.normal, old)) - left
        touched = Counter(editor.normal(old[k]) for k in r["words"])
        assert not gone - touched  # every word that is gone is affected
        assert all(0 <= k < len(old) for k in r["words"]) and len(set(r["words"])) == len(r["words"])


def test_payloads_hold_all_sentences_and_tokens(spark, sf):
    a = catalog.analysis(spark, sf)
    tokens = defaultdict(lambda: defaultdict(list))
    for r in a.tokens.select("doc_id", "sent_idx", "i", "text", "tag", "pos").orderBy("doc_id", "i").collect():
        tokens[r["doc_id"]][r["sent_idx"]].append((r["text"], r["tag"], r["pos"]))
    scores = {r["doc_id"]: r for r in a.scores.collect()}
    got = {r["doc_id"]: json.loads(r["payload"]) for r in catalog.QUERIES["q_payload"](spark, sf).collect()}
    assert set(got) == set(tokens)
    for d, p in got.items():
        assert [s["sent_idx"] for s in p["sentences"]] == sorted(tokens[d])
        for s in p["sentences"]:
            assert [(w["text"], w["tag"], w["pos"]) for w in s["word_features"]] == tokens[d][s["sent_idx"]]
        assert p.get("document_score") == scores[d]["score"] and p["sentence_count"] == scores[d]["sentence_count"]


def test_fields_of_answers(spark, sf):
    answers = {str(r["response_id"]): r["content"] for r in catalog.table(spark, sf, "llm_responses").dropDuplicates(["response_id"]).collect()}
    name = re.compile(r"[#\s]*(?:\*\*|__)?\s*([A-ZÀ-Þ][A-ZÀ-Þ _]*?)\s*(?:\*\*|__)?\s*:\s*(?:\*\*|__)?")
    for r in catalog.QUERIES["q_response_fields"](spark, sf).collect():
        text = re.sub(r"(?s)<think>.*?</think>", "", answers[r["response_id"]] or "")
        want = {re.sub(r"\s+", "_", m[1]) for line in text.splitlines() if (m := name.match(line))}
        fields = json.loads(r["fields"])
        assert set(fields) == want and all(w in text for v in fields.values() for w in v.split())
    blocks = catalog.QUERIES["q_response_blocks"](spark, sf).collect()
    assert all(json.loads(r["fields"])["WOORD"] for r in blocks)
    by_answer = Counter(r["response_id"] for r in blocks)
    for key, text in answers.items():
        parts = re.split(r"(?m)^\s*-{3,}\s*$", re.sub(r"(?s)<think>.*?</think>", "", text or ""))
        assert by_answer[key] == sum(bool(re.search(r"(?m)^[#\s]*(?:\*\*|__)?\s*WOORD\s*(?:\*\*|__)?\s*:[ \t]*(?:\*\*|__)?[ \t]*\S", p)) for p in parts)


def test_markdown_blocks_keep_the_words(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in catalog.table(spark, sf, "documents").filter("format = 'markdown'").collect()}
    found = defaultdict(list)
    for r in catalog.QUERIES["q_markdown_blocks"](spark, sf).collect():
        found[r["doc_id"]].append(r)
    for d, rows in found.items():
        rows.sort(key=lambda r: r["block_idx"])
        assert [r["block_idx"] for r in rows] == list(range(len(rows))) and rows[0]["type"] != "blank" != rows[-1]["type"]
        words = Counter(w for r in rows for w in re.findall(r"[^\W_]+", r["text"]))
        assert not words - Counter(re.findall(r"[^\W_]+", docs[d]))
        assert all((r["number"] is not None) == (r["type"] == "list_item") for r in rows)
