"""Dictionaries with affixes, models over HTTP, results that go on, payloads with suggestions, files."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from leesmaat import Readability
from leesmaat.functions import text as T
from leesmaat.operators import connectors, generation, stats
from leesmaat.sources import dictionary, documents, eval_items, lexicons

AFF = """SET UTF-8
FORBIDDENWORD !
NEEDAFFIX ~
SFX A Y 2
SFX A 0 en [^ef]
SFX A f ven f
SFX B Y 1
SFX B 0 je/A .
PFX C Y 1
PFX C 0 her .
SFX D N 1
SFX D 0 s .
"""


def test_affixes():
    r = dictionary.parse_affixes(AFF)
    assert dictionary.expand("boek/AC", r) == ["boek", "boeken", "herboek", "herboeken"]
    assert dictionary.expand("brief/A", r) == ["brief", "brieven"] and dictionary.expand("los", r) == ["los"]
    assert dictionary.expand("huis/B", r) == ["huis", "huisje"]  # no ending for a word in e
    assert dictionary.expand("auto/CD", r) == ["auto", "autos", "herauto"]  # D goes with no prefix
    assert dictionary.expand("fout/!A", r) == [] and dictionary.expand("ling/~A", r) == ["lingen"] and dictionary.expand("  ", r) == []
    num = dictionary.parse_affixes("FLAG num\nSFX 12 Y 1\nSFX 12 0 s .\n")
    assert dictionary.expand("tafel/12,7", num) == ["tafel", "tafels"]


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "x.dic").write_text("3\nboek/AC\nbrief/A\nboek\n\n")
    (tmp_path / "x.aff").write_text(AFF)
    got = sorted(r["word"] for r in dictionary.read(spark, str(tmp_path / "x.dic"), str(tmp_path / "x.aff")).collect())
    assert got == ["boek", "boeken", "brief", "brieven", "herboek", "herboeken"]
    assert sorted(r["word"] for r in dictionary.read(spark, str(tmp_path / "x.dic")).collect()) == ["boek", "brief"]


class Service(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append((self.path, dict(self.headers), body))
        text = f"echo {body['messages'][-1]['content']}"
        answer = {"/messages": {"content": [{"text": text}]}, "/chat": {"message": {"content": text}}, "/v1": {"choices": [{"message": {"content": text}}]}}.get(self.path)
        self.send_response(200 if answer else 500)
        self.end_headers()
        self.wfile.write(json.dumps(answer or {}).encode())

    def log_message(self, *args):
        pass


def test_models_over_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        for provider, path in (("openai", "/v1"), ("mistral", "/v1"), ("hetzner", "/v1"), ("mlx", "/v1"), ("anthropic", "/messages"), ("ollama", "/chat")):
            m = connectors.model(provider, url=at + path, key="k")()
            assert m.complete("wees kort", "dag", 9) == "echo dag"
            _, headers, body = Service.seen[-1]
            assert body["model"] == m.model and "wees kort" in json.dumps(body)
            assert 9 in (body.get("max_tokens"), body.get("options", {}).get("num_predict"))
            if provider == "anthropic":
                assert {k.lower(): v for k, v in headers.items()}["x-api-key"] == "k"
        jobs = spark.createDataFrame([("1", "s", "a"), ("2", "s", "b")], "k string, s string, u string")
        from leesmaat.operators import rewrite

        assert {r["k"]: r["content"] for r in rewrite.run_jobs(jobs, connectors.model("ollama", url=at + "/chat"), "k", "s", "u").collect()} == {"1": "echo a", "2": "echo b"}
        bad = rewrite.run_jobs(jobs, connectors.model("openai", url=at + "/none"), "k", "s", "u").collect()
        assert all(r["content"] is None and "500" in r["error"] for r in bad)
    finally:
        server.shutdown()
    for wrong in ({"provider": "elders"}, {"provider": "hetzner"}):
        with pytest.raises(ValueError):
            connectors.model(**wrong)


def test_results_go_on(spark, tmp_path):
    path = str(tmp_path / "r")
    df = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id string, produced string")
    assert eval_items.record(df("a", "b"), path) == 2 and eval_items.record(df("b", "c"), path) == 1 and eval_items.record(df("c"), path) == 0
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    assert [r["id"] for r in eval_items.pending(df("a", "z"), spark.read.parquet(path)).collect()] == ["z"]


def test_evaluation_items_and_verdicts(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"description": "d", "items": [{"id": "i1", "should_suggest": True, "phenomena": ["passive"], "must_not": [], "text": "t"}]}, indent=1))
    r = eval_items.read(spark, [str(tmp_path / "c.json")]).first()
    assert (r["id"], r["set_no"], r["phenomena"]) == ("i1", 1, ["passive"])
    s = spark.createDataFrame([(1, 0, "enumeration"), (1, 1, "enumeration"), (1, 1, "passive"), (1, 2, "passive"), (1, 3, None)], "doc_id long, sent_idx int, type string")
    assert {r["sent_idx"]: r["verdict"] for r in stats.list_verdicts(s, generation.REWRITES).collect()} == {0: "ok", 1: "unsuppressed", 2: "missing", 3: "missing"}
    assert [tuple(r) for r in stats.tally(stats.list_verdicts(s, generation.REWRITES), [], "verdict", ["ok", "missing"]).collect()] == [(1, 2, 4)]


def test_a_suffix_in_brackets_stays_with_its_word(spark):
    df = spark.createDataFrame([("De auto('s), kind(eren) en (los) werk.",)], "t string").select(T.tokens(F.col("t")).alias("x"))
    assert df.first()["x"] == ["De", "auto('s)", ",", "kind(eren)", "en", "(", "los", ")", "werk", "."]


def test_payload_and_lists(spark, tmp_path):
    freq = spark.createDataFrame([("straat", 4.0), ("loopt", 4.0)], "word string, word_count double")
    docs = spark.createDataFrame([(1, "De man loopt over de straat naar het huis. Hij ziet het grote huis."), (2, "Een andere tekst over de straat hier.")], "doc_id long, text string")
    a = Readability(lexicons.derived(freq)).analyze(docs)
    s = generation.suggestions(spark.createDataFrame([(1, "passive", 1, "b"), (1, "spelling", 0, "a")], "doc_id long, type string, sent_idx int, suggested string"))
    got = {r["doc_id"]: json.loads(r["payload"]) for r in a.payload(s).collect()}
    assert [x["type"] for x in got[1]["suggestions"]] == ["spelling", "passive"] and got[2]["suggestions"] == []
    by_id = {r["doc_id"]: r for r in a.scores.collect()}
    for d, p in got.items():
        assert p["sentence_count"] == by_id[d]["sentence_count"] == len(p["sentences"])
        assert (p.get("document_score"), p.get("document_level")) == (by_id[d]["score"], by_id[d]["level"])
    words = [[w["text"] for w in x["word_features"]] for x in got[1]["sentences"]]
    tokens = {k: [r["text"] for r in a.tokens.filter(f"doc_id = 1 and sent_idx = {k}").orderBy("i").collect()] for k in (0, 1)}
    assert words == [tokens[0], tokens[1]]
    assert a.detailed().count() == a.sentences.count() and {"new_words", "content"} <= set(a.detailed().columns)
    assert a.rare_words(1).filter("doc_id = 1").count() == 1 and a.rare_words(-1).count() >= a.rare_words(1).count()
    documents.write_payloads(a.payload(), str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).count() == 2
    page = documents.html_page('{"t": "</script>"}')
    assert page.count("</script>") == 1


def test_lists_and_files_are_read(spark, tmp_path):
    freq = spark.createDataFrame([("straat", 4.0), ("straat", 4.0), ("huis", 5.0)], "word string, word_count double")
    d = lexicons.derived(freq)
    for name in lexicons.COLUMNS:
        getattr(d, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert lexicons.load(spark, str(tmp_path)).frequency.count() == 2
    assert lexicons.newest(["/x/a_v1.parquet", "/x/a_v3.parquet", "/y/a_v2.parquet"]) == "/x/a_v3.parquet"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Kop\n\nTekst.")
    (tmp_path / "in" / "b.txt").write_text("Tekst.")
    (tmp_path / "in" / "c.xyz").write_text("?")
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["format"], r["error"]) for r in documents.convert(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.md": ("# Kop\n\nTekst.", "markdown", None), "b.txt": ("Tekst.", "text", None), "c.xyz": (None, None, "unknown kind")}
