"""Calling a language model over a table of jobs, and reading what it answers."""

from __future__ import annotations

import queue
import re
import threading
import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = pa.schema([("job", pa.string()), ("content", pa.string()), ("model", pa.string()), ("error", pa.string()), ("seconds", pa.float64())])


class Completer(Protocol):
    """A language model; built once in every Python worker by a factory that can be sent there."""

    model: str

    def complete(self, system: str, user: str, max_tokens: int) -> str: ...


class Echo:
    """A stand-in that answers with its prompt: for tests and dry runs."""

    model = "echo"

    def complete(self, system: str, user: str, max_tokens: int) -> str:
        return f"VOORSTEL: {user}"


def run_jobs(jobs: DataFrame, factory, key: str, system: str, user: str, max_tokens: int = 512, deadline: float = 300.0, on_error: str = "column") -> DataFrame:
    """key, content, model, error, seconds of every job. A failing call gives a row with its error (on_error "column") or
    fails the task ("raise"). A call that takes longer than the deadline is given up with the error "deadline", and only that
    one: it goes on in a thread that nobody waits for, and the next job is asked of a model of its own."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            rows = []
            for k, s, u in zip(*(c.to_pylist() for c in b.columns), strict=True):
                began = time.monotonic()
                answer: queue.SimpleQueue = queue.SimpleQueue()

                def work(model=model, s=s, u=u, answer=answer):
                    try:
                        answer.put((model.complete(s or "", u or "", max_tokens), None))
                    except Exception as e:  # handed on below
                        answer.put((None, e))

                threading.Thread(target=work, daemon=True).start()
                name = model.model
                try:
                    content, error = answer.get(timeout=deadline)
                except queue.Empty:
                    content, error, model = None, TimeoutError("deadline"), factory()
                if error is not None and on_error == "raise":
                    raise error
                text = None if error is None else "deadline" if isinstance(error, TimeoutError) and str(error) == "deadline" else f"{type(error).__name__}: {error}"[:500]
                rows.append((k, content, name, text, time.monotonic() - began))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(ANSWER.types)], schema=ANSWER)

    src = jobs.select(F.col(key).cast("string").alias("job"), F.col(system).alias("s"), F.col(user).alias("u"))
    return src.mapInArrow(call, "job string, content string, model string, error string, seconds double").withColumnRenamed("job", key)


FIELD = re.compile(r"^\s*(?:#+\s*)?(?:\*\*|__)?\s*([A-ZÀ-Þ][A-ZÀ-Þ _]*?)\s*(?:\*\*|__)?\s*:\s*(?:\*\*|__)?\s*(.*)$")
NOTHING = re.compile(r"^\s*(?:GEEN(?:[_ ]FOUTEN)?|GEEN_WIJZIGING)\s*\.?\s*$", re.I)


def parse_fields(content: str | None, names: frozenset[str] | None = None) -> dict[str, str]:
    """Labelled lines of an answer: NAME: value, names with or without decoration, values over several lines, brackets around
    a value dropped. Thinking parts are left out; an answer of nothing gives no fields. With names, those of the template, any
    other label is text of the field it stands in."""
    text = re.sub(r"(?s)<think>.*?</think>", "", content or "")
    out: dict[str, str] = {}
    name = None
    for line in text.splitlines():
        m = FIELD.match(line)
        if m and (names is None or re.sub(r"\s+", "_", m[1].strip()) in names):
            name = re.sub(r"\s+", "_", m[1].strip())
            out[name] = m[2].strip()
        elif name and line.strip() and line.strip() != "---":
            out[name] = f"{out[name]} {line.strip()}".strip()
    return {k: re.sub(r"^\[(.*)\]$", r"\1", v).strip() for k, v in out.items()}


def parse_blocks(content: str | None, required: str, names: frozenset[str] | None = None) -> list[dict[str, str]]:
    """The fields of each part between lines of dashes; parts without the required field are left out."""
    text = re.sub(r"(?s)<think>.*?</think>", "", content or "")
    if NOTHING.match(text):
        return []
    parts = (parse_fields(p, names) for p in re.split(r"(?m)^\s*-{3,}\s*$", text))
    return [p for p in parts if p.get(required)]


def parsed(answers: DataFrame, key: str, content: str, required: str | None = None, names: frozenset[str] | None = None) -> DataFrame:
    """key, block, fields (map) of every answer; with `required`, one row per block that has it."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(batches):
        for b in batches:
            rows = []
            for k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                found = parse_blocks(c, required, names) if required else [parse_fields(c, names)]
                rows += [(k, n, list(f.items())) for n, f in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    src = answers.select(F.col(key).cast("string").alias("key"), F.col(content).alias("c"))
    return src.mapInArrow(run, "key string, block int, fields map<string,string>").withColumnRenamed("key", key)


# Prompts of our own, by kind of problem; {sentence} and {issue} are filled in. The field names are those the parsers know.
TEMPLATES = {
    "sentence_rewrite": "Herschrijf de zin zodat hij makkelijker leest. Houd de betekenis gelijk.\nPROBLEEM: {issue}\nZIN: {sentence}\nAntwoord met BEHOUDEND: (blijft een zin), VOLLEDIG: (mag gesplitst) en UITLEG:.",
    "word_frequency": "Noem een bekender woord voor '{issue}' dat in deze zin past.\nZIN: {sentence}\nAntwoord met VERVANGING:, HERSCHRIJVING: en UITLEG:.",
    "spelling": "Noem spelfouten in de genummerde zinnen, elk als blok met ZIN_NUMMER:, WOORD:, VERBETERING:, gescheiden door ---. Antwoord GEEN_FOUTEN als er geen zijn.\n{sentence}",
    "connective": "Voeg twee zinnen samen met een verbindingswoord als dat past.\n{sentence}\nAntwoord per paar met NA_ZIN:, RELATIE: (reden, gevolg of tegenstelling), HERSCHRIJVING: en UITLEG:, gescheiden door ---.",
    "wordfreq_bundle": "Noem voor elk genummerd woord een bekender woord dat in zijn zin past.\n{items}\nAntwoord per woord met een blok van NUMMER:, VERVANGING:, HERSCHRIJVING: (de hele zin) en UITLEG:, gescheiden door ---.",
    "judge": "In een zin is '{word}' vervangen door '{replacement}'. Klopt de zin nog, en betekent hij hetzelfde?\nZIN: {sentence}\nAntwoord met OORDEEL: GOED of OORDEEL: FOUT.",
    "enumeration": "Maak van de opsomming een lijst: een regel INLEIDING:, een regel ITEM: per punt en een regel UITLEG:.\nZIN: {sentence}",
}

# The fields that answers to each template have.
FIELDS = {
    "sentence_rewrite": frozenset(["BEHOUDEND", "VOLLEDIG", "HERSCHRIJVING", "UITLEG"]), "wordfreq_bundle": frozenset(["NUMMER", "VERVANGING", "HERSCHRIJVING", "UITLEG"]),
    "spelling": frozenset(["ZIN_NUMMER", "WOORD", "VERBETERING", "UITLEG"]), "connective": frozenset(["NA_ZIN", "RELATIE", "HERSCHRIJVING", "UITLEG"]),
}
SYSTEM = "Je helpt schrijvers om Nederlandse teksten makkelijker leesbaar te maken. Verander de inhoud niet en antwoord alleen in het gevraagde formaat."


def level_constraint(level: Column) -> Column:
    """An instruction to make a text of this level one level easier and no more; null for a null level."""
    text = F.format_string("\n\nDe tekst heeft niveau %d van 4 (4 is het moeilijkst). Mik op niveau %d en vereenvoudig niet verder: toon en vakinhoud blijven.", level.cast("int"), F.greatest(F.lit(1), level.cast("int") - 1))
    return F.when(level.isNotNull(), text)


# Default model of each kind of provider, whether calls may run side by side, and its temperature.
PROVIDERS = {
    "openai": ("gpt-4o-mini", True, 0.7), "anthropic": ("claude-3-5-haiku-latest", True, None), "ollama": ("llama3.2", False, None),
    "mistral": ("mistral-large-latest", True, 0.7), "hetzner": ("Qwen3.6-35B-A3B-FP8", True, 0.3), "mlx": ("Qwen2.5-14B-Instruct-4bit", False, None),
}


def token_limit(kind: str, words: int = 1) -> int:
    """Most tokens of an answer by kind of job."""
    return {"spelling": 1024, "wordfreq_bundle": min(2048, 200 * words + 150)}.get(kind, 512)


def issue_text(kind, value, word):
    """What is wrong, in words, for a prompt."""
    return (
        F.when(kind == "sentence_length", F.format_string("de zin heeft %d woorden", value.cast("int")))
        .when(kind == "max_sdl", F.format_string("woorden die bij elkaar horen staan %d woorden uit elkaar", value.cast("int")))
        .when(kind == "content_words_per_clause", F.format_string("%.1f inhoudswoorden per deelzin", value))
        .when(kind == "abstract_nouns", F.lit("veel abstracte woorden"))
        .when(kind == "passive", F.lit("lijdende vorm"))
        .when(kind == "subordinate_clause", F.format_string("%d bijzinnen", value.cast("int")))
        .when(kind == "word_frequency", word)
        .otherwise(kind)
    )


def prompts(issues: DataFrame) -> DataFrame:
    """issues (type, value, word, sentence) with `prompt`."""
    kind = F.when(F.col("type").isin("word_frequency", "spelling", "connective", "enumeration"), F.col("type")).otherwise("sentence_rewrite")
    text = F.lit("")
    for k, v in TEMPLATES.items():
        text = F.when(kind == k, F.replace(F.replace(F.lit(v), F.lit("{issue}"), F.coalesce(issue_text(F.col("type"), F.col("value"), F.col("word")), F.lit(""))), F.lit("{sentence}"), F.coalesce("sentence", F.lit("")))).otherwise(text)
    return issues.withColumn("prompt", text)


def without_enumerated(suggestions: DataFrame) -> DataFrame:
    """Suggestions without full rewrites of sentences that also have an enumeration."""
    enumerated = suggestions.filter(F.col("type") == "enumeration").select("doc_id", "sent_idx").distinct().withColumn("_e", F.lit(True))
    j = suggestions.join(enumerated, ["doc_id", "sent_idx"], "left")
    return j.filter(F.col("_e").isNull() | ~F.col("type").isin("sentence_rewrite", "sentence_length", "max_sdl")).drop("_e")


def uncovered(found: DataFrame, covered: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose key isn't already covered; null keys match nothing."""
    return found.join(covered.select(*by).distinct(), by, "left_anti")
