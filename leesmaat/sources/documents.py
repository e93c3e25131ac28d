"""Reading documents from files, and writing payloads."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, SECONDS, MOST_CHARACTERS = 8 * 1024 * 1024, 30, 20_000
# Converter and options by file ending.
CONVERTERS = {
    "docx": ("pandoc", "-f", "docx", "-t", "gfm"), "odt": ("pandoc", "-f", "odt", "-t", "gfm"), "rtf": ("pandoc", "-f", "rtf", "-t", "gfm"),
    "html": ("pandoc", "-f", "html", "-t", "gfm"), "epub": ("pandoc", "-f", "epub", "-t", "gfm"), "pdf": ("pdftotext", "-layout", "-", "-"),
}


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, text of whole text files; ids are hashes of the paths, so they stay the same at every reading."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return t.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def convert(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, text, format, error of files of many kinds, by an outside converter on the executors.

    Files that are too large, of unknown kind, or whose conversion fails or takes too long give a null text and an error."""
    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("format", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *one(p, n, c)) for p, n, c in zip(*(x.to_pylist() for x in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    def one(path: str, size: int, content: bytes) -> tuple:
        kind = path.rsplit(".", 1)[-1].lower()
        if size > MOST_BYTES:
            return None, None, "too large"
        try:
            if kind in ("txt", "md", "markdown"):
                text = content.decode("utf-8", "replace")
            elif kind in CONVERTERS:
                done = subprocess.run(CONVERTERS[kind], input=content, capture_output=True, timeout=SECONDS)
                if done.returncode:
                    return None, None, done.stderr.decode("utf-8", "replace")[:300] or "conversion failed"
                text = done.stdout.decode("utf-8", "replace")
            else:
                return None, None, "unknown kind"
        except (OSError, subprocess.SubprocessError) as e:
            return None, None, f"{type(e).__name__}: {e}"[:300]
        return (text, "text" if kind in ("txt", "pdf") else "markdown", None) if len(text) <= MOST_CHARACTERS else (None, None, "too long")

    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    out = files.mapInArrow(run, "path string, text string, format string, error string")
    return out.select(F.xxhash64("path").alias("doc_id"), "path", "text", "format", "error")


def write_payloads(payloads: DataFrame, path: str) -> None:
    """One JSON object per document and line."""
    payloads.select("payload").write.mode("overwrite").text(path)


HTML = """<!doctype html><meta charset="utf-8"><title>Leesbaarheid</title><script type="application/json" id="payload">{payload}</script>"""


def html_page(payload: str) -> str:
    """A page that holds one payload for a viewer."""
    return HTML.format(payload=payload.replace("</", "<\\/"))
