"""Structure of plain text and Markdown: blocks, layout, unwrapped lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leesmaat import constants as K
from leesmaat.functions import text as T
from leesmaat.workspace import by_document


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, line: the lines of every text, trimmed, blanks collapsed; null texts have none."""
    src = by_document(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull()))
    split = F.split(F.regexp_replace("_t", r"\r\n?", "\n"), "\n")
    return src.select("doc_id", F.posexplode(split).alias("n", "line")).select("doc_id", "n", F.trim(F.regexp_replace("line", r"[ \t]+", " ")).alias("line"))


def blocks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, block_idx, type, text: prose, heading or blank for every line, runs of blank lines as one, none at the ends."""
    t = lines(documents, key, text)
    kind = F.when(F.col("line") == "", "blank").when(T.ends_like_sentence(F.col("line")), "prose").otherwise("heading")
    w = W.partitionBy("doc_id").orderBy("n")
    t = t.withColumn("type", kind)
    ahead = F.max(F.when(F.col("type") != "blank", 1)).over(w.rowsBetween(1, W.unboundedFollowing))
    kept = t.withColumn("_last", F.lag("type").over(w)).withColumn("_ahead", ahead)
    kept = kept.filter((F.col("type") != "blank") | (F.col("_last").isNotNull() & (F.col("_last") != "blank") & F.col("_ahead").isNotNull()))
    first = F.min(F.when(F.col("type") != "blank", F.col("n"))).over(W.partitionBy("doc_id"))
    kept = kept.withColumn("_first", first).filter(F.col("n") >= F.col("_first"))
    return kept.select("doc_id", (F.row_number().over(w) - 1).alias("block_idx"), "type", F.col("line").alias("text"))


def wrapping(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, joinable, suspicious, hard_wrapped: pairs of neighbouring lines with text, those whose first doesn't end like a
    sentence, and whether they are so many that the text was wrapped by a converter."""
    w = W.partitionBy("doc_id").orderBy("n")
    t = lines(documents, key, text).withColumn("next", F.lead("line").over(w))
    pair = (F.col("line") != "") & (F.col("next") != "")
    odd = pair & ~T.ends_like_sentence(F.col("line"))
    g = t.groupBy("doc_id").agg(F.count(F.when(pair, 1)).alias("joinable"), F.count(F.when(odd, 1)).alias("suspicious"))
    return g.withColumn("hard_wrapped", (F.col("joinable") >= 3) & (F.col("suspicious") >= F.greatest(F.lit(2.0), 0.4 * F.col("joinable"))))


def unwrap(documents: DataFrame, dictionary: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text: hard-wrapped texts with their paragraphs rejoined, others as they are. A hyphen at a line's end goes if
    the next line starts small and the joined word is in the dictionary."""
    gate = wrapping(documents, key, text).filter("hard_wrapped").select("doc_id")
    src = by_document(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))  # dealt as lines are: the gate finds the texts where they are
    wrapped = src.join(gate, "doc_id", "left_semi")
    w = W.partitionBy("doc_id").orderBy("n")
    every = lines(wrapped, "doc_id", "text").withColumn("para", F.sum((F.col("line") == "").cast("int")).over(w))
    t = every.filter("line <> ''").withColumn("next", F.lead("line").over(W.partitionBy("doc_id", "para").orderBy("n")))
    tail, head = F.regexp_extract("line", r"(\p{L}+)-$", 1), F.regexp_extract("next", r"^(\p{Ll}\p{L}*)", 1)
    t = t.withColumn("joined", F.when((tail != "") & (head != ""), F.lower(F.concat(tail, head))))
    if dictionary is not None:
        t = t.join(dictionary.select(F.col("word").alias("joined"), F.lit(True).alias("known")).distinct(), "joined", "left")
    else:
        t = t.withColumn("known", F.lit(None).cast("boolean"))
    piece = F.when(F.col("known"), F.expr("left(line, length(line) - 1)")).when(F.col("joined").isNotNull(), F.col("line")).otherwise(F.concat("line", F.lit(" ")))
    joined = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", piece.alias("p")))), lambda x: x["p"]), ""))
    paras = t.groupBy("doc_id", "para").agg(F.min("n").alias("n"), joined.alias("p")).select("doc_id", "n", "p")
    blanks = every.filter("line = ''").select("doc_id", "n", F.col("line").alias("p"))
    texts = paras.unionByName(blanks).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]), "\n").alias("text"))
    return src.join(gate, "doc_id", "left_anti").unionByName(texts)


BLOCK = pa.schema([("doc_id", pa.int64()), ("block_idx", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("ordered", pa.bool_()), ("number", pa.int32())])


ADDRESS_AT_END = re.compile(rf"\S\s+{T.URL}$")


def reads_like_sentence(line: str) -> bool:
    """The same test as ends_like_sentence, for text at hand."""
    bare = re.sub(T.CLOSERS, "", line)
    return bool(bare) and (bare[-1] in ".!?…" or bool(re.search(r"[.!?…]\s", line)) or bool(ADDRESS_AT_END.search(bare)))


def _plain(s: str) -> str:
    """Inline Markdown as plain text with straight quotation marks."""
    s = re.sub(r"!\[([^\]]*)\]\([^)]*\)|\[([^\]]*)\]\([^)]*\)", lambda m: m[1] or m[2] or "", s)
    s = re.sub(r"(\*\*|__|\*|_|`)(?=\S)(.+?)(?<=\S)\1", r"\2", s)
    return re.sub(r"\s+", " ", s).strip().translate({ord(q): '"' for q in K.QUOTES})


Block = tuple[str, str, bool | None, int | None]


def markdown_blocks(text: str | None) -> list[Block]:
    """(type, text, ordered, number) of a Markdown text: prose, heading, list_item, quote, blank; items are numbered within
    their list, whatever their markers say. Fenced code, tables, rules and raw HTML are left out; a paragraph that is all bold
    or doesn't read like a sentence is a heading. Blanks stand between blocks only, one at a time."""
    out: list[Block] = []
    lines: list[str] = []  # of the paragraph, quote or item that is open
    kind, place, ordered, fenced = "prose", 0, False, False

    def blank() -> None:
        if out and out[-1][0] != "blank":
            out.append(("blank", "", None, None))

    def close() -> None:
        nonlocal lines
        raw, lines = " ".join(lines), []
        body = _plain(raw)
        if not body:
            return
        if kind == "item":
            out.append(("list_item", body, ordered, place))
        elif kind == "quote":
            out.append(("quote", body, None, None))
        else:
            bold = re.fullmatch(r"(\*\*|__)(?:(?!\1).)+\1", raw.strip())
            out.append(("heading" if bold or not reads_like_sentence(body) else "prose", body, None, None))

    def leave_list() -> None:
        nonlocal place
        if place:
            blank()
        place = 0

    for line in (text or "").splitlines():
        s = line.strip()
        if s.startswith(("```", "~~~")):
            close()
            leave_list()
            fenced = not fenced
        elif fenced or s.startswith("|") or re.fullmatch(r"(?:[-*_]\s*){3,}", s) or not lines and re.match(r"</?[a-zA-Z]", s):
            continue
        elif not s:
            close()
            if not place:
                blank()
            kind = "prose"
        elif m := re.match(r"(?:[-*+]|(\d{1,9})[.)])\s+(.*)", s):
            close()
            if place and ordered != (m[1] is not None):
                leave_list()
            kind, ordered, place, lines = "item", m[1] is not None, place + 1, [m[2]]
        elif h := re.match(r"#{1,6}\s+(.*?)\s*#*$", s):
            close()
            leave_list()
            kind = "prose"
            if _plain(h[1]):
                out.append(("heading", _plain(h[1]), None, None))
        elif lines:
            lines.append(s.lstrip("> ") if kind == "quote" else s)
        else:
            leave_list()
            kind = "quote" if s.startswith(">") else "prose"
            lines = [s.lstrip("> ") if kind == "quote" else s]
    close()
    while out and out[-1][0] == "blank":
        out.pop()
    return out


def from_markdown(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, block_idx, type, text, ordered, number of Markdown documents; null and empty texts have no blocks."""

    def run(batches):
        for b in batches:
            rows = [(d, n, *x) for d, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for n, x in enumerate(markdown_blocks(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(BLOCK.types)], schema=BLOCK)

    src = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, "doc_id bigint, block_idx int, type string, text string, ordered boolean, number int")


def merge_short(sentences: DataFrame) -> DataFrame:
    """doc_id, block_idx, sentences: array of sentence texts where one of at most two words without closing mark joined the next; a join never chains.

    sentences: doc_id, block_idx, s array<struct<text string, words int, closed boolean>>."""
    step = """aggregate(s, named_struct('out', cast(array() as array<string>), 'held', cast(null as string)),
      (a, x) -> CASE WHEN a.held IS NOT NULL THEN named_struct('out', concat(a.out, array(concat(a.held, ' ', x.text))), 'held', cast(null as string))
                     WHEN x.words <= 2 AND NOT x.closed THEN named_struct('out', a.out, 'held', x.text)
                     ELSE named_struct('out', concat(a.out, array(x.text)), 'held', cast(null as string)) END,
      a -> CASE WHEN a.held IS NULL THEN a.out ELSE concat(a.out, array(a.held)) END)"""
    return sentences.select("doc_id", "block_idx", F.expr(step).alias("sentences"))


def strip_html(html):
    """Text of an HTML column: scripts, styles and tags out, block ends as line breaks, common entities resolved."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"[ \t]+", " "))
