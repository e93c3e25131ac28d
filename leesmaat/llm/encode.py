"""Problem 7: every text as ids of a public byte-level BPE vocabulary.

Short texts are encoded as they are. A text beyond LONG characters is cut, at safe boundaries of the word pattern where
there are any and by halves where there are none; the parts are encoded in parallel and joined in a tree. Where a cut was
not at a safe boundary, a window of tokens around the join is encoded again and grows until its outer tokens agree with
both sides. Agreement on an outer token makes every pair of neighbouring tokens a pair that the merges themselves give,
which is the condition for the joined sequence to be the encoding of the whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leesmaat.llm.common import per_row, spread, table

TOKENIZER_DIR = os.environ.get("LEESMAAT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: The published pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG = 8_000  # characters a single task step encodes at once
SAFE = re.compile(r"(?<=[^\s])(?= [^\W\d_])")  # a single blank between a visible character and a letter always starts a new piece
SEARCH = 2_048  # how far back from the aimed cut a safe boundary is looked for


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, size: int = LONG) -> list[tuple[int, int, bool]]:
    """(start, end, safe) of the parts of text; safe says whether the part may be joined to the one before without a check."""
    parts, start, safe = [], 0, True
    while len(text) - start > size:
        low = max(start + size // 2, start + size - SEARCH)
        end, found = start + size, False
        for m in SAFE.finditer(text, low, start + size):
            end, found = m.start(), True
        parts.append((start, end, safe))
        start, safe = end, found
    return [*parts, (start, len(text), safe)]


def join(left: list[int], right: list[int], enc, agree: int = 4) -> list[int]:
    """The encoding of the joined text of two encodings; the window around the join doubles until `agree` outer tokens on each
    side come out as they were, or it holds both sides whole."""
    w = 16
    while True:
        a, b = max(0, len(left) - w), min(len(right), w)
        whole_left, whole_right = a == 0, b == len(right)
        raw = enc.decode_bytes(left[a:] + right[:b])
        try:
            again = enc.encode_ordinary(raw.decode("utf-8"))
        except UnicodeDecodeError:  # the window cuts a character; a wider one starts elsewhere
            again = None
        if again is not None:
            n = min(agree, len(left) - a, b)
            if (whole_left or again[:n] == left[a : a + n]) and (whole_right or again[len(again) - n :] == right[b - n : b]):
                return left[:a] + again + right[b:]
            if whole_left and whole_right:
                return again
        elif whole_left and whole_right:
            raise ValueError("the parts don't form a text")
        w *= 2


def tree(parts: list[tuple[bool, list[int]]], enc) -> list[int]:
    """Join neighbours in pairs until one is left; (safe, ids) of each part in order."""
    while len(parts) > 1:
        nxt = []
        for i in range(0, len(parts), 2):
            if i + 1 == len(parts):
                nxt.append(parts[i])
            else:
                (s, x), (t, y) = parts[i], parts[i + 1]
                nxt.append((s, x + y if t else join(x, y, enc)))
        parts = nxt
    return parts[0][1] if parts else []


def encode(df: DataFrame, key: str, text: str, path: str | None = None, long: int = LONG) -> DataFrame:
    """(key, ids) of every row: a null or empty text gives an empty list, a blank one is encoded as it is; other columns are dropped."""
    path = path or os.path.join(TOKENIZER_DIR, VOCABULARY)
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(src.dtypes)["key"]
    out = pa.schema([("key", pa.int64() if kind in ("bigint", "int") else pa.string()), ("ids", pa.list_(pa.int32()))])
    parts_schema = pa.schema([out.field("key"), ("part", pa.int32()), ("safe", pa.bool_()), ("text", pa.string())])
    coded_schema = pa.schema([out.field("key"), ("part", pa.int32()), ("safe", pa.bool_()), ("ids", pa.list_(pa.int32()))])
    ddl = "key bigint" if kind in ("bigint", "int") else "key string"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(out.types[0]), pa.array([enc.encode_ordinary(t) if t else [] for t in b.column(1).to_pylist()], out.types[1])], schema=out)

    def split(batches):
        return per_row(batches, lambda k, t: ((k, i, safe, t[a:b]) for i, (a, b, safe) in enumerate(cuts(t, long))), parts_schema, 16)

    def part(batches):
        enc = encoder(path)
        return per_row(batches, lambda k, i, safe, t: [(k, i, safe, enc.encode_ordinary(t))], coded_schema, 64)

    def glue(batches):
        enc = encoder(path)
        return per_row(batches, lambda k, ps: [(k, tree([(p["safe"], p["ids"]) for p in sorted(ps, key=lambda p: p["part"])], enc))], out, 16)

    n = F.coalesce(F.length("text"), F.lit(0))
    direct = spread(src.filter(n <= long)).mapInArrow(short, f"{ddl}, ids array<int>")
    pieces = src.filter(n > long).mapInArrow(split, f"{ddl}, part int, safe boolean, text string").repartition("key", "part")
    coded = pieces.mapInArrow(part, f"{ddl}, part int, safe boolean, ids array<int>")
    joined = coded.groupBy("key").agg(F.collect_list(F.struct("part", "safe", "ids")).alias("ps")).mapInArrow(glue, f"{ddl}, ids array<int>")
    return direct.unionByName(joined)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k, without special tokens."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "ids")
