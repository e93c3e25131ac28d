"""Spelling dictionaries in the widely used .dic and .aff format, expanded to a word list."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = 100_000  # affix rules at most; they are a grammar, not data


@dataclass
class Affix:
    strip: str
    add: str
    condition: re.Pattern
    cross: bool
    more: list[str] = field(default_factory=list)  # flags of the affix itself


@dataclass
class Affixes:
    """Rules by flag, how flags are written, and the flags that take words out."""

    suffixes: dict[str, list[Affix]] = field(default_factory=dict)
    prefixes: dict[str, list[Affix]] = field(default_factory=dict)
    kind: str = "char"
    forbidden: str | None = None
    needs_affix: str | None = None
    only_in_compound: str | None = None

    def flags(self, text: str) -> list[str]:
        if self.kind == "long":
            return [text[i : i + 2] for i in range(0, len(text), 2)]
        return text.split(",") if self.kind == "num" else list(text)


def parse_affixes(text: str) -> Affixes:
    """The SFX and PFX blocks of an affix file and the settings that bear on them; other settings are passed over."""
    out = Affixes()
    headers: dict[tuple[str, str], bool] = {}
    names = {"FORBIDDENWORD": "forbidden", "NEEDAFFIX": "needs_affix", "ONLYINCOMPOUND": "only_in_compound"}
    for line in text.splitlines():
        parts = line.split("#")[0].split() if not line.lstrip().startswith(("SFX", "PFX")) else line.split()
        if len(parts) < 2:
            continue
        if parts[0] == "FLAG":
            out.kind = {"long": "long", "num": "num"}.get(parts[1], "char")
        elif parts[0] in names:
            setattr(out, names[parts[0]], parts[1])
        elif parts[0] in ("SFX", "PFX") and len(parts) >= 4:
            key = (parts[0], parts[1])
            if key not in headers:
                headers[key] = parts[2] == "Y"
                continue
            strip, (add, _, more) = ("" if parts[2] == "0" else parts[2]), parts[3].partition("/")
            condition = parts[4] if len(parts) > 4 else "."
            pattern = re.compile(f"(?:{condition})$" if parts[0] == "SFX" else f"(?:{condition})")
            rule = Affix(strip, "" if add == "0" else add, pattern, headers[key], out.flags(more))
            (out.suffixes if parts[0] == "SFX" else out.prefixes).setdefault(parts[1], []).append(rule)
    if sum(map(len, [*out.suffixes.values(), *out.prefixes.values()])) > RULES:
        raise ValueError(f"more than {RULES} affix rules")
    return out


def _suffixed(word: str, a: Affix) -> str | None:
    return word[: len(word) - len(a.strip)] + a.add if word.endswith(a.strip) and len(word) > len(a.strip) and a.condition.search(word) else None


def _prefixed(word: str, a: Affix) -> str | None:
    return a.add + word[len(a.strip) :] if word.startswith(a.strip) and len(word) > len(a.strip) and a.condition.match(word) else None


def expand(line: str, rules: Affixes) -> list[str]:
    """All words of a dictionary line: the word, its suffixed and prefixed forms, both together where both allow it, and
    suffixes of suffixes. A blank or forbidden line has none; words that only compounds may hold are left out."""
    entry = line.strip().split("\t")[0].split(" ")[0]
    m = re.match(r"((?:\\/|[^/])+)(?:/(\S+))?", entry)
    if not m:
        return []
    word, flags = m[1].replace("\\/", "/"), rules.flags(m[2] or "")
    if rules.forbidden in flags or rules.only_in_compound in flags:
        return []
    out = [] if rules.needs_affix in flags else [word]
    behind = []  # with the rule that made it
    for f in flags:
        for a in rules.suffixes.get(f, ()):
            w = _suffixed(word, a)
            if w is not None:
                behind.append((w, a))
                for g in a.more:
                    behind += [(v, b) for b in rules.suffixes.get(g, ()) if (v := _suffixed(w, b)) is not None]
    out += [w for w, _ in behind]
    for f in flags:
        for a in rules.prefixes.get(f, ()):
            w = _prefixed(word, a)
            if w is not None:
                out.append(w)
            if a.cross:
                out += [v for w, b in behind if b.cross and (v := _prefixed(w, a)) is not None]
    return list(dict.fromkeys(out))


def read(spark: SparkSession, dic: str, aff: str | None = None) -> DataFrame:
    """word: the different words of a .dic file, with the affixes of an .aff file. The first line of a .dic file, if it is a
    number, is the number of its lines."""
    rules = Affixes()
    if aff is not None:
        rules = parse_affixes(spark.read.text(aff, wholetext=True).first()[0])
    schema = pa.schema([("word", pa.string())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for x in b.column(0).to_pylist() for w in expand(x or "", rules)], pa.string())], schema=schema)

    lines = spark.read.text(dic).filter(~F.col("value").rlike(r"^\s*\d+\s*$"))
    return lines.mapInArrow(run, "word string").distinct()
