"""Problem 6: sentence units in every language and script.

A lexer turns text into a short tape of events (closing marks with what follows them, quotation marks, empty lines, list
markers, headings, blanks in scripts without closing marks). A finite transducer reads the tape: its state says whether
it is in running text, in quoted speech, in a list item or in a heading, and in which states a closing mark starts a new
unit. Of a long document each chunk becomes a function from the state at its start to the state at its end; functions compose
associatively, so chunks are lexed in parallel, a prefix scan of the functions gives every chunk its start state, a scan
from the end tells whether a quotation left open is ever closed, and each chunk then names its own units. Only the functions,
a few numbers each, come together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leesmaat.llm.common import cut, latest, per_row, spread, table

# Abbreviations that don't end a sentence, in lower case and without the last full stop.
ABBREVIATIONS = frozenset(
    """
    aanh aant afb afd afz alg art a.d a.h.w a.u.b b.g.g b.v bijv bijl bl blz bv bz c.q ca cf dep dept dhr dir d.d d.m.v d.w.z d.i dr drs ds
    e.a e.v excl fa fam fig geb gebr gem get gr hfdst hr i.c i.e i.g.v i.h.a i.h.b i.o i.o.v i.p.v i.v.m i.z incl ing inl ir jhr jkvr jl k.k
    l.v lic m m.a.w m.b.t m.b.v m.i m.i.v m.n m.u.v max mej mevr mgr min mr mrs ms mw n.a.v n.o.t.k nl nr nrs no nos o.a o.b.v o.i.d o.l.v o.m o.v o.v.v obs
    p.a p.o p.p par pag pct penn plm prof red resp secr sr st stg t.a.v t.b.v t.g.v t.h.v t.n.v t.o.v t.w.v tel temp toel v.a v.chr vgl vlg vnl voorz w.o
    wnd z.g zgn z.o.z zr jan feb mrt apr jun jul aug sep sept okt oct nov dec ma di wo do vr za zo
    e.g approx est govt vs vol pp ph gen col capt lt sgt rev hon messrs inc ltd co corp univ assn ave blvd rd
    bzw d.h evtl ggf inkl usw.a z z.b u.a u.ä str tg abt hrsg sog geb
    av env ex mme mmes mlle mm m.m p.ex c.-à-d r bd
    sr sra srta d dña dra ud uds núm pág pte aprox p.ej ee.uu
    ул г гг т т.е т.к т.д т.п им стр рис см напр руб тыс млн проф акад д кв обл р
    """.split()
)
# Abbreviations that may stand at the end of a sentence; a capital after them starts a new one.
ENDING = frozenset("enz etc e.d jr sr.jr p.m a.m usw e.a o.i.d et.al kg km cm mm m2 u min sec uur ff jl i.d u.s u.s.w т.д т.п г гг руб n.chr v.chr bv.b s.v.p".split())
# First words of a clause that tells who spoke, for texts without case.
SPEECH = frozenset("en zegt zei vroeg riep antwoordde schreef vertelde aldus says said asked replied and sagte sagt fragte dit dice dijo demande говорит сказал".split())
# Months after an ordinal number.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

CLOSES = {"„": "”“", "“": "”", "‘": "’", "‚": "’‘", "«": "»", "»": "«", '"': '"', "「": "」", "『": "』", "‹": "›"}
KINDS = {q: i + 1 for i, q in enumerate(CLOSES)}  # state of each opening mark
TEXT, ITEM, HEAD = 0, 20, 21  # running text, list item, heading
STATES = (TEXT, *KINDS.values(), ITEM, HEAD)
CLOSERS = frozenset("".join(CLOSES.values()))

UNSPACED_END = "。！？｡"
UNMARKED = r"฀-໿က-႟ក-៿"  # Thai, Lao, Burmese, Khmer
MARKER = r"(?:[-*•–+‣]|\d{1,3}[.)]|[a-z]\))[ \t]+(?=\S)"
EVENT = re.compile(
    r"(?P<para>[^\S\n]*\r?\n(?:[^\S\n]*\r?\n)+)"
    r"|(?P<line>\r?\n[ \t]*)"
    r"|(?P<term>[.!?…؟۔।॥]+|[" + UNSPACED_END + r"]+)"
    r"|(?P<quote>[„“”‘’‚«»‹›\"「」『』])"
    rf"|(?P<gap>(?<=[{UNMARKED}.\d])[ \t]+(?=[{UNMARKED}])|(?<=[{UNMARKED}])[ \t]+(?=[\d(]))"
)
HEADING = re.compile(r"#{1,6}[ \t]+(?=\S)")
ITEM_START = re.compile(MARKER)
TOKEN = re.compile(r"[^\s„“‘«»\"(\[「,;:]*$")
NEXT = re.compile(r"[\s]*")
WORD = re.compile(r"[^\W\d_]+")
UNMARKED_CHAR = re.compile(f"[{UNMARKED}]")
CASE = 400  # characters on either side that tell whether text has capitals
CONTEXT = 500  # characters on either side that the lexer may look at; what lies further back comes along as a flag


def _starts_sentence(text: str, at: int) -> bool | None:
    """Whether what stands at `at` can open a sentence: True, False (a small letter or a mark that goes on), None for a letter without case."""
    c = text[at]
    if c in "'’" and at + 2 < len(text) and text[at + 1] in "stnST" and not text[at + 2].isalpha():
        return True
    if c.isalpha():
        return True if c.isupper() or c.istitle() else (False if c.islower() else None)
    if c in ",;:)]}/%&=-–—.!?…。！？":
        return False
    return True


def _token_before(text: str, dot: int) -> str:
    return TOKEN.search(text, max(0, dot - 60), dot).group()


def _caseless(text: str, at: int) -> bool:
    """Whether the text around a mark is written in one case only."""
    near = text[max(0, at - CASE) : at + CASE]
    return near == near.lower() or near == near.upper()


def _is_boundary(text: str, start: int, end: int, nxt: int) -> bool:
    """Whether the closing mark text[start:end], followed by text[nxt], ends a sentence in running text."""
    mark, spaced = text[start:end], nxt > end
    if mark[0] in UNSPACED_END or mark[0] in "।॥":
        return True
    opens = _starts_sentence(text, nxt)
    if mark == ".":
        token = _token_before(text, start)
        low = token.lower()
        if not spaced:  # a blank is missing, or this is part of a number, an address or an abbreviation
            c = text[nxt]
            if not (c.isupper() or (c == "'" and opens)) or not token or "@" in token or "/" in token or "www." in low or low in ABBREVIATIONS:
                return False
            before = token[-1]
            following = text[nxt + 1 : nxt + 2]
            return (before.islower() or before.isdigit() or before in ")”’»") and (len(token) > 1) and (not following or following.islower() or following in " .'") and not _in_address(text, start)
        if not token:
            return opens is not False
        if low in ENDING:
            return opens is not False or (text[nxt].islower() and _caseless(text, start))
        if low in ABBREVIATIONS:
            return False
        tail = low.rpartition(".")[2]
        if tail != low and len(tail) > 2 and tail in ABBREVIATIONS:  # a blank is missing in front of it
            return False
        if re.search(r"(?:^|\.)[^\W\d_]$", token):  # initials and short forms
            return opens is None
        word = WORD.match(text, nxt)
        if token.isdigit() and len(token) <= 2 and word and word.group().lower() in MONTHS:
            return False
        if opens is False:
            return text[nxt].islower() and len(token) >= 3 and token[-1].isalnum() and not token.isdigit()
        return True
    if not spaced and opens is not True:
        return opens is None
    if mark in ("…", "...") or mark.startswith(".."):
        return opens is not False or _caseless(text, start)
    return opens is not False or (text[nxt].islower() and _caseless(text, start))


def _in_address(text: str, dot: int) -> bool:
    """Whether a full stop without a blank stands in an e-mail address with blanks around its sign."""
    return bool(re.search(r"(?:@|\(at\)|\[at\])\s?\S*$", text[max(0, dot - 60) : dot], re.I))


def lex(text: str, lo: int = 0, hi: int | None = None, in_item: bool | None = None) -> list[tuple[str, int, int]]:
    """Events (kind, state number, start of the unit that would begin) whose mark stands in text[lo:hi].

    in_item: for a piece of a longer text, whether the line that runs into the piece began with a list marker.

    Kinds: hard (a unit ends in any state), soft (ends in running text), head, item (hard, and the state changes),
    line (ends a heading), open, close (with 1 in the position's place if what follows starts a new unit)."""
    hi = len(text) if hi is None else hi
    out: list[tuple[str, int, int]] = []
    n = len(text)

    def line_start(at: int, after_break: bool) -> None:
        if HEADING.match(text, at):
            out.append(("head", HEAD, at))
        elif ITEM_START.match(text, at) and after_break:
            out.append(("item", ITEM, at))

    if lo == 0:
        first = NEXT.match(text).end()
        if first < n:
            out.append(("hard", 0, first))
            line_start(first, True)
    for m in EVENT.finditer(text, lo, n):
        start, end = m.span()
        if start >= hi:
            break
        kind = m.lastgroup
        nxt = NEXT.match(text, end).end()
        if nxt >= n and kind != "quote":
            continue
        if kind == "para":
            out.append(("hard", 0, nxt))
            line_start(nxt, True)
        elif kind == "line":
            if HEADING.match(text, nxt):
                out.append(("head", HEAD, nxt))
                continue
            if ITEM_START.match(text, nxt):
                before = text[max(0, start - 3) : start].rstrip()[-1:]
                previous = text.rfind("\n", 0, start) + 1
                follows = bool(ITEM_START.match(text, NEXT.match(text, previous).end())) if previous or in_item is None else in_item
                if before in ".!?:;…”\"’»" or follows:
                    out.append(("item", ITEM, nxt))
                    continue
            out.append(("line", 0, nxt))
            if UNMARKED_CHAR.match(text, start - 1 if start else 0) and UNMARKED_CHAR.match(text, nxt):
                out.append(("soft", 0, nxt))
        elif kind == "gap":
            out.append(("soft", 0, nxt))
        elif kind == "term":
            after = end
            while after < n and text[after] in ")]":
                after += 1
            if after < n and text[after] in CLOSERS and not (text[after] == '"' and after + 1 < n and not text[after + 1].isspace() and text[after + 1] not in ".,;:!?)"):
                q = text[after]
                if q not in KINDS or after + 1 >= n or text[after + 1].isspace() or text[after + 1] in ".,;:!?)":
                    if not (q == "’" and _starts_sentence(text, after) is True and after + 1 < n and text[after + 1].isalpha()):
                        continue  # the closing quotation mark decides
            nxt = NEXT.match(text, after).end()
            if nxt < n and _is_boundary(text, start, end, nxt) and not text[nxt] in "」』":
                out.append(("soft", 0, nxt))
        else:
            q = text[start]
            before, behind = text[start - 1 : start], text[end : end + 1]
            inner = q in "’‘" and before.isalnum() and behind.isalnum()
            if inner or (q == "’" and behind in ("s", "t", "n") and not before.isalnum() and not text[end + 1 : end + 2].isalpha()):
                continue
            ended = False
            if nxt < n:
                stop = text[max(0, start - 3) : start].rstrip()[-1:]
                if stop and stop in ".!?…؟۔।" + UNSPACED_END:
                    word = WORD.match(text, nxt)
                    opens = _starts_sentence(text, nxt)
                    ended = opens is True or (opens is None and text[nxt] not in "とっって" and text[nxt] not in "」』") or (opens is False and text[nxt].isalpha() and _caseless(text, start))
                    if word and word.group().lower() in SPEECH and _caseless(text, start):
                        ended = False
                    if text[nxt] in ".!?…。！？，、":
                        ended = False
            can_open = q in CLOSES and (not before or before.isspace() or before in "([:-–—,/.!?…”’»。！？：，、" or q in "「『„«" or before in "'’") and bool(behind) and (not behind.isspace() or q == "«")
            out.append(("quote", ord(q), nxt if ended else -1))
            if can_open:
                out.append(("open", KINDS[q], start))
    return out


@dataclass
class Step:
    """What a stretch of tape does from one start state: units surely started, units started if the quotation that is open
    at the end never closes, and whether such units of the stretch before are dropped (its quotation closed) or kept."""

    end: int
    sure: list[int] = field(default_factory=list)
    pending: list[int] = field(default_factory=list)
    before: str = "open"  # open, kept or dropped


def run(events: list[tuple[str, int, int]], state: int) -> Step:
    s = Step(state)
    closed_by = {i: CLOSES[q] for q, i in KINDS.items()}
    skip_open = False

    def settle(keep: bool) -> None:
        if keep:
            s.sure.extend(s.pending)
        s.pending = []
        if s.before == "open":
            s.before = "kept" if keep else "dropped"

    for kind, number, at in events:
        quoted = s.end in closed_by
        if kind in ("hard", "head", "item"):
            settle(quoted)
            s.sure.append(at)
            s.end = {"hard": TEXT, "head": HEAD, "item": ITEM}[kind]
        elif kind == "line":
            if s.end == HEAD:
                s.sure.append(at)
                s.end = TEXT
        elif kind == "soft":
            if quoted:
                s.pending.append(at)
            elif s.end == TEXT:
                s.sure.append(at)
        elif kind == "quote":
            skip_open = False
            if quoted and chr(number) in closed_by[s.end]:
                settle(False)
                s.end, skip_open = TEXT, True
                if at >= 0:
                    s.sure.append(at)
            elif s.end == TEXT and at >= 0 and chr(number) in CLOSERS:
                s.sure.append(at)
        elif kind == "open":
            if s.end == TEXT and not skip_open:
                if s.sure and s.sure[-1] > at:  # the mark opens here; it closed nothing
                    s.sure.pop()
                s.end = number
            skip_open = False
    return s


def function(events: list[tuple[str, int, int]]) -> dict[int, Step]:
    """The stretch of tape as a function of the state it starts in."""
    return {state: run(events, state) for state in STATES}


def compose(f: dict[int, Step], g: dict[int, Step]) -> dict[int, Step]:
    """First f, then g."""
    out = {}
    for state, a in f.items():
        b = g[a.end]
        sure, pending, before = list(a.sure), list(a.pending), a.before
        if b.before == "kept":
            sure, pending = sure + pending, []
        elif b.before == "dropped":
            pending = []
        if before == "open" and b.before != "open":
            before = b.before
        out[state] = Step(b.end, sure + b.sure, pending + b.pending, before)
    return out


def scan(functions: list[dict[int, Step]]) -> dict[int, Step]:
    """Compose a list of functions as a balanced tree."""
    while len(functions) > 1:
        functions = [compose(*functions[i : i + 2]) if i + 1 < len(functions) else functions[i] for i in range(0, len(functions), 2)]
    return functions[0]


def units(text: str | None) -> list[int]:
    """Start of every sentence unit of a text; none for a null or blank one."""
    if not text or not text.strip():
        return []
    s = run(lex(text), TEXT)
    return sorted(set(s.sure + s.pending))


LONG = 2_000  # characters of a chunk; longer texts are cut


def pieces(text: str, size: int = LONG) -> Iterator[tuple[int, int, bool]]:
    """(start, end, in_item) of the chunks of a text. A cut falls between two letters, so no mark, blank or marker is cut,
    however long a run of them is. in_item: whether the line that runs into the chunk began with a list marker."""
    lo, line, item = 0, 0, False
    while lo < len(text):
        hi = min(len(text), lo + size)
        while hi < len(text) and not (text[hi - 1].isalpha() and text[hi].isalpha()):
            hi += 1
        yield lo, hi, item
        line = text.rfind("\n", lo, hi) + 1
        if line:
            item = bool(ITEM_START.match(text, NEXT.match(text, line).end()))
        elif not lo:
            item = bool(ITEM_START.match(text, NEXT.match(text).end()))
        lo = hi


def piece_events(text: str, base: int, lo: int, hi: int, in_item: bool) -> list[tuple[str, int, int]]:
    """Tape of the chunk [lo, hi) of a document of which only `text`, from the place base on, is at hand."""
    return [(k, x, p if p < 0 else p + base) for k, x, p in lex(text, lo - base, hi - base, in_item if base else None)]


NUMBER = {s: i for i, s in enumerate(STATES)}
EVENTS = ("hard", "soft", "head", "item", "line", "quote", "open")
FATES = ("open", "kept", "dropped")


def summary(events: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """The function of a tape without its units: by number of the start state that of the end state, and what becomes of a
    quotation left open before."""
    steps = [run(events, s) for s in STATES]
    return [NUMBER[s.end] for s in steps], [FATES.index(s.before) for s in steps]


def prefix_scan(ends: np.ndarray) -> np.ndarray:
    """Of the functions of a document's chunks (rows, end state by start state), the composition of all before each: doubling
    steps, in each of which all rows are composed at once."""
    if not len(ends):
        return ends
    f = np.vstack([np.arange(ends.shape[1], dtype=ends.dtype), ends[:-1]])
    step = 1
    while step < len(f):
        g = f.copy()
        g[step:] = np.take_along_axis(f[step:], f[:-step], axis=1)  # first the earlier function
        f, step = g, step * 2
    return f


def starts_and_fates(ends: np.ndarray, fates: np.ndarray) -> tuple[list[int], list[bool]]:
    """Start state of each chunk, and whether the units of a quotation it leaves open are kept: what the next chunk that
    settles it says, or at the document's end yes."""
    first = prefix_scan(ends)[:, NUMBER[TEXT]]
    said = fates[np.arange(len(first)), first]
    keep, known = [], True
    for x in said[::-1].tolist():
        keep.append(known)
        known = known if x == 0 else x == 1
    return [STATES[x] for x in first.tolist()], keep[::-1]


def units_in_chunks(text: str, size: int = LONG) -> list[int]:
    """The same as `units` by the functions of chunks that see no more than the distributed form shows them."""
    tapes = []
    for lo, hi, item in pieces(text, size):
        base = max(0, lo - CONTEXT)
        tapes.append(piece_events(text[base : hi + CONTEXT], base, lo, hi, item))
    f = [summary(t) for t in tapes]
    out: set[int] = set()
    for tape, state, keep in zip(tapes, *starts_and_fates(np.array([a for a, _ in f]), np.array([b for _, b in f])), strict=True):
        s = run(tape, state)
        out.update(s.sure, s.pending if keep else ())
    return sorted(out)


TAPE = ("kind", "number", "at", "ends", "fates")


def sentence_starts(df: DataFrame, keys: list[str], text: str, long: int = LONG) -> DataFrame:
    """(keys..., start_pos) of every sentence unit; keys are strings. Null and blank texts have no units; equal rows give equal
    units. Texts beyond `long` characters are cut in chunks (module docstring)."""
    names = [f"k{i}" for i in range(len(keys))]
    src = df.select(*[F.col(k).cast("string").alias(n) for n, k in zip(names, keys, strict=True)], F.col(text).alias("text")).filter(F.length(F.trim("text")) > 0)
    fields = [(k, pa.string()) for k in names]
    ddl = ", ".join(f"{k} string" for k in names)
    flat = pa.schema([*fields, ("start_pos", pa.int32())])
    place = [("copies", pa.int32()), ("row", pa.int64()), ("lo", pa.int32())]
    chunked = pa.schema([*fields, *place, ("text", pa.string()), ("base", pa.int32()), ("hi", pa.int32()), ("item", pa.bool_())])
    taped = pa.schema([*fields, *place, *((c, pa.list_(pa.int32())) for c in TAPE)])
    begun = pa.schema([*place[1:], ("state", pa.int32()), ("keep", pa.bool_())])
    out = f"{ddl}, start_pos int"

    def short(batches):
        return per_row(batches, lambda *r: ((*r[:-1], p) for p in units(r[-1])), flat, 20_000)

    def split(*r):
        *key, copies, row, t = r
        for lo, hi, item in pieces(t, long):
            base = max(0, lo - CONTEXT)
            yield *key, copies, row, lo, t[base : hi + CONTEXT], base, hi, item

    def tape(*r):
        *key, copies, row, lo, t, base, hi, item = r
        events = piece_events(t, base, lo, hi, item)
        yield *key, copies, row, lo, [EVENTS.index(k) for k, _, _ in events], [x for _, x, _ in events], [p for _, _, p in events], *summary(events)

    def begin(row, chunks):
        chunks = sorted(chunks, key=lambda c: c["lo"])
        states, keep = starts_and_fates(np.array([c["ends"] for c in chunks]), np.array([c["fates"] for c in chunks]))
        return [(row, c["lo"], s, k) for c, s, k in zip(chunks, states, keep, strict=True)]

    def name(*r):
        *key, copies, kind, number, at, state, keep = r
        s = run([(EVENTS[k], n, p) for k, n, p in zip(kind, number, at, strict=True)], state)
        return ((*key, p) for p in sorted({*s.sure, *(s.pending if keep else ())}) for _ in range(copies))

    direct = spread(src.filter(F.length("text") <= long)).mapInArrow(short, out)
    once = src.filter(F.length("text") > long).groupBy(*names, F.md5("text").alias("row")).agg(F.first("text").alias("text"), F.count("*").cast("int").alias("copies"))
    rows = once.withColumn("row", F.xxhash64(*names, "row"))  # numbers that a repeated task gives again
    chunks = rows.select(*names, "copies", "row", "text").mapInArrow(lambda bs: per_row(bs, split, chunked, 8), f"{ddl}, copies int, row bigint, lo int, text string, base int, hi int, item boolean")
    tapes = cut(spread(chunks).mapInArrow(lambda bs: per_row(bs, tape, taped, 64), f"{ddl}, copies int, row bigint, lo int, " + ", ".join(f"{c} array<int>" for c in TAPE)), "tapes")
    together = tapes.groupBy("row").agg(F.collect_list(F.struct("lo", "ends", "fates")).alias("c"))  # thirty numbers a chunk
    starts = together.mapInArrow(lambda bs: per_row(bs, begin, begun, 20_000), "row bigint, lo int, state int, keep boolean")
    named = tapes.join(starts, ["row", "lo"]).select(*names, "copies", "kind", "number", "at", "state", "keep")
    long_ones = named.mapInArrow(lambda bs: per_row(bs, name, flat, 20_000), out)
    back = [F.col(n).alias(k) for n, k in zip(names, keys, strict=True)]
    return direct.unionByName(long_ones).select(*back, "start_pos")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of analyze_requests.text and corpus.text; a re-delivered request counts once."""
    requests = latest(table(spark, sf_dir, "analyze_requests").select("request_id", "text", "ingested_at"), ["request_id"], "ingested_at")
    both = requests.select(F.lit("analyze_requests").alias("src_table"), F.col("request_id").cast("string").alias("row_key"), "text").unionByName(
        table(spark, sf_dir, "corpus").select(F.lit("corpus").alias("src_table"), F.col("id").alias("row_key"), "text")
    )
    return sentence_starts(both, ["src_table", "row_key"], "text").distinct()
