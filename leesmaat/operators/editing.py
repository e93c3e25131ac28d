"""Texts after decisions: sentences with their accepted edits, merges, documents, levels, and what is shown beside them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leesmaat.functions import score as S
from leesmaat.operators.editor import COMPOSABLE, word_diff
from leesmaat.operators.generation import composed_merge

KEY = ["doc_id", "sent_idx"]
PLAIN = ".,;:!?()\"'“”"  # marks that don't tell words apart when edits are put in


def chosen(suggestions: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """Suggestions with the text of the variant that is chosen: by choices (id, key), else the cautious one of two or more.
    A choice that isn't offered changes nothing. Suggestions without two variants keep their text."""
    s = suggestions
    key = F.lit("conservative")
    if choices is not None:
        s = s.join(choices.select("id", F.col("key").alias("_key")), "id", "left")
        offered = F.exists("variants", lambda v: v["key"] == F.col("_key"))
        key = F.when(F.coalesce(offered, F.lit(False)), F.col("_key")).otherwise("conservative")
    text = F.get(F.filter("variants", lambda v: v["key"] == key), F.lit(0))["text"]
    several = F.coalesce(F.size("variants") >= 2, F.lit(False))
    return s.withColumn("suggested", F.when(several, F.coalesce(text, F.col("suggested"))).otherwise(F.col("suggested"))).select(*suggestions.columns)


def with_edits(words: list[str], accepted: list[str]) -> str:
    """A sentence with several accepted texts of it put in, the last places first; each differs from the sentence itself."""
    regions = [(r, text.split()) for text in accepted for r in word_diff(words, text.split(), PLAIN)]
    out = list(words)
    for (a, b, x, y), new in sorted(regions, key=lambda z: (z[0][1], z[0][0]), reverse=True):
        out[a:b] = new[x:y]
    return " ".join(out)


def span_after(words: list[str], own: str, others: list[str]) -> tuple[int, int]:
    """Where the words that a suggestion changes stand once the other accepted texts are in the sentence: (start, end)."""
    changed = word_diff(words, own.split(), PLAIN)
    if not changed:
        return 0, 0
    start, end = changed[0][0], changed[-1][1]
    before = inside = 0  # by how much the sentence grows in front of the span, and within it
    for a, b, x, y in (r for text in others for r in word_diff(words, text.split(), PLAIN)):
        if b <= start and a < start or a == b == start < end:
            before += y - x - (b - a)
        elif a < end:
            inside += y - x - (b - a)
    return start + before, max(start, end + inside) + before


def _texts(df: DataFrame, columns: list[str], schema: pa.Schema, ddl: str, step) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [step(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    return df.select(*columns).mapInArrow(run, ddl)


def current_sentences(sentences: DataFrame, accepted: DataFrame) -> DataFrame:
    """doc_id, sent_idx, text: every sentence with its accepted suggestions, links and lists aside. sentences: doc_id, sent_idx,
    sentence; accepted: doc_id, sent_idx, id, type, suggested. A null suggestion changes nothing."""
    own = accepted.filter(~F.col("type").isin("connective", "enumeration") & F.col("suggested").isNotNull())
    g = own.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "suggested"))), lambda x: x["suggested"]).alias("texts"))
    src = sentences.join(g, KEY, "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    schema = pa.schema([("doc_id", pa.int64()), ("sent_idx", pa.int32()), ("text", pa.string())])
    edited = src.filter(F.size("texts") > 0)
    step = lambda d, s, t, texts: (d, s, with_edits((t or "").split(), [x.strip("\"“”").strip() for x in texts]))
    done = _texts(edited, [*KEY, "sentence", "texts"], schema, "doc_id bigint, sent_idx int, text string", step)
    return src.filter(F.size("texts") == 0).select(*KEY, F.col("sentence").alias("text")).unionByName(done)


def current_spans(sentences: DataFrame, suggestions: DataFrame) -> DataFrame:
    """id, start, end: the words of the current sentence that a suggestion stands for. suggestions: doc_id, sent_idx, id,
    suggested, state; the accepted ones other than itself move it."""
    s = suggestions.filter("suggested is not null")
    acc = s.filter("state = 'accepted'").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("id", "suggested"))).alias("acc"))
    j = s.join(sentences.select(*KEY, "sentence"), KEY).join(acc, KEY, "left")
    j = j.withColumn("others", F.coalesce(F.transform(F.filter("acc", lambda x: x["id"] != F.col("id")), lambda x: x["suggested"]), F.array().cast("array<string>")))
    schema = pa.schema([("id", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return _texts(j, ["id", "sentence", "suggested", "others"], schema, "id string, start int, end int", lambda i, t, own, others: (i, *span_after((t or "").split(), own, others)))


def merges(accepted: DataFrame, sentences: DataFrame) -> DataFrame:
    """doc_id, sent_idx, second, id, text, before: accepted links with their text, grafted on an accepted rewrite of the first
    sentence where there is one and the join is found, and the pair as it stood before the link."""
    link = accepted.filter("type = 'connective'").select(*KEY, "second", "id", "original", "suggested")
    first = accepted.filter(F.col("type").isin(*COMPOSABLE)).groupBy(*KEY).agg(F.min_by("suggested", "id").alias("rewritten"))
    tail = sentences.select("doc_id", F.col("sent_idx").alias("second"), F.col("sentence").alias("_tail"))
    j = link.join(first, KEY, "left").join(tail, ["doc_id", "second"], "left")
    text = F.coalesce(composed_merge(F.col("original"), F.col("suggested"), F.col("rewritten")), F.col("suggested"))
    before = F.when(F.col("rewritten").isNotNull(), F.concat_ws(" ", F.trim("rewritten"), "_tail")).otherwise(F.col("original"))
    return j.select(*KEY, "second", "id", text.alias("text"), before.alias("before"))


def absorbed(accepted: DataFrame) -> DataFrame:
    """doc_id, sent_idx of the second sentence of every accepted link."""
    return accepted.filter(F.col("type") == "connective").select("doc_id", F.col("second").alias("sent_idx")).filter("sent_idx is not null").distinct()


def shown_sentences(sentences: DataFrame, accepted: DataFrame) -> DataFrame:
    """doc_id, sent_idx, text: every sentence as it goes into the edited text: merged by a link, edited, or as it was; absorbed
    ones are gone."""
    m = merges(accepted, sentences).groupBy(*KEY).agg(F.min_by("text", "id").alias("_merged"))
    j = current_sentences(sentences, accepted).join(m, KEY, "left").join(absorbed(accepted), KEY, "left_anti")
    return j.select(*KEY, F.coalesce("_merged", "text").alias("text"))


def edited_documents(layout: DataFrame, sentences: DataFrame, accepted: DataFrame) -> DataFrame:
    """doc_id, text: the documents with accepted edits. Sentences that follow each other in the layout share a line; an
    accepted list takes its sentence's place; list markers and quotation signs are put back.

    layout: doc_id, block_idx, part, type, text, ordered, number, sentences (structure.layout)."""
    out = shown_sentences(sentences, accepted)
    en = accepted.filter("type = 'enumeration'").groupBy(*KEY).agg(F.min_by(F.struct("list_intro", "list_items"), "id").alias("en"))
    place = W.partitionBy("doc_id").orderBy("block_idx", "part")
    t = layout.withColumn("place", F.row_number().over(place))
    one = t.filter("type = 'sentence'").withColumn("sent_idx", F.element_at("sentences", 1)).join(out.select(*KEY, F.col("text").alias("now")), KEY, "left").join(en, KEY, "left")
    lines_of_list = F.concat_ws("\n", F.coalesce(F.col("en.list_intro"), F.lit("")), F.array_join(F.transform("en.list_items", lambda x: F.concat(F.lit("- "), x)), "\n"))
    prose = one.select("doc_id", "place", F.when(F.col("en").isNotNull(), "line").otherwise("sentence").alias("kind"), F.when(F.col("en").isNotNull(), lines_of_list).otherwise(F.col("now")).alias("text"))
    items = t.filter("type = 'list_item'").select("doc_id", "place", "ordered", "number", F.posexplode("sentences").alias("n", "sent_idx")).join(out, KEY)
    body = items.groupBy("doc_id", "place", "ordered", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("body"))
    marker = F.when(F.coalesce("ordered", F.lit(False)), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("- ")
    listed = body.select("doc_id", "place", F.lit("line").alias("kind"), F.concat(marker, "body").alias("text"))
    rest = t.filter(~F.col("type").isin("sentence", "list_item")).select("doc_id", "place", F.lit("line").alias("kind"), F.when(F.col("type") == "quote", F.concat(F.lit("> "), "text")).when(F.col("type") == "blank", "").otherwise(F.col("text")).alias("text"))
    every = prose.unionByName(listed).unionByName(rest).filter("text is not null")
    w = W.partitionBy("doc_id").orderBy("place")
    starts = (F.col("kind") == "line") | F.coalesce(F.lag("kind").over(w) == "line", F.lit(True))
    every = every.withColumn("line", F.sum(starts.cast("int")).over(w))
    joined = lambda by, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "text"))), lambda x: x["text"]), sep)
    return every.groupBy("doc_id", "line").agg(joined("place", " ").alias("text")).groupBy("doc_id").agg(joined("line", "\n").alias("text"))


def levels(metrics: DataFrame) -> DataFrame:
    """doc_id, sent_idx, part, score, level: one row for each sentence that an edited sentence now consists of, with its own
    dependency and density and the frequency and nouns of all; where one is missing, the score as it was.

    metrics: doc_id, sent_idx, freq_sum, freq_count, sdl_values, cwpc_values, concrete, abstract, undefined, score."""
    f = F.when(F.col("freq_count") > 0, F.col("freq_sum") / F.col("freq_count"))
    nouns = F.col("concrete") + F.col("abstract") + F.col("undefined")
    p = F.when(nouns > 0, F.col("concrete") / nouns)
    many = F.greatest(F.size(F.coalesce("sdl_values", F.array().cast("array<double>"))), F.size(F.coalesce("cwpc_values", F.array().cast("array<double>"))), F.lit(1))
    t = metrics.select("*", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"))
    new = S.difficulty(f, F.get("sdl_values", F.col("part")).cast("double"), F.get("cwpc_values", F.col("part")).cast("double"), p)
    score = F.coalesce(new, F.col("score"))
    return t.select(*KEY, "part", score.alias("score"), S.level(score).alias("level"))


def mean_level(metrics: DataFrame) -> DataFrame:
    """doc_id, sent_idx, score, level: the same for an edited sentence as a whole, over the means of its parts."""
    f = F.when(F.col("freq_count") > 0, F.col("freq_sum") / F.col("freq_count"))
    nouns = F.col("concrete") + F.col("abstract") + F.col("undefined")
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(c))
    score = F.coalesce(S.difficulty(f, mean("sdl_values"), mean("cwpc_values"), F.when(nouns > 0, F.col("concrete") / nouns)), F.col("score"))
    return metrics.select(*KEY, score.alias("score"), S.level(score).alias("level"))


def reconstructed(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_idx, text: sentences from tokens with attached marks (punctuation.attach); no blank follows a word whose
    marks behind it are stops or commas."""
    mark = F.coalesce("trailing", F.lit(""))
    word = F.concat(F.coalesce("leading", F.lit("")), "text", mark, F.when(mark.rlike("[.!?,;:]"), "").otherwise(" "))
    kept = tokens.filter(~F.col("is_punct") | F.col("standalone").isNotNull())
    return kept.groupBy(*KEY).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", word.alias("w")))), lambda x: x["w"]), "")).alias("text"))


def word_places(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_idx, i, place: the number of a token among those that are shown, bare marks left out."""
    kept = tokens.filter(~F.col("is_punct") | F.col("standalone").isNotNull())
    return kept.select(*KEY, "i", (F.row_number().over(W.partitionBy(*KEY).orderBy("i")) - 1).cast("int").alias("place"))


# How types of suggestions and kinds of errors are called.
LABELS = {
    "word_frequency": "Weinig gebruikt woord", "max_sdl": "Zinsstructuur", "content_words_per_clause": "Informatiedichtheid", "abstract_nouns": "Abstracte taal", "spelling": "Spelling/grammatica", "passive": "Passieve zin",
    "subordinate_clause": "Bijzinsstructuur", "sentence_length": "Lange zin", "sentence_rewrite": "Zinsverbetering", "connective": "Verbindingswoord", "enumeration": "Opsomming als lijst",
}
ERRORS = {"spelling": "Spelfout", "grammar": "Grammaticafout"}


def named(values: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def label(kind: Column) -> Column:
    """What a type is called; an unknown one keeps its name."""
    return F.coalesce(named(LABELS, kind), kind)


def note(kind: Column, replacement: Column) -> Column:
    """Which warning belongs to a suggestion: passive, connective, or split for a compound replaced by several words; else null."""
    return F.when(kind.isin("passive", "connective"), kind).when((kind == "word_frequency") & F.contains(F.trim(replacement), F.lit(" ")), "split")


def summary_bars(counts: DataFrame) -> DataFrame:
    """doc_id, dimension, total, remaining, share: remaining cases in per cent of the largest total of the document, most cases
    first. counts: doc_id, dimension, total, remaining (editor.diagnose)."""
    w = W.partitionBy("doc_id")
    top = F.greatest(F.max("total").over(w), F.lit(1))
    rank = F.row_number().over(w.orderBy(F.desc("total"), "dimension"))
    return counts.select("doc_id", rank.alias("rank"), "dimension", "total", "remaining", F.round(100 * F.col("remaining") / top, 1).alias("share"))


def shown_score(score: Column) -> Column:
    """A score as it is shown, with one decimal; a dash for none."""
    return F.when(score.isNull(), "–").otherwise(F.format_string("%.1f", score.cast("double")))
