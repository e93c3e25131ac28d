"""From an analysis to checked suggestions, stage by stage; only the calls of a language model leave the JVM.

spelling (model, then dictionary for what it left) -> jobs of the plan (rewrites, lists, bundles of words) -> judged swaps
-> rewrites of sentences that became lists out -> links between sentences. Every stage is a table of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leesmaat import constants as K
from leesmaat.functions import guards as G
from leesmaat.functions import text as T
from leesmaat.operators import rewrite, spelling, structure, validation
from leesmaat.workspace import cut

COLUMNS = {
    "doc_id": "bigint", "id": "string", "type": "string", "sent_idx": "int", "second": "int", "i": "int", "original": "string", "suggested": "string", "explanation": "string", "word": "string", "replacement": "string",
    "relation": "string", "list_intro": "string", "list_items": "array<string>", "component_types": "array<string>", "variants": "array<struct<key string,label string,text string>>", "model": "string",
}
REWRITES = ("sentence_rewrite", "sentence_length", "max_sdl", "content_words_per_clause", "abstract_nouns", "passive", "subordinate_clause")


def suggestions(df: DataFrame) -> DataFrame:
    """The columns of a suggestion, null where a kind has none; id follows from what it proposes where."""
    known = set(df.columns)
    out = df.select(*[(F.col(c) if c in known else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items() if c != "id"])
    key = F.concat_ws("|", F.col("doc_id").cast("string"), "type", F.col("sent_idx").cast("string"), F.coalesce(F.col("i").cast("string"), F.lit("")), F.coalesce("word", F.lit("")), F.coalesce("suggested", F.lit("")))
    return out.withColumn("id", F.substring(F.sha2(key, 256), 1, 16)).select(*COLUMNS)


def job_key(*parts: str) -> Column:
    return F.concat_ws("/", *[F.col(p).cast("string") for p in parts])


def ask(jobs: DataFrame, factory, prompt: str = "prompt", level: str | None = None, **options) -> DataFrame:
    """jobs with content and model; failed calls have a null content. jobs has the column job; level: the text's, for the
    instruction to aim one lower."""
    system = F.lit(rewrite.SYSTEM) if level is None else F.concat(F.lit(rewrite.SYSTEM), F.coalesce(rewrite.level_constraint(F.col(level)), F.lit("")))
    todo = cut(jobs.withColumn("_system", system), "jobs")
    answers = cut(rewrite.run_jobs(todo, factory, "job", "_system", prompt, **options), "answers")  # no call is made twice
    return todo.drop("_system").join(answers.select("job", "content", "model", "error"), "job")


# --- spelling ---------------------------------------------------------------------------------------------------------


def dictionary_spelling(features: DataFrame, texts: DataFrame, lexicons, covered: DataFrame | None = None) -> DataFrame:
    """A suggestion for the first place of every misspelt word of a sentence, with its best correction; words in `covered`
    (doc_id, sent_idx, word) are left out."""
    words = spelling.unknown_words(features, lexicons.dictionary)
    best = spelling.best_corrections(words, lexicons.frequency).select("word", F.col("candidate").alias("replacement"))
    at = features.filter("is_content_plain").groupBy("doc_id", "sent_idx", F.col("lower").alias("word")).agg(F.min("i").alias("i"))
    if covered is not None:
        at = rewrite.uncovered(at, covered, ["doc_id", "sent_idx", "word"])
    s = at.join(best, "word").join(texts.select("doc_id", "sent_idx", F.col("sentence").alias("original")), ["doc_id", "sent_idx"])
    s = s.withColumn("suggested", spelling.correct_first(F.col("original"), F.col("word"), F.col("replacement"))).filter("suggested <> original")
    return suggestions(s.withColumn("type", F.lit("spelling")).withColumn("model", F.lit("dictionary")))


def model_spelling(chunks: DataFrame, texts: DataFrame, lexicons, factory, **options) -> DataFrame:
    """What a model finds misspelt in numbered sentences, apart from what spelling.reject_reason turns down.
    chunks: doc_id, chunk, prompt (planner.spelling_chunks)."""
    jobs = chunks.withColumn("job", job_key("doc_id", "chunk")).withColumn("prompt", F.replace(F.lit(rewrite.TEMPLATES["spelling"]), F.lit("{sentence}"), F.col("prompt")))
    answers = ask(jobs, factory, **({"max_tokens": rewrite.token_limit("spelling")} | options))
    found = rewrite.parsed(answers.filter("content is not null"), "job", "content", "WOORD", rewrite.FIELDS["spelling"]).join(answers.select("job", "doc_id", "model"), "job")
    field = lambda k: F.trim(F.try_element_at("fields", F.lit(k)))
    number = F.regexp_extract(F.coalesce(field("ZIN_NUMMER"), F.lit("")), r"(\d+)", 1)
    p = found.select("doc_id", "model", F.when(number != "", number.cast("int") - 1).alias("sent_idx"), F.lower(field("WOORD")).alias("wrong"), F.lower(field("VERBETERING")).alias("right"), field("UITLEG").alias("explanation"))
    p = p.filter("wrong is not null and right is not null and sent_idx is not null").dropDuplicates(["doc_id", "sent_idx", "wrong"])
    p = p.join(texts.select("doc_id", "sent_idx", "sentence"), ["doc_id", "sent_idx"])  # a number out of range finds no sentence
    ok = spelling.reject_reason(p.withColumn("_all", F.lit(1 << 30)), lexicons.frequency, "_all").filter("reject_reason is null")
    s = ok.withColumn("suggested", spelling.correct_first(F.col("sentence"), F.col("wrong"), F.col("right")))
    return suggestions(s.select("doc_id", "sent_idx", F.col("wrong").alias("word"), F.col("right").alias("replacement"), F.col("sentence").alias("original"), "suggested", "explanation", "model", F.lit("spelling").alias("type")))


# --- jobs of the plan -------------------------------------------------------------------------------------------------


def rewrite_prompts(jobs: DataFrame, triggers: DataFrame, texts: DataFrame) -> DataFrame:
    """job, doc_id, sent_idx, types, sentence, prompt of the jobs that take a whole sentence: what is wrong as a list, one line
    for each problem, and the template of its kind."""
    j = jobs.filter(F.col("kind").isin("single", "consolidated") & (F.element_at("types", 1) != "word_frequency")).withColumn("job", job_key("doc_id", "job_idx"))
    each = j.select("job", "doc_id", "sent_idx", F.posexplode("types").alias("at", "type")).join(triggers.filter("type <> 'word_frequency'").select("doc_id", "sent_idx", "type", "value", "word"), ["doc_id", "sent_idx", "type"])
    line = F.concat(F.lit("- "), rewrite.issue_text(F.col("type"), F.col("value"), F.col("word")))
    issue = each.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("l")))), lambda x: x["l"]), "\n").alias("issue"))
    t = j.join(issue, "job").join(texts.select("doc_id", "sent_idx", "sentence"), ["doc_id", "sent_idx"])
    fill = lambda k: F.replace(F.replace(F.lit(rewrite.TEMPLATES[k]), F.lit("{issue}"), F.col("issue")), F.lit("{sentence}"), F.col("sentence"))
    one = F.element_at("types", 1)
    return t.select("job", "doc_id", "sent_idx", "types", "sentence", F.when(one == "enumeration", fill("enumeration")).otherwise(fill("sentence_rewrite")).alias("prompt"))


def rewrites(answers: DataFrame, lexicons, disagreements=None) -> DataFrame:
    """Suggestions of answered rewrite jobs: every variant passes all guards by itself, equal ones count once, and the cautious
    one is shown first if there are two. A job of one problem keeps its type. answers: job, doc_id, sent_idx, types, sentence,
    content, model. disagreements: candidates (key, text) to the keys whose adjectives don't agree."""
    a = answers.filter(F.col("content").isNotNull() & (F.element_at("types", 1) != "enumeration"))
    fields = rewrite.parsed(a, "job", "content", names=rewrite.FIELDS["sentence_rewrite"]).select("job", "fields")
    j = a.join(fields, "job")
    v = validation.variants(j.select("job", "sentence", "fields"))
    v = validation.backstop(v.join(j.select("job", "sentence"), "job").withColumn("key_", F.concat_ws("/", "job", "key")), "key_", "sentence", "text", lexicons, disagreements).filter("failure is null")
    order = F.when(F.col("key") == "conservative", 0).otherwise(1)
    both = v.groupBy("job").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "key", "label", "text"))), lambda x: x.dropFields("o")).alias("variants"))
    s = j.join(both, "job").withColumn("suggested", F.col("variants")[0]["text"]).withColumn("variants", F.when(F.size("variants") > 1, F.col("variants")))
    kind = F.when(F.size("types") == 1, F.element_at("types", 1)).otherwise("sentence_rewrite")
    return suggestions(s.select("doc_id", "sent_idx", kind.alias("type"), F.col("sentence").alias("original"), "suggested", F.try_element_at("fields", F.lit("UITLEG")).alias("explanation"), F.col("types").alias("component_types"), "variants", "model"))


def lists(answers: DataFrame) -> DataFrame:
    """Suggestions of answered jobs that make a list of an enumeration."""
    a = answers.filter(F.col("content").isNotNull() & (F.element_at("types", 1) == "enumeration")).withColumn("l", validation.parse_list(F.col("content")))
    ok = a.filter(validation.list_failure(F.col("sentence"), F.col("l.intro"), F.col("l.items")).isNull())
    return suggestions(ok.select("doc_id", "sent_idx", F.lit("enumeration").alias("type"), F.col("sentence").alias("original"), validation.list_text(F.col("l.intro"), F.col("l.items")).alias("suggested"), F.col("l.explanation").alias("explanation"), F.col("l.intro").alias("list_intro"), F.col("l.items").alias("list_items"), "model"))


def bundle_items(jobs: DataFrame, texts: DataFrame) -> DataFrame:
    """job, n, doc_id, sent_idx, i, word, sentence: the words of the bundles, numbered from 1. A job of one word is a bundle of one."""
    words = jobs.filter(F.element_at("types", 1) == "word_frequency").withColumn("job", job_key("doc_id", "job_idx"))
    each = words.select("job", "doc_id", F.posexplode("items").alias("n", "x")).select("job", (F.col("n") + 1).alias("n"), "doc_id", "x.sent_idx", "x.i", "x.word")
    return each.join(texts.select("doc_id", "sent_idx", "sentence"), ["doc_id", "sent_idx"]).select("job", "n", "doc_id", "sent_idx", "i", "word", "sentence")


def bundle_prompts(items: DataFrame) -> DataFrame:
    """job, doc_id, prompt: the words of a bundle with the sentence each stands in."""
    line = F.concat(F.col("n").cast("string"), F.lit('. WOORD: "'), "word", F.lit('"\n   ZIN: '), "sentence")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n\n")
    return items.groupBy("job", "doc_id").agg(text.alias("items")).select("job", "doc_id", F.replace(F.lit(rewrite.TEMPLATES["wordfreq_bundle"]), F.lit("{items}"), F.col("items")).alias("prompt"))


def swaps(items: DataFrame, answers: DataFrame, lexicons) -> DataFrame:
    """Suggestions of answered bundles: the first block of each number counts, numbers beyond the bundle don't; the rewrite must
    pass the guards and the replacement, if named, lie in a higher band. Quotation marks the sentence hasn't go."""
    blocks = rewrite.parsed(answers.filter("content is not null"), "job", "content", "NUMMER", rewrite.FIELDS["wordfreq_bundle"])
    field = lambda k: F.try_element_at("fields", F.lit(k))
    number = F.regexp_extract(field("NUMMER"), r"(\d{1,9})", 1)
    b = blocks.withColumn("n", F.when(number != "", number.cast("int"))).filter("n is not null")
    b = b.withColumn("_r", F.row_number().over(W.partitionBy("job", "n").orderBy("block"))).filter("_r = 1")
    t = items.join(b.select("job", "n", field("HERSCHRIJVING").alias("raw"), F.nullif(F.trim(field("VERVANGING")), F.lit("")).alias("replacement"), field("UITLEG").alias("explanation")), ["job", "n"]).join(answers.select("job", "model"), "job")
    marks = "[\"“”‘’']"
    lead = F.when(F.col("sentence").rlike(f"^{marks}"), F.col("raw")).otherwise(F.regexp_replace("raw", f"^{marks}+", ""))
    t = t.withColumn("suggested", F.when(F.col("sentence").rlike(f"{marks}$"), lead).otherwise(F.regexp_replace(lead, f"{marks}+$", "")))
    f = lexicons.frequency
    t = t.join(f.select("word", F.col("word_count").alias("_fw")), "word", "left").join(f.select(F.col("word").alias("_low"), F.col("word_count").alias("_fr")), F.lower("replacement") == F.col("_low"), "left")
    miss = F.lit(K.MISSING_FREQUENCY)
    t = t.filter(F.coalesce(G.passes_band(F.col("word"), F.lower("replacement"), F.coalesce("_fw", miss), F.col("_fr")), F.lit(False)))
    ok = validation.backstop(t.withColumn("_k", job_key("job", "n")), "_k", "sentence", "suggested", lexicons).filter("failure is null")
    return suggestions(ok.withColumn("type", F.lit("word_frequency")).withColumnRenamed("sentence", "original"))


def judged_swaps(found: DataFrame, factory, **options) -> DataFrame:
    """Suggestions without the swaps of words a model finds wrong in their sentence; a failed or unclear verdict keeps them."""
    s = found.filter((F.col("type") == "word_frequency") & F.col("replacement").isNotNull())
    text = F.lit(rewrite.TEMPLATES["judge"])
    for name, c in (("{word}", "word"), ("{replacement}", "replacement"), ("{sentence}", "suggested")):
        text = F.replace(text, F.lit(name), F.col(c))
    verdicts = ask(s.select(F.col("id").alias("job"), text.alias("prompt")), factory, **(options | {"max_tokens": 32}))
    out = verdicts.filter(~validation.keeps_swap(F.col("content"))).select(F.col("job").alias("id"))
    return found.join(out, "id", "left_anti").select(*COLUMNS)


# --- links ------------------------------------------------------------------------------------------------------------


def link_prompts(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """job, doc_id, prompt: a document's pairs of sentences that could be linked, by the number of the first."""
    first, second = texts.select("doc_id", "sent_idx", F.col("sentence").alias("a")), texts.select("doc_id", F.col("sent_idx").alias("second"), F.col("sentence").alias("b"))
    p = candidates.select("doc_id", "sent_idx", "second").join(first, ["doc_id", "sent_idx"]).join(second, ["doc_id", "second"])
    line = F.concat((F.col("sent_idx") + 1).cast("string"), F.lit(". "), "a", F.lit(" || "), "b")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", line.alias("l")))), lambda x: x["l"]), "\n")
    g = p.groupBy("doc_id").agg(text.alias("pairs"))
    return g.select(F.col("doc_id").cast("string").alias("job"), "doc_id", F.replace(F.lit(rewrite.TEMPLATES["connective"]), F.lit("{sentence}"), F.col("pairs")).alias("prompt"))


def links(candidates: DataFrame, texts: DataFrame, answers: DataFrame, lexicons, disagreements=None) -> DataFrame:
    """Suggestions that join two sentences: the pair was a candidate, the relation is strong, nothing is added, and the merged
    sentence passes the guards; the first block of each pair counts."""
    blocks = rewrite.parsed(answers.filter("content is not null"), "job", "content", "NA_ZIN", rewrite.FIELDS["connective"]).join(answers.select("job", "doc_id", "model"), "job")
    field = lambda k: F.try_element_at("fields", F.lit(k))
    number = F.regexp_extract(field("NA_ZIN"), r"(\d{1,9})", 1)
    b = blocks.withColumn("sent_idx", F.when(number != "", number.cast("int") - 1)).withColumn("_r", F.row_number().over(W.partitionBy("job", "sent_idx").orderBy("block"))).filter("_r = 1")
    b = b.select("doc_id", "sent_idx", "model", F.lower(F.trim(field("RELATIE"))).alias("relation"), T.clean_variant(field("HERSCHRIJVING")).alias("suggested"), field("UITLEG").alias("explanation"))
    first, second = texts.select("doc_id", "sent_idx", F.col("sentence").alias("a")), texts.select("doc_id", F.col("sent_idx").alias("second"), F.col("sentence").alias("b"))
    p = candidates.select("doc_id", "sent_idx", "second").join(b, ["doc_id", "sent_idx"]).join(first, ["doc_id", "sent_idx"]).join(second, ["doc_id", "second"]).withColumn("original", F.concat_ws(" ", "a", "b"))
    p = p.filter(validation.link_failure(F.col("relation"), F.col("original"), F.col("suggested")).isNull())
    ok = validation.backstop(p.withColumn("_k", job_key("doc_id", "sent_idx")), "_k", "original", "suggested", lexicons, disagreements, joins=True).filter("failure is null")
    return suggestions(ok.withColumn("type", F.lit("connective")))


# --- all of it --------------------------------------------------------------------------------------------------------


def generate(a, factory, cap: int | None = None, consolidate: bool = True, enumerations: bool = False, judge: bool = False, disagreements=None, **options) -> DataFrame:
    """All suggestions for the documents of an analysis. factory makes the language model in every worker; options go to
    rewrite.run_jobs. Every stage that calls it writes its answers once."""
    from leesmaat.plans import planner

    texts = cut(structure.sentence_texts(a.tokens if "block_idx" in a.tokens.columns else a.tokens.withColumn("block_idx", F.lit(0))), "texts")
    by_model = cut(model_spelling(planner.spelling_chunks(texts), texts, a.lexicons, factory, **options), "spelling")
    by_list = dictionary_spelling(a.features, texts, a.lexicons, by_model.select("doc_id", "sent_idx", "word"))
    triggers = cut(a.triggers(enumerations), "triggers")
    jobs = cut(a.plan(cap, consolidate, enumerations), "plan")
    levels = a.scores.select("doc_id", "level")
    whole = ask(rewrite_prompts(jobs, triggers, texts).join(levels, "doc_id", "left"), factory, level="level", **options)
    items = cut(bundle_items(jobs, texts), "items")
    words = ask(bundle_prompts(items).join(levels, "doc_id", "left"), factory, level="level", **({"max_tokens": rewrite.token_limit("wordfreq_bundle", K.BUNDLE)} | options))
    found = by_model.unionByName(by_list).unionByName(rewrites(whole, a.lexicons, disagreements)).unionByName(lists(whole)).unionByName(swaps(items, words, a.lexicons))
    found = cut(found, "found")
    if judge:
        found = judged_swaps(found, factory, **options)
    found = rewrite.without_enumerated(found).select(*COLUMNS)
    sentences = a.tokens.groupBy("doc_id", "sent_idx").agg(F.count(F.when(~F.col("is_punct"), 1)).alias("sent_length"), F.min_by("lower", "i").alias("first_word"), F.max_by("lower", "i").alias("last_token"))
    place = structure.paragraphs(a.layout) if a.structured else sentences.select("doc_id", "sent_idx", F.lit(0).alias("paragraph"))
    pairs = cut(planner.connective_candidates(sentences.join(place, ["doc_id", "sent_idx"]), ["paragraph"]), "pairs")
    linked = links(pairs, texts, ask(link_prompts(pairs, texts), factory, **options), a.lexicons, disagreements)
    return found.unionByName(linked)


# --- merges that carry a rewrite --------------------------------------------------------------------------------------


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[.,;:!?()\"'“”‘’]", ""))


def inserted_word(original: Column, suggested: Column) -> Column:
    """The first word of a merged sentence that the pair it was made from hasn't; null for none."""
    old = F.transform(F.split(original, r"\s+"), _bare)
    return F.get(F.filter(F.transform(F.split(suggested, r"\s+"), _bare), lambda w: (w != "") & ~F.array_contains(old, w)), F.lit(0))


def composed_merge(original: Column, suggested: Column, first: Column) -> Column:
    """A rewrite of the first sentence with the tail of the merged one behind it; null where the join can't be found."""
    word = inserted_word(original, suggested)
    at = F.instr(F.lower(suggested), F.concat(F.lit(", "), word, F.lit(" ")))
    return F.when(at > 0, F.concat(F.regexp_replace(F.trim(first), "[.!?]+$", ""), F.substring(suggested, at, F.length(suggested))))


def composed(found: DataFrame) -> DataFrame:
    """id, rewrite, text: every link with every rewrite of its first sentence. found: doc_id, id, type, sent_idx, original, suggested."""
    link = found.filter("type = 'connective'").select("doc_id", "sent_idx", "id", "original", "suggested")
    r = found.filter(F.col("type").isin(*REWRITES)).select("doc_id", "sent_idx", F.col("id").alias("rewrite"), F.col("suggested").alias("first"))
    text = composed_merge(F.col("original"), F.col("suggested"), F.col("first"))
    return link.join(r, ["doc_id", "sent_idx"]).select("id", "rewrite", text.alias("text")).filter("text is not null")


def metrics(texts: DataFrame, key: str, text: str, lexicons, annotator=None) -> DataFrame:
    """key and the sums that merge to a score: of frequencies and their number, of noun classes, and the lists of longest
    dependencies and content words per clause of its sentences. Null and empty texts have none."""
    from leesmaat.api import Readability

    t = cut(texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("doc_id")).filter("text is not null"), "proposals")
    s = Readability(lexicons, annotator).analyze(t.select("doc_id", "text"), structure=False).sentences
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("sent_idx", c)))), lambda x: x[c])
    g = s.groupBy("doc_id").agg(
        F.sum("freq_sum").alias("freq_sum"), F.sum("freq_count").alias("freq_count"), ordered("max_sdl").alias("sdl_values"), ordered("content_words_per_clause").alias("cwpc_values"), F.sum("concrete").alias("concrete"), F.sum("abstract").alias("abstract"), F.sum("undefined").alias("undefined")
    )
    return t.select("key", "doc_id").join(g, "doc_id").drop("doc_id").withColumnRenamed("key", key)
