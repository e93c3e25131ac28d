"""Fixed values of the readability model: they must equal the published ones for results to agree."""

# Linear model of reading difficulty: intercept and weights of the four sentence features.
INTERCEPT = -4.20782
W_FREQUENCY = 17.283729
W_DEPENDENCY = -1.624415
W_CONTENT_WORDS = -2.536780
W_CONCRETE = 16.001231

# Lower score bounds of difficulty levels 2, 3 and 4.
LEVEL_BOUNDS = (34, 46, 58)

# Share of adult readers, in per cent, who find a text of the level hard.
READERS_STRUGGLING = {1: 14, 2: 29, 3: 53, 4: 78}

# Frequency of a word that the frequency lexicon lacks: log10(1 / total * 1e9).
MISSING_FREQUENCY = 1.359228547196266

# Words before a word in which its referent must occur for it not to be new.
NOVELTY_SPAN = 50

# Thresholds of the detectors.
THRESHOLDS = {
    "word_frequency": 3.0,
    "max_sdl": 5,
    "max_sdl_words": 12,
    "content_words_per_clause": 7,
    "abstract_share": 0.7,
    "abstract_nouns": 2,
    "sentence_length": 25,
    "subordinate_clauses": 1,
    "enumeration_items": 3,
    "enumeration_span": 12,
}

# Order in which the problems of one sentence are taken up.
PRIORITY = ("sentence_length", "passive", "subordinate_clause", "max_sdl", "content_words_per_clause", "abstract_nouns", "word_frequency")
SENTENCE_LEVEL = ("max_sdl", "content_words_per_clause", "abstract_nouns", "passive", "subordinate_clause", "sentence_length")
BUNDLE = 8
SPELLING_CHUNK = 25
BUDGET_WORDS, BUDGET_MOST = 10, 25

# Characters that are quotation marks of some kind.
QUOTES = "«»‘’‛“”„‟‹›"

# Part-of-speech classes.
NOUNS = ("NOUN", "PROPN")
CONTENT = ("NOUN", "PROPN", "VERB", "ADJ")
SUBORDINATE = ("acl:relcl", "advcl", "ccomp", "csubj", "acl")
MODIFIERS = ("amod", "nummod", "nmod", "nmod:poss", "acl")
CONSTITUENTS = ("NOUN", "PROPN", "PRON", "ADJ", "NUM", "ADV")

# Indefinite pronouns that refer to people.
PERSON_PRONOUNS = ("iemand", "niemand", "elk", "ieder", "iedereen", "eenieder", "menigeen", "elkeen", "sommigen", "enigen", "anderen", "velen", "allen", "weinigen", "enkelen", "beiden")

# Separable verb particles.
PARTICLES = (
    "tegen", "terug", "samen", "langs", "tussen", "achter", "binnen", "buiten", "boven", "onder", "voort", "vooruit", "verder", "door", "over", "voor", "weg",
    "mee", "aan", "af", "op", "uit", "in", "na", "toe", "om", "bij", "neer", "open", "dicht", "vast", "los", "rond",
)

# Endings of diminutives and of inflected and compared adjectives.
DIMINUTIVES = ("netjes", "netje", "etjes", "etje", "pjes", "pje", "kjes", "kje", "tjes", "tje", "jes", "je")
ADJECTIVE_ENDINGS = ("ere", "er", "ste", "st", "e")

# Connectives that already link a sentence to the one before it.
CONNECTIVES = (
    "want", "omdat", "doordat", "aangezien", "zodat", "waardoor", "dus", "daarom", "hierdoor", "daardoor", "maar", "echter", "toch", "hoewel", "terwijl", "immers",
    "namelijk", "bovendien", "daarnaast", "verder", "ook", "vervolgens", "daarna", "kortom", "derhalve", "bijgevolg", "desondanks", "niettemin", "integendeel", "sterker",
)

# Conjunctions whose clauses must stay joined, and coordinators that close a list.
CLAUSE_CONJUNCTIONS = ("maar", "want", "dus")
LIST_COORDINATORS = ("en", "of")

# A word at least this long may be replaced by several.
COMPOUND_LEAST = 15
