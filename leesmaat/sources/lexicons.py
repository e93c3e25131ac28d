"""Word lists: loaded, built from a corpus, or derived for tests. A list travels to every executor only if counted small."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


@dataclass
class Lexicons:
    """nouns(word, sem_type, super_sem_type, head), frequency(word, word_count), skiplist(word), manner(word), units(word), dictionary(word)."""

    nouns: DataFrame
    frequency: DataFrame
    skiplist: DataFrame
    manner: DataFrame
    units: DataFrame
    dictionary: DataFrame

    def __post_init__(self):
        self._small: dict[str, bool] = {}

    def side(self, name: str) -> DataFrame:
        """The list for a join: hinted for broadcast only if it has at most BROADCAST_ROWS rows, counted once."""
        df = getattr(self, name)
        if name not in self._small:
            self._small[name] = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return F.broadcast(df) if self._small[name] else df


COLUMNS = {"nouns": ["word", "sem_type", "super_sem_type", "head"], "frequency": ["word", "word_count"], "skiplist": ["word"], "manner": ["word"], "units": ["word"], "dictionary": ["word"]}


def load(spark: SparkSession, folder: str) -> Lexicons:
    """Read <name>.parquet of each list from a folder, only the columns used; repeated words count once."""
    return Lexicons(**{f.name: spark.read.parquet(f"{folder}/{f.name}.parquet").select(*COLUMNS[f.name]).dropDuplicates(["word"]) for f in fields(Lexicons)})


def newest(paths: list[str]) -> str:
    """Of files whose names carry a version, the one whose stem sorts last."""
    return sorted(paths, key=lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0], reverse=True)[0]


def from_corpus(words: DataFrame) -> DataFrame:
    """Frequency list of a table of words (column word): log10 of occurrences per thousand million, over all of them."""
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = words.count()
    return counts.select("word", F.log10(F.col("n") / F.lit(float(max(total, 1))) * 1e9).alias("word_count"))


def derived(frequency: DataFrame) -> Lexicons:
    """Lists computed from the words of a frequency list by plain arithmetic on their length: for tests of the joins, no linguistics."""
    n = F.length("word")
    kind = F.when(n % 4 == 0, "concrete").when(n % 4 == 1, "abstract").when(n % 4 == 2, "undefined")
    nouns = frequency.filter(n % 4 != 3).select("word", F.when(n % 5 == 0, "human").when(n % 5 == 1, "place").otherwise("other").alias("sem_type"), kind.alias("super_sem_type"), F.when(n >= 10, F.expr("right(word, 5)")).alias("head"))
    spark = frequency.sparkSession
    return Lexicons(
        nouns=nouns,
        frequency=frequency.select("word", "word_count"),
        skiplist=frequency.filter(n % 11 == 0).select("word"),
        manner=frequency.filter(n == 5).select("word"),
        units=spark.createDataFrame([(u,) for u in ("kg", "cm", "km", "mm", "m", "l", "uur")], "word string"),
        dictionary=frequency.select("word"),
    )
