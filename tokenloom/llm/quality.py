"""Quality rules: how far a document's histograms are from its language's.

Two histograms describe a document: characters by class, and words by common
word of its language (with one bin for all others). A language's reference is the
sum over its documents that pass the base rules. A document is rejected when the
Jensen-Shannon distance (base 2, 0 to 1) of a histogram from the reference
exceeds its limit; histograms of too few characters or words, or references that
rest on too few words, are not judged.

Base rules and counts are fixed: words are runs of other characters than the
six ASCII white-space ones; a document fails with fewer than 50 words or when
more than half of its words lie in three-word windows found twice or more.

Cases: a null or empty text has no words and fails; a null or unlisted language
is a language of its own without common words; repeated rows are judged alike;
null ids and other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.hashing import text_or_empty
from tokenloom.session import stage

# Frequent function words.
COMMON_WORDS = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "en": "the of and to in a is that for it as was with be by on not he his but at are this".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se".split(),
}
COMMON_SLOTS = max(map(len, COMMON_WORDS.values()))
MIN_WORDS, REPEATED_PERCENT = 50, 50
MAX_CHARACTER_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.27
# Guards: characters and words a judged document has, and common words in a reference.
MIN_CHARACTERS, MIN_JUDGED_WORDS, MIN_REFERENCE_WORDS = 200, 100, 2_000

# Up to this many languages are broadcast (one short row each); more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000

_WORD_GAP = r"[\x20\x09-\x0D]+"
_CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:!?]", "sign": r"[#*$%&|<>@+=_/\\~^{}()\[\]-]"}


def _repeated(words: str) -> Column:
    """Words inside three-word windows that occur twice or more, from an array of words.

    Window hashes are sorted with their places; equal neighbours are repeats, and
    the places of repeats in order give the length of their union.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words)

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
        return on_windows(windows)

    def on_windows(windows: Column) -> Column:
        def repeats(w: Column) -> Column:
            ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
            return _let(ordered, lambda s: _union(F.sort_array(F.transform(
                F.filter(
                    F.transform(s, lambda e, k: F.struct(e["i"].alias("i"), (
                        (F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False))) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))
                    ).alias("again"))),
                    lambda e: e["again"],
                ),
                lambda e: e["i"],
            ))))

        return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(repeats(w)))

    return F.when(n < 3, F.lit(0)).otherwise(_let(hashes, of_hashes)).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _union(places: Column) -> Column:
    """Words covered by windows of three that begin at the sorted places."""
    return _let(places, lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    ))


def document_counts(docs: DataFrame) -> DataFrame:
    """Counts and histograms of each whole text, without moving a text."""
    text, words = F.col("text"), F.col("words")
    split = docs.select("doc_id", F.col("lang"), text_or_empty().alias("text")).withColumn("words", F.array_remove(F.split("text", _WORD_GAP), ""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    letters = F.length(F.regexp_replace("text", _WORD_GAP, ""))
    symbols = F.regexp_count("text", F.lit("[#*$%&|<>]"))
    common = reduce(
        lambda rest, lang: F.when(F.col("lang") == lang, _common_counts(COMMON_WORDS[lang])).otherwise(rest),
        COMMON_WORDS, F.array_repeat(F.lit(0), COMMON_SLOTS),
    )
    return split.select(
        "doc_id", "lang",
        F.size(words).cast("long").alias("n_words"),
        letters.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        _let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        _repeated("words").alias("n_repeat_words"),
        F.length(text).cast("long").alias("n_all"),
        *(F.regexp_count("text", F.lit(p)).cast("long").alias(name) for name, p in _CLASSES.items()),
        F.regexp_count("text", F.lit(r"[^\x00-\x7F]")).cast("long").alias("other"),
        common.alias("common"),
    )


def _common_counts(listed: list[str]) -> Column:
    """How often each listed word occurs, by one pass over the words."""
    found = F.filter("words", lambda w: w.isin(*listed))
    counts = lambda f: F.array(*(F.size(f) - F.size(F.array_remove(f, w)) for w in listed))
    padded = lambda f: F.concat(counts(f), F.array_repeat(F.lit(0), COMMON_SLOTS - len(listed)))
    return _let(found, padded)


def _character_bins() -> list[Column]:
    named = [F.col(c) for c in (*_CLASSES, "other")]
    space = F.col("n_all") - F.col("word_chars")
    return [*named, space, F.greatest(F.lit(0), F.col("word_chars") - reduce(lambda a, b: a + b, named))]


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; 0 when one has no mass."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def distance(sums: Column) -> Column:
        def part(x, y):
            x, y = x / sums["p"], y / sums["q"]
            return (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2

        return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(p, q, part))))

    sums = F.struct(total(p).alias("p"), total(q).alias("q"))
    return _let(sums, lambda s: F.when((s["p"] <= 0) | (s["q"] <= 0), F.lit(0.0)).otherwise(distance(s)))


def language_references(counted: DataFrame) -> DataFrame:
    """``(lang, reference_characters, reference_words, reference_hits)`` from documents that pass the base rules."""
    bins = [F.sum(c).cast("double") for c in _character_bins()]
    slots = [F.sum(F.get("common", F.lit(i))).cast("double") for i in range(COMMON_SLOTS)]
    sums = counted.where(~F.col("base_failed")).groupBy("lang").agg(
        F.array(*bins).alias("reference_characters"), F.array(*slots).alias("hits"), F.sum("n_words").cast("double").alias("n")
    )
    hits = F.aggregate("hits", F.lit(0.0), lambda a, x: a + x)
    return sums.select("lang", "reference_characters", F.concat("hits", F.array(F.col("n") - hits)).alias("reference_words"), hits.alias("reference_hits"))


def judge(docs: DataFrame) -> DataFrame:
    """Base columns, both distances and ``kept`` of every document."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    counted = stage(document_counts(docs).withColumn("base_failed", failed), "counts")
    references = stage(language_references(counted).withColumnRenamed("lang", "reference_lang"), "references")
    if references.count() <= BROADCAST_LANGUAGES:
        references = F.broadcast(references)
    joined = counted.join(references, F.col("lang").eqNullSafe(F.col("reference_lang")), "left")
    characters = F.array(*(c.cast("double") for c in _character_bins()))
    hits = F.aggregate("common", F.lit(0.0), lambda a, x: a + x)
    words = F.concat(F.transform("common", lambda x: x.cast("double")), F.array(F.col("n_words") - hits))
    known = F.col("reference_characters").isNotNull()
    far = joined.select(
        "*",
        F.when(known & (F.col("n_all") >= MIN_CHARACTERS), jensen_shannon(characters, F.col("reference_characters"))).alias("character_distance"),
        F.when(known & (F.col("n_words") >= MIN_JUDGED_WORDS) & (F.col("reference_hits") >= MIN_REFERENCE_WORDS),
               jensen_shannon(words, F.col("reference_words"))).alias("word_distance"),
    )
    divergent = (F.coalesce("character_distance", F.lit(0.0)) > MAX_CHARACTER_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return far.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~divergent).alias("kept"), "character_distance", "word_distance",
    )
