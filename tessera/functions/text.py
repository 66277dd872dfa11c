"""Tokenizers, splitters and text measures as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column, least: int = 2) -> Column:
    """Lower-cased words of at least ``least`` characters; all but word characters separate."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+"), lambda w: F.length(w) >= least)


def tokenize_alnum(text: Column, least_bytes: int = 2) -> Column:
    """Lower-cased runs of letters and digits of at least ``least_bytes`` bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= least_bytes)


def normalize_name(name: Column) -> Column:
    """Lower-cased, trimmed, punctuation dropped, spaces collapsed."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"[^\w\s]", ""), r"\s+", " ")


def normalize_id(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(label)), " ", "_")


def estimate_tokens(text: Column) -> Column:
    """A token is about four bytes."""
    return F.floor(F.octet_length(text) / 4)


def words(text: Column) -> Column:
    """Words with apostrophes and hyphens kept; other punctuation separates."""
    return F.filter(F.split(F.regexp_replace(text, r"[^\w\s'-]", " "), r"\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def syllables(word: Column) -> Column:
    """Words of up to three letters have one; else runs of one or two vowels, silent endings dropped, at least one."""
    bare = F.trim(F.lower(word))
    cut = F.regexp_replace(F.regexp_replace(bare, r"(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), r"^y", "")
    return F.when(F.length(bare) <= 3, 1).otherwise(F.greatest(F.size(F.regexp_extract_all(cut, F.lit(r"[aeiouy]{1,2}"), F.lit(0))), F.lit(1)))


#: Upper ends of the sentence-length buckets, in words; the last has none.
LENGTH_BUCKETS = {"one": (1, 1), "short": (2, 6), "medium": (7, 15), "long": (16, 25), "longer": (26, 39), "longest": (40, None)}


def length_bucket(n_words: Column) -> Column:
    """Bucket of a sentence; one of no words counts as short."""
    return (
        F.when(n_words == 1, "one").when(n_words <= 6, "short").when(n_words <= 15, "medium")
        .when(n_words <= 25, "long").when(n_words <= 39, "longer").otherwise("longest")
    )


def consecutive_runs(lengths: Column, tolerance: int = 3) -> Column:
    """How many lengths stand third or later in a run whose neighbours differ by ``tolerance`` at most."""
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("total"))

    def step(acc, x):
        near = F.coalesce(F.abs(x - acc["last"]) <= tolerance, F.lit(False))
        run = F.when(near, acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(x.cast("int").alias("last"), run.alias("run"), (acc["total"] + F.when(run >= 2, 1).otherwise(0)).alias("total"))

    return F.aggregate(lengths, zero, step, lambda acc: acc["total"])


def longest_near_run(lengths: Column, tolerance: int = 3) -> Column:
    """The most lengths in a row whose neighbours differ by ``tolerance`` at most; 1 at least."""
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.lit(1).alias("run"), F.lit(1).alias("most"))

    def step(acc, x):
        run = F.when(F.coalesce(F.abs(x - acc["last"]) <= tolerance, F.lit(False)), acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.cast("int").alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(lengths, zero, step, lambda acc: acc["most"])


def flow_insights(lengths: Column) -> Column:
    """Struct of a text's sentence lengths: sentences in near runs, dominant bucket (the first of the fullest; null without sentences), variety, monotony (five near ones in a row)."""
    names = list(LENGTH_BUCKETS)
    count = lambda name: F.size(F.filter(lengths, lambda n: length_bucket(n) == name))
    counts = F.array(*map(count, names))
    dominant = F.element_at(F.array(*map(F.lit, names)), F.array_position(counts, F.array_max(counts)).cast("int"))
    return F.struct(
        consecutive_runs(lengths).alias("consecutive_patterns"), F.when(F.size(lengths) > 0, dominant).alias("dominant_range"),
        variety_score(counts).alias("variety"), (longest_near_run(lengths) >= 5).alias("has_monotony"))


def variety_score(counts: Column) -> Column:
    """Entropy of bucket counts over its most, in percent; one bucket or none scores 0."""
    full = F.filter(counts, lambda c: c > 0)
    total = F.aggregate(full, F.lit(0.0), lambda a, c: a + c)
    entropy = F.aggregate(full, F.lit(0.0), lambda a, c: a - (c / total) * F.log2(c / total))
    return F.when(F.size(full) <= 1, F.lit(0.0)).otherwise(100 * entropy / F.log2(F.size(full).cast("double")))


def reading_grade(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Flesch-Kincaid grade."""
    return 0.39 * n_words / n_sentences + 11.8 * n_syllables / n_words - 15.59


def reading_level(grade: Column) -> Column:
    return (
        F.when(grade < 1, "Kindergarten").when(grade < 6, "1st-5th Grade").when(grade < 9, "6th-8th Grade")
        .when(grade < 13, "9th-12th Grade").when(grade < 17, "College Level").when(grade.isNotNull(), "Graduate Level").otherwise("N/A")
    )


#: Words that keyword density leaves out.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could "
    "should may might must shall can need dare ought used it its this that these those i you he she we they me him her us them my your "
    "his our their mine yours hers ours theirs what which who whom whose where when why how all each every both few more most other some "
    "such no nor not only own same so than too very just also now here there then once if into through during before after above below up "
    "down out off over under again further any about"
).split()


def keyword(word: Column) -> Column:
    """The word as a keyword, or null: lower-case letters, apostrophes and hyphens, four at least, no stop word."""
    bare = F.regexp_replace(F.lower(word), r"[^a-z'-]", "")
    return F.when((F.length(bare) >= 4) & ~bare.isin(STOP_WORDS), bare)


def minutes(n_words: Column, per_minute: int) -> Column:
    """Reading (225 a minute) or speaking (150) time."""
    return F.ceil(n_words / per_minute)


def snippet(text: Column, needle: str, around: int = 60, mark: tuple[str, str] = ("<b>", "</b>")) -> Column:
    """The first place of ``needle`` (case-insensitive) with ``around`` characters on each side; else the head of the text."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    hit = F.substring(text, at, F.lit(len(needle)))
    before, after = F.substring(text, start, at - start), F.substring(text, at + len(needle), F.lit(around))
    lead, tail = F.when(start > 1, "...").otherwise(""), F.when(at + len(needle) + around <= F.length(text), "...").otherwise("")
    return F.when(at > 0, F.concat(lead, before, F.lit(mark[0]), hit, F.lit(mark[1]), after, tail)).otherwise(F.substring(text, F.lit(1), F.lit(2 * around)))
