"""License notices found by diagonal voting.

Hashes of all rolling word k-grams of the texts are joined with the k-gram
positions of a small template table.  A match of a text position with a
template position votes for their difference, the diagonal.  Diagonals with too
few votes are chance and go; neighbouring ones of a template are merged, so a
word more or less does not split a notice, and the merged span is verified
against the template.  Only DataFrame functions run.

Texts are told apart by doc_id and a 64-bit hash, and grams by their hash: the
join moves longs, never words.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases whose every exact place counts, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Opening words of public licence notices, and labels of this scan's own.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution": "creative-commons",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Words of a gram.  The shortest base phrase has two.
GRAM = 2
#: Votes a diagonal needs: distinct positions of the template met on it.
MIN_VOTES = 2
#: Diagonals this near count as one notice.
MERGE_GAP = 2
#: Share of a template's grams that a merged span must hold.
MIN_COVER = 0.7
#: Words are runs of letters, digits and all that is not ASCII.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; an empty array for null.

    ``lower`` is the quick form: it differs from lower-casing A-Z only outside
    ASCII, but for the Kelvin sign, whose lower case is an ASCII letter and
    which is put out of reach first.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00a4")))
    return F.array_remove(F.split(plain, _SEPARATORS), "")  # only the first and last part can be empty


def _templates(base: dict[str, str], own: dict[str, str]) -> list[tuple[list[str], str, bool]]:
    return [(p.split(), x, True) for p, x in base.items()] + [(p.split(), x, False) for p, x in own.items()]


def _inline(spark, rows: list[dict], schema: str) -> DataFrame:
    """A bounded driver-side table as a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def template_grams(spark, base: dict[str, str], own: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(hash, template, tpos), a row per template position, and (template, grams, label, is_base), a row per template."""
    places, kinds = [], []
    for number, (words, label, is_base) in enumerate(_templates(base, own)):
        grams = len(words) - GRAM + 1
        if not 0 < grams <= 62:
            raise ValueError(f"a template needs {GRAM} to {GRAM + 61} words: {' '.join(words)!r}")
        places += [{"a": words[i], "b": words[i + 1], "template": number, "tpos": i} for i in range(grams)]
        kinds.append({"template": number, "grams": grams, "label": label, "is_base": is_base})
    hashed = _inline(spark, places, "a string, b string, template int, tpos int").select(F.xxhash64("a", "b").alias("hash"), "template", "tpos")
    return hashed, _inline(spark, kinds, "template int, grams int, label string, is_base boolean")


def diagonals(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """doc_id, text_hash, template, diagonal, low, high, seen, n_words, copies.

    A row per diagonal met, with its bits of template positions; and one per
    distinct (doc_id, text_hash) whose template is null, with the number of
    rows equal in both.
    """
    words = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words_of(F.col("text")).alias("words"))
    following = F.slice("words", 2, 1 << 30)
    grams = F.zip_with("words", following, lambda a, b: F.xxhash64(a, b))  # the last word has no follower: no gram's hash
    # A null before the grams stands for the row itself: it meets no template, and is kept.
    marked = F.concat(F.array(F.lit(None).cast("long")), grams)
    rows = words.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.posexplode(marked).alias("pos", "gram"))
    met = rows.join(F.broadcast(hashed), F.col("gram") == F.col("hash"), "left").where("template is not null or pos = 0")
    return (
        met.withColumn("pos", F.col("pos") - 1)
        .groupBy("doc_id", "text_hash", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("seen"), F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    )


def _merged(met: DataFrame, kinds: DataFrame) -> DataFrame:
    """The diagonals voted for, neighbours merged, with ``label``, ``is_base``, ``cover`` and whether they are ``verified``; the rows of texts stay as they are."""
    known = met.join(F.broadcast(kinds), "template", "left")
    enough = F.when(F.col("is_base"), F.col("grams")).otherwise(F.least(F.lit(MIN_VOTES), F.col("grams")))
    voted = known.where(F.col("template").isNull() | (F.bit_count("seen") >= enough))
    # Base phrases keep their own diagonal: each exact place counts by itself.
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    before = F.lag("diagonal").over(order)
    fresh = F.when(F.col("is_base") | before.isNull() | (F.col("diagonal") - before > MERGE_GAP), 1).otherwise(0)
    cover = F.bit_count("seen") / F.col("grams")
    needed = F.when(F.col("is_base"), F.lit(1.0)).otherwise(F.lit(MIN_COVER))
    return (
        voted.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
        .groupBy("doc_id", "text_hash", "template", "run", "label", "is_base", "grams")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("seen").alias("seen"), F.max("n_words").alias("n_words"), F.max("copies").alias("copies"))
        .withColumn("cover", cover)
        .withColumn("verified", F.coalesce((F.col("cover") >= needed) & (F.col("high") - F.col("low") + 1 <= F.col("grams") + MERGE_GAP * 2), F.lit(False)))
    )


def _scan(docs: DataFrame, base: dict[str, str] | None, own: dict[str, str] | None) -> DataFrame:
    hashed, kinds = template_grams(docs.sparkSession, BASE_PHRASES if base is None else base, TEMPLATES if own is None else own)
    return _merged(diagonals(docs, hashed), kinds)


def scan_spans(docs: DataFrame, base: dict[str, str] | None = None, own: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text_hash, label, is_base, start, words, cover: the verified spans of every distinct text, start in words from 0."""
    return _scan(docs, base, own).where("verified").select(
        "doc_id", "text_hash", "label", "is_base", F.col("low").cast("long").alias("start"), (F.col("high") - F.col("low") + GRAM).cast("long").alias("words"), "cover")


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, own: dict[str, str] | None = None) -> DataFrame:
    """License labels of every row's text.

    Returns doc_id, n_words, n_base (exact places of base phrases), first_word
    and last_word (their least and greatest start, else null), base_labels,
    labels (distinct, sorted, comma-joined; '' if none) and score, the best
    cover of a verified span (0 if none).  Null and empty texts have no words.
    Repeated rows give repeated rows; null doc_ids stay null.  Other columns
    are ignored.  An empty table gives none.
    """
    found = _scan(docs, base, own)
    good = lambda column: F.when(F.col("verified"), F.col(column))
    exact = lambda column: F.when(F.col("verified") & F.col("is_base"), F.col(column))
    names = lambda column: F.array_join(F.array_sort(F.collect_set(column)), ",")
    per_text = found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(exact("low")).alias("n_base"),
        F.min(exact("low")).cast("long").alias("first_word"),
        F.max(exact("low")).cast("long").alias("last_word"),
        names(exact("label")).alias("base_labels"),
        names(good("label")).alias("labels"),
        F.coalesce(F.max(good("cover")), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
    )
    again = per_text.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
