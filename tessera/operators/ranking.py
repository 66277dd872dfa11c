"""Lexical search over a postings table.

The postings are a plain DataFrame, so an index is built, updated and pruned
with DataFrame operations, and a search is a semi join, two aggregations and a
top-k.  Only rows of the query's terms leave the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ranking as R
from tessera.functions.text import tokenize
from tessera.operators.traversal import _cut


def build_postings(docs: DataFrame, key: str, fields: dict[str, Column], segments: int = 16, tokenizer=tokenize, doc_length: bool = False) -> DataFrame:
    """(key, field, term, tf, field_length, mask): a row per document, field and term; with ``doc_length`` the document's tokens too.

    With ``doc_length``, for an index that is written whole, the texts are dealt by key and their postings counted where
    they are, since postings are several times as large as the texts.
    """
    if doc_length:
        found = docs.repartition(key).select(key, F.array(*map(tokenizer, fields.values())).alias("ts"))
        whole = F.aggregate("ts", F.lit(0).cast("long"), lambda a, x: a + F.size(x)).alias("doc_length")
        named = F.arrays_zip(F.array(*map(F.lit, fields)).alias("field"), F.col("ts").alias("tokens"))
        arms = found.select(key, whole, F.explode(named).alias("f")).select(key, "doc_length", F.col("f.field").alias("field"), F.col("f.tokens").alias("tokens"))
    else:
        arms = None
        for name, text in fields.items():
            arm = docs.select(F.col(key), F.lit(name).alias("field"), tokenizer(text).alias("tokens"))
            arms = arm if arms is None else arms.unionByName(arm)
    more = ["doc_length"] if doc_length else []
    rows = arms.select(key, "field", F.size("tokens").alias("field_length"), *more, F.posexplode("tokens").alias("pos", "term"))
    return rows.groupBy(key, "field", "term", "field_length", *more).agg(
        F.count("*").alias("tf"), F.bit_or(R.segment_bit(F.col("pos"), F.col("field_length"), segments)).alias("mask"))


def term_postings(docs: DataFrame, key: str, fields: dict[str, Column], terms: list[str], segments: int = 16, tokenizer=tokenize) -> tuple[DataFrame, DataFrame]:
    """(postings of ``terms`` alone, field lengths of all documents): what a search of texts without an index reads.

    One pass over the texts; the lengths and the places of the terms are
    written, and all that a search works out comes from there.
    """
    arms = F.array(*[F.struct(F.lit(n).alias("field"), tokenizer(c).alias("tokens")) for n, c in fields.items()])
    places = F.filter(F.transform("f.tokens", lambda w, i: F.struct(i.alias("pos"), w.alias("term"))), lambda x: x["term"].isin(terms))
    rows = docs.select(key, F.explode(arms).alias("f")).select(key, "f.field", F.size("f.tokens").alias("field_length"), places.alias("hits"))
    held = _cut(rows.where("field_length > 0"))
    postings = held.select(key, "field", "field_length", F.inline("hits")).groupBy(key, "field", "term", "field_length").agg(
        F.count("*").alias("tf"), F.bit_or(R.segment_bit(F.col("pos"), F.col("field_length"), segments)).alias("mask"))
    return postings, held.select(key, "field", "field_length")


def field_lengths(docs: DataFrame, key: str, fields: dict[str, Column], tokenizer=tokenize) -> DataFrame:
    """(key, field, field_length) of fields with a token, without exploding them: what a search needs of the whole corpus."""
    sizes = F.array(*[F.struct(F.lit(n).alias("field"), F.size(tokenizer(c)).alias("field_length")) for n, c in fields.items()])
    return docs.select(key, F.explode(sizes).alias("s")).select(key, "s.*").where("field_length > 0")


def update_postings(postings: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Documents in ``changed`` replace their old postings."""
    return remove_documents(postings, changed.select(key), key).unionByName(changed)


def remove_documents(postings: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return postings.join(ids.select(key).distinct(), key, "left_anti")


def term_stats(postings: DataFrame, key: str) -> DataFrame:
    """(term, df, entropy): document frequency, and the entropy of the term's counts."""
    return stats_of_counts(postings.groupBy("term", key).agg(F.sum("tf").alias("tf")))


def stats_of_counts(per_doc: DataFrame) -> DataFrame:
    """(term, df, entropy) of the counts (term, tf) of each document and term."""
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum(R.entropy_part(F.col("tf"))).alias("entropy"))


def prune_stats(stats: DataFrame, least_df: int) -> DataFrame:
    return stats.where(F.col("df") >= least_df)


def corpus_stats(lengths: DataFrame, key: str) -> DataFrame:
    """One row: total documents and average length, and averages by field as a map."""
    total = lengths.agg(F.countDistinct(key).alias("total"))
    fields = lengths.groupBy("field").agg(F.sum("field_length").alias("s"))
    averages = fields.crossJoin(F.broadcast(total)).agg(
        F.first("total").alias("total"), (F.sum("s") / F.first("total")).alias("average"),
        F.map_from_entries(F.collect_list(F.struct("field", F.col("s") / F.col("total")))).alias("averages"))
    return averages


def _query_frame(postings: DataFrame, terms: list[str], weights: list[float] | None = None) -> DataFrame:
    spark = postings.sparkSession
    weights = weights or [1.0] * len(terms)
    return spark.range(1).select(F.posexplode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(float(w)).alias("boost")) for t, w in zip(terms, weights, strict=True)])).alias("ord", "q")).select("ord", "q.*")


def score(postings: DataFrame, terms: list[str], key: str = "doc_id", *, strategy: str = "global", entropy: bool = False, similarity: bool = False, phrase: bool = True, boosts: list[float] | None = None, options: dict | None = None, lengths: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """Every document with a query term, its score and how it came about.

    strategy: 'global', 'idf', 'per_term', 'pairwise' or 'none' proximity.  A
    query of one term takes the short formula: no proximity, no phrase; with
    entropy on, the term's entropy counts as 1.  ``lengths`` are the corpus's
    field lengths, read from the postings if not given.
    """
    o = R.DEFAULTS | (options or {})
    seg, single = o["segments"], len(terms) == 1
    query = F.broadcast(_query_frame(postings, terms, boosts))
    hits = postings.where(F.col("term").isin(terms)).join(query, "term")  # the filter goes below the postings' aggregation
    stored = ["doc_length"] if corpus is not None and "doc_length" in postings.columns else []
    if not stored:
        lengths = postings.select(key, "field", "field_length").distinct() if lengths is None else lengths
    corpus = F.broadcast(corpus_stats(lengths, key) if corpus is None else corpus)
    per_doc_df = hits.groupBy("term", key).agg(F.sum("tf").alias("tf"))
    stats = per_doc_df.groupBy("term").agg(F.count("*").alias("df"), F.sum(R.entropy_part(F.col("tf"))).alias("raw_entropy"))
    stats = stats.withColumn("norm_entropy", F.lit(1.0) if single else F.col("raw_entropy") / F.greatest(F.max("raw_entropy").over(Window.partitionBy()), F.lit(1e-9)))
    base = hits.join(F.broadcast(stats), "term").crossJoin(corpus)
    weight = F.lit(0.0)
    for name, w in o["weights"].items():
        weight = F.when(F.col("field") == name, F.lit(float(w))).otherwise(weight)
    gamma = F.lit(o["gamma"]) * F.col("norm_entropy") if entropy else F.lit(0.0)
    ntf = R.normalized_tf(F.col("tf"), F.col("field_length"), F.col("averages")[F.col("field")], o["b"], gamma)
    per_term = base.groupBy(key, "ord", "term", "boost", "df", "norm_entropy", "total", "average", *stored).agg(
        F.sum(weight * ntf).alias("s"), F.bit_or("mask").alias("mask"), F.sum("field_length").alias("length"))
    per_term = per_term.withColumn("idf", R.idf(F.col("total"), F.col("df"))).withColumn("part", F.col("boost") * F.col("idf") * R.saturate(F.col("s"), o["k1"]))
    ordered = F.sort_array(F.collect_list(F.struct("ord", "term", "mask", "idf", "part")))
    per_doc = per_term.groupBy(key, "total", "average", *stored).agg(
        F.sum("part").alias("base"), F.bit_and("mask").alias("common"), F.count("*").alias("matched"), F.avg("idf").alias("avg_idf"),
        F.sum("norm_entropy").alias("sum_entropy"), ordered.alias("terms"))
    if not stored:
        per_doc = per_doc.join(lengths.groupBy(key).agg(F.sum("field_length").alias("doc_length")), key)
    masks = F.transform("terms", lambda t: t["mask"])
    prox = R.proximity(F.col("common"), F.col("matched"), F.col("doc_length"), F.col("average"), o["alpha"], o["lambda"], seg)
    total = F.col("base")
    if single or strategy == "none":
        multiplier = F.lit(1.0)
    elif strategy == "idf":
        multiplier = F.when(F.col("matched") < 2, 1.0).otherwise(1 + (prox - 1) * (1 + F.col("avg_idf") / o["idf_scale"]))
    elif strategy == "pairwise":
        multiplier = 1 + R.pairwise_bonus(masks, o["alpha"], seg)
    elif strategy == "per_term":
        overlaps = R.earlier_overlap(masks, seg)
        total = F.aggregate(F.zip_with("terms", overlaps, lambda t, v: t["part"] * (1 + o["alpha"] * v)), F.lit(0.0), lambda a, x: a + x)
        multiplier = F.lit(1.0)
    else:
        multiplier = prox
    boost = F.when((F.col("matched") == len(terms)) & R.is_phrase(masks), o["phrase_boost"]).otherwise(1.0) if phrase and not single else F.lit(1.0)
    coverage = F.col("matched") / len(terms)
    extra = R.similarity_beta(F.col("total")) * coverage * (F.col("sum_entropy") if entropy else F.lit(1.0)) if similarity else F.lit(0.0)
    return per_doc.select(key, F.col("base"), multiplier.alias("proximity"), boost.alias("phrase"), coverage.alias("coverage"), extra.alias("similarity_part"), "terms", (total * multiplier * boost + extra).alias("score"))


def search(postings: DataFrame, terms: list[str], limit: int = 10, key: str = "doc_id", **how) -> DataFrame:
    """The ``limit`` best documents with a positive score, ties by key."""
    found = score(postings, terms, key, **how).where(F.col("score") > 0)
    return found.orderBy(F.desc(F.round("score", 9)), key).limit(limit)


def search_normalized(postings: DataFrame, terms: list[str], limit: int = 10, key: str = "doc_id", **how) -> DataFrame:
    top = search(postings, terms, limit, key, **how)
    return top.withColumn("normalized", R.normalize_score(F.col("score"), F.max("score").over(Window.partitionBy())))


def match_boolean(postings: DataFrame, key: str, must: list[str] = (), should: list[str] = (), must_not: list[str] = (), prefixes: list[str] = ()) -> DataFrame:
    """Keys that hold all of ``must``, some of ``should`` or a prefix (if given), none of ``must_not``."""
    wanted = [*must, *should, *must_not]
    test = F.col("term").isin(wanted) if wanted else F.lit(False)
    for p in prefixes:
        test = test | F.startswith(F.col("term"), F.lit(p))
    has = lambda terms: F.collect_set(F.when(F.col("term").isin(list(terms)), F.col("term"))) if terms else F.array()
    some = F.max(F.col("term").isin(list(should)) if should else F.lit(False))
    for p in prefixes:
        some = some | F.max(F.startswith(F.col("term"), F.lit(p)))
    grouped = postings.where(test).groupBy(key).agg(
        F.size(has(must)).alias("m"), F.size(has(must_not)).alias("n"), some.alias("some"))
    return grouped.where((F.col("m") == len(set(must))) & (F.col("n") == 0) & (F.col("some") if should or prefixes else F.lit(True))).select(key)


def parse_match(query: str) -> tuple[tuple, list[tuple[tuple[str, ...], bool]]]:
    """(tree, phrases) of a match query: words, "phrases", prefix*, AND, OR, NOT and brackets.

    NOT binds tighter than AND, AND than OR; items side by side stand in an AND
    that binds tightest.  A leaf of the tree is the number of a phrase (words, whether the last is a prefix).
    """
    tokens = [m[0] for m in re.finditer(r'"[^"]*"\s*\*?|[()]|[^\s()"]+', query)]
    phrases: list[tuple[tuple[str, ...], bool]] = []
    at = 0

    def leaf(token: str):
        words = tuple(w for w in re.split(r"[^\w]|_", token.lower()) if w)
        if not words:
            raise ValueError(f"no word in {token!r}")
        phrases.append((words, token.endswith("*")))
        return ("phrase", len(phrases) - 1)

    def item():
        nonlocal at
        if at >= len(tokens) or tokens[at] in ("AND", "OR", "NOT", ")"):
            raise ValueError(f"a word or phrase is missing in {query!r}")
        token = tokens[at]
        at += 1
        if token != "(":
            return leaf(token)
        tree = either()
        if at >= len(tokens):
            raise ValueError(f"a bracket is open in {query!r}")
        at += 1
        return tree

    def beside():
        tree = item()
        while at < len(tokens) and tokens[at] not in ("AND", "OR", "NOT", ")"):
            tree = ("and", tree, item())
        return tree

    def level(word: str, kind: str, below):
        def parse():
            nonlocal at
            tree = below()
            while at < len(tokens) and tokens[at] == word:
                at += 1
                tree = (kind, tree, below())
            return tree

        return parse

    either = level("OR", "or", level("AND", "and", level("NOT", "not", beside)))
    tree = either()
    if at < len(tokens):
        raise ValueError(f"a bracket too many in {query!r}")
    return tree, phrases


def match_ranked(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", limit: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, rank): rows whose text meets a match query (see parse_match), by BM25 over its phrases; the best has the least rank.

    Two scans of the texts and no shuffle of them: one counts the corpus and the
    phrases' documents in a single row, the other scores the rows that match.
    Null texts match nothing and count as empty.
    """
    tree, phrases = parse_match(query)
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def places(phrase: tuple[tuple[str, ...], bool]) -> Column:
        want, prefix = phrase

        def stands(w: Column, i: Column) -> Column:
            ok = F.startswith(w, F.lit(want[-1])) if prefix and len(want) == 1 else w == want[0]
            for n in range(1, len(want)):
                there = F.get(F.col("_w"), i + n)
                ok = ok & F.coalesce(F.startswith(there, F.lit(want[n])) if prefix and n == len(want) - 1 else there == want[n], F.lit(False))
            return ok

        return F.size(F.filter("_w", stands))

    rows = docs.select(key, words.alias("_w")).select(key, F.size("_w").alias("_n"), F.array(*map(places, phrases)).alias("_f"))
    held = [F.sum((F.col("_f")[i] > 0).cast("long")).alias(f"_h{i}") for i in range(len(phrases))]
    corpus = rows.agg(F.count("*").alias("_total"), F.avg("_n").alias("_average"), *held)

    def meets(node: tuple) -> Column:
        if node[0] == "phrase":
            return F.col("_f")[node[1]] > 0
        left, right = meets(node[1]), meets(node[2])
        return left & right if node[0] == "and" else left | right if node[0] == "or" else left & ~right

    score = F.lit(0.0)
    for i in range(len(phrases)):
        f, h = F.col("_f")[i], F.col(f"_h{i}")
        idf = F.log((F.col("_total") - h + 0.5) / (h + 0.5))
        score = score + F.when(idf > 0, idf).otherwise(1e-6) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / F.col("_average")))
    found = rows.where(meets(tree)).crossJoin(F.broadcast(corpus)).select(key, (-score).alias("rank"))
    return found if limit is None else found.orderBy(F.round("rank", 9), key).limit(limit)


def accumulate(postings: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """Term-at-a-time partial scores (key, term, part), so that new postings can be added by a sum."""
    return score(postings, terms, key, strategy="none", phrase=False).select(key, F.explode("terms").alias("t")).select(key, "t.term", "t.part")
