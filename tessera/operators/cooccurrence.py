"""Co-occurrence pairs, edges and their statistics.

Pairs come from a self join on the episode.  A hot episode is the skew here,
so the join key is (episode, bucket of position) where a window bounds the
distance, and adaptive execution splits what stays large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_key(a: Column, b: Column) -> Column:
    """One key for an undirected pair."""
    return F.concat_ws("--", F.least(a.cast("string"), b.cast("string")), F.greatest(a.cast("string"), b.cast("string")))


def pairs_in(mentions: DataFrame, by: list[str], entity: str = "entity_id") -> DataFrame:
    """(by..., a, b) with a < b for every pair of mentions that agree in ``by``."""
    left = mentions.select(*by, F.col(entity).alias("a"))
    right = mentions.select(*by, F.col(entity).alias("b"))
    return left.join(right, by).where(F.col("a") < F.col("b"))


def pairs_in_window(mentions: DataFrame, window: int, episode: str = "episode_id", sentence: str = "sentence_index", entity: str = "entity_id", keep: list[str] = ()) -> DataFrame:
    """(episode, a, b, keep...) of mentions at most window - 1 sentences apart, a < b.

    A band join: the position is cut into buckets of the window's width, the
    left side meets its own bucket and the next ones, so a long episode spreads.
    """
    width = max(window, 1)
    left = mentions.select(F.col(episode), F.col(sentence).alias("s1"), F.col(entity).alias("a"), *keep, F.explode(F.array(*[F.floor(F.col(sentence) / width) + d for d in (-1, 0, 1)])).alias("_bucket"))
    right = mentions.select(F.col(episode), F.col(sentence).alias("s2"), F.col(entity).alias("b"), F.floor(F.col(sentence) / width).alias("_bucket"))
    return left.join(right, [episode, "_bucket"]).where((F.abs(F.col("s1") - F.col("s2")) <= window - 1) & (F.col("a") < F.col("b"))).select(episode, "a", "b", *keep)


def aggregate_pairs(pairs: DataFrame, episode: str = "episode_id", note: str | None = None) -> DataFrame:
    """(a, b, weight, episodes with repeats, distinct notes)."""
    more = [F.sort_array(F.collect_set(note)).alias("note_ids")] if note else []
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"), F.sort_array(F.collect_list(episode)).alias("episode_ids"), *more)


def with_pmi(edges: DataFrame, frequency: DataFrame, entity: str = "entity_id") -> DataFrame:
    """pmi_score = ln((w / T) / ((fa / T) (fb / T))), T the weight of all edges given, f the entities' frequency or 1."""
    total = F.broadcast(edges.agg(F.sum("weight").alias("_total")))
    fa = frequency.select(F.col(entity).alias("a"), F.col("frequency").alias("_fa"))
    fb = frequency.select(F.col(entity).alias("b"), F.col("frequency").alias("_fb"))
    joined = edges.join(fa, "a", "left").join(fb, "b", "left").crossJoin(total)
    t = F.col("_total").cast("double")
    pmi = F.log((F.col("weight") / t) / ((F.coalesce("_fa", F.lit(1)) / t) * (F.coalesce("_fb", F.lit(1)) / t)))
    return joined.withColumn("pmi_score", pmi).drop("_total", "_fa", "_fb")


def build_graph(mentions: DataFrame, frequency: DataFrame, window: int = 1, least_weight: int = 2, pmi: bool = True) -> DataFrame:
    """Windowed pairs, aggregated, weak edges dropped, PMI over what is left."""
    edges = aggregate_pairs(pairs_in_window(mentions, window)).where(F.col("weight") >= least_weight)
    return with_pmi(edges, frequency) if pmi else edges


def word_window(tokens: DataFrame, window: int, weighted: bool = True, doc: str = "doc_id") -> DataFrame:
    """(doc, a, b, weight): entity tokens (doc, pos, term) at most ``window`` words apart, in text order; nearer weighs more."""
    left = tokens.select(doc, F.col("pos").alias("p1"), F.col("term").alias("a"), F.explode(F.array(F.floor(F.col("pos") / window), F.floor(F.col("pos") / window) + 1)).alias("_bucket"))
    right = tokens.select(doc, F.col("pos").alias("p2"), F.col("term").alias("b"), F.floor(F.col("pos") / window).alias("_bucket"))
    near = left.join(right, [doc, "_bucket"]).where((F.col("p2") > F.col("p1")) & (F.col("p2") - F.col("p1") <= window) & (F.col("a") != F.col("b")))
    weight = F.greatest(F.lit(1), F.lit(window) - (F.col("p2") - F.col("p1")) + 1) if weighted else F.lit(1)
    return near.select(doc, "a", "b", weight.cast("long").alias("weight"))


def aggregate_edges(edges: DataFrame, episode: str = "doc_id") -> DataFrame:
    """Weights summed over canonical pairs, with the distinct episodes."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"), F.sort_array(F.collect_set(episode)).alias("episode_ids"))


def mask_cooccurrence(mentions: DataFrame) -> DataFrame:
    """mentions (sentence_id, entity_id, mask, idf): pairs of a sentence whose masks meet, salience mean idf times overlap."""
    l, r = mentions.alias("l"), mentions.alias("r")
    overlap = F.bit_count(F.col("l.mask").bitwiseAND(F.col("r.mask")))
    return l.join(r, F.col("l.sentence_id") == F.col("r.sentence_id")).where((F.col("l.entity_id") < F.col("r.entity_id")) & (overlap > 0)).select(
        F.col("l.sentence_id").alias("sentence_id"), F.col("l.entity_id").alias("a"), F.col("r.entity_id").alias("b"),
        overlap.alias("overlap"), ((F.col("l.idf") + F.col("r.idf")) / 2 * overlap).alias("salience"))


def merge_across_scopes(edges: DataFrame, mapping: DataFrame, strategy: str = "sum") -> DataFrame:
    """Edges (a, b, weight, pmi_score, note_ids) with ids mapped (id, to), made canonical and merged.

    The weight is summed, averaged or the largest, rounded half up; PMI is averaged; id sets are united.
    """
    ma, mb = (mapping.select(F.col("id").alias(c), F.col("to").alias(f"_{c}")) for c in ("a", "b"))
    moved = edges.join(ma, "a", "left").join(mb, "b", "left").withColumns({"a": F.coalesce("_a", "a"), "b": F.coalesce("_b", "b")})
    merge = {"sum": F.sum, "average": F.avg, "max": F.max}[strategy]
    return moved.where(F.col("a") != F.col("b")).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.floor(merge("weight") + 0.5).cast("long").alias("weight"), F.avg("pmi_score").alias("pmi_score"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("note_ids")))).alias("note_ids"))


def increment_weight(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """seen (a, b, episode_id): one more for each, its episode added to the set."""
    more = seen.groupBy("a", "b").agg(F.count("*").alias("_n"), F.collect_set("episode_id").alias("_e"))
    return edges.join(more, ["a", "b"], "full_outer").select("a", "b", (F.coalesce("weight", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("weight"),
        F.sort_array(F.array_union(F.coalesce("episode_ids", F.array()), F.coalesce("_e", F.array()))).alias("episode_ids"))


#: Cause and effect, of any words, around a verb group, and the relation stated.
CAUSAL_PATTERNS = [
    (r"(.+?)\s+(?:caused|led to|triggered|resulted in|sparked|initiated|set off)\s+(.+)", "TRIGGERS"),
    (r"(?:because of|due to|as a result of|following)\s+(.+?)[,.]?\s+(.+)", "TRIGGERS"),
    (r"(.+?)\s+(?:prevented|stopped|blocked|halted|averted|thwarted)\s+(.+)", "PREVENTS"),
    (r"(.+?)\s+(?:enabled|allowed|made possible|facilitated|permitted)\s+(.+)", "ENABLES"),
    (r"(.+?)\s+(?:paved the way for|opened the door to)\s+(.+)", "ENABLES"),
]


def causal_links(docs: DataFrame, events: DataFrame) -> DataFrame:
    """(doc_id, cause, effect, relation): ids of known events (doc_id, event_id, name) in the phrases around a pattern.

    A side names the event whose name it holds or is held by, the least id of
    several; cause and effect are different events of the same document.
    """
    lines = docs.select("doc_id", F.explode(F.split(F.lower("text"), "\n")).alias("line"))
    hits = None
    for pattern, relation in CAUSAL_PATTERNS:
        verb = pattern.replace("(.+?)[,.]?\\s+(.+)", "").replace("(.+?)", "").replace("(.+)", "").removeprefix("\\s+").removesuffix("\\s+")
        # A match takes the rest of its line, so a line has one at most; lines without the verb are not searched.
        found = lines.where(F.col("line").rlike(verb)).select("doc_id", F.struct(F.regexp_extract("line", pattern, 1).alias("cause"), F.regexp_extract("line", pattern, 2).alias("effect")).alias("h"), F.lit(relation).alias("relation"))
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.select("doc_id", "relation", F.trim("h.cause").alias("cause"), F.trim("h.effect").alias("effect")).where("cause <> '' AND effect <> ''").distinct()
    known = events.select("doc_id", "event_id", F.lower("name").alias("name")).where("name <> ''")

    def named(side: str) -> DataFrame:
        inside = F.contains(side, "name") | F.contains("name", side)
        return hits.join(known, "doc_id").where(inside).groupBy("doc_id", "relation", "cause", "effect").agg(F.min("event_id").alias(f"{side}_id"))

    both = named("cause").join(named("effect"), ["doc_id", "relation", "cause", "effect"]).where("cause_id <> effect_id")
    return both.select("doc_id", F.col("cause_id").alias("cause"), F.col("effect_id").alias("effect"), "relation").distinct()


def named_links(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Stored links (source, target, ...) with both ends' names from entities (id, name); links without both ends go."""
    ends = {c: entities.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("source", "target")}
    return links.join(ends["source"], "source").join(ends["target"], "target")


def term_graph(tokens: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of terms by document: pairs of distinct terms with the documents that hold both counted."""
    distinct = tokens.select(doc, "term").distinct()
    edges = pairs_in(distinct, [doc], "term").groupBy("a", "b").agg(F.count("*").alias("weight"))
    return edges.select(F.col("a").alias("term")).union(edges.select("b")).distinct(), edges
