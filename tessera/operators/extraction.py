"""From notes to a graph: entities in the syntax of notes, mentions, co-occurrence; and which entity a mention means."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scan as S
from tessera.operators import cooccurrence
from tessera.operators import ranking as R
from tessera.operators.scanning import _rows
from tessera.sources.tables import episodes

#: The syntax of entities, links and tags in notes.
ENTITY = re.compile(r"\[([A-Z_]+)(?::([A-Z_]+))?\|([^|\]]+?)(?:\|({[^}]*}))?\]")
WIKILINK = re.compile(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]")
TAG = re.compile(r"#([a-zA-Z0-9_-]+)")
#: Kinds of entities.
KINDS = ("CHARACTER", "FACTION", "LOCATION", "NPC", "ITEM", "SCENE", "EVENT", "CONCEPT", "ARC", "ACT", "CHAPTER", "BEAT", "TIMELINE", "NARRATIVE", "NETWORK")
_FOUND = {"kind": "string", "subtype": "string", "label": "string", "attributes": "string", "start": "int", "context": "string"}


def find_entities(text: str, around: int = 50) -> list[dict]:
    """Entities stated in a text: [KIND:SUBTYPE|Label|{attributes}], links as concepts by their display text, tags as concepts."""
    out = []

    def add(m, kind, subtype, label, attributes=None):
        context = text[max(0, m.start() - around) : m.start() + around]
        out.append({"kind": kind, "subtype": subtype, "label": label.strip(), "attributes": attributes, "start": m.start(), "context": context})

    for m in ENTITY.finditer(text):
        if m[1] in KINDS:
            try:
                attributes = json.dumps(json.loads(m[4].replace("'", '"')), sort_keys=True) if m[4] else None
            except ValueError:
                attributes = None  # not JSON: the entity counts without it
            add(m, m[1], m[2], m[3], attributes)
    for m in WIKILINK.finditer(text):
        add(m, "CONCEPT", None, m[2] or m[1])
    for m in TAG.finditer(text):
        add(m, "CONCEPT", "TAG", m[1])
    return sorted(out, key=lambda e: e["start"])


def extract_entities(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc_id, kind, subtype, label, attributes, start, context)."""
    return _rows(docs, find_entities, _FOUND, doc=doc)


def process_notes(notes: DataFrame, known: DataFrame | None = None, granularity: str = "paragraph", least_weight: int = 1) -> dict[str, DataFrame]:
    """episodes, entities, mentions and edges of notes (doc_id, text), of one note or all.

    Entities are told apart by kind, subtype and name; one of ``known``
    (kind, subtype, name, id) keeps its id, others have one made from the
    three.  The first attributes of several count.  Edges join entities of an
    episode, with PMI.
    """
    parts = episodes(notes, granularity).withColumn("episode_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("idx").cast("string")))
    found = extract_entities(parts.select(F.col("episode_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "episode_id")
    named = found.withColumn("subtype", F.coalesce("subtype", F.lit(""))).withColumn("made", F.concat_ws(":", "kind", "subtype", F.lower("label")))
    if known is not None:
        old = known.select("kind", F.coalesce("subtype", F.lit("")).alias("subtype"), F.lower("name").alias("low"), F.col("id").cast("string").alias("known_id")).dropDuplicates(["kind", "subtype", "low"])
        named = named.withColumn("low", F.lower("label")).join(old, ["kind", "subtype", "low"], "left").withColumn("made", F.coalesce("known_id", "made")).drop("low", "known_id")
    mentions = named.select("episode_id", F.col("made").alias("entity_id"), "start", "context", F.lit(1.0).alias("confidence"))
    entities = named.groupBy(F.col("made").alias("entity_id")).agg(
        F.min("kind").alias("kind"), F.min("subtype").alias("subtype"), F.min("label").alias("name"), F.count("*").alias("frequency"),
        F.min_by("attributes", F.struct("episode_id", "start")).alias("attributes"))
    once = mentions.select("episode_id", "entity_id").distinct()
    edges = cooccurrence.aggregate_pairs(cooccurrence.pairs_in(once, ["episode_id"])).where(F.col("weight") >= least_weight)
    return {"episodes": parts, "entities": entities, "mentions": mentions, "edges": cooccurrence.with_pmi(edges, entities.select("entity_id", "frequency"))}


#: Word classes that stand before and after a mention of each kind.
CONTEXTS = {
    "CHARACTER": (["DET", "PRON"], ["VERB", "AUX"]),
    "FACTION": (["ADP", "DET"], ["NOUN", "VERB", "AUX"]),
    "LOCATION": (["ADP"], ["PUNCT", "CCONJ", "VERB", "AUX"]),
    "NPC": (["DET", "PRON"], ["VERB", "AUX"]),
    "ITEM": (["DET", "ADJ", "PRON"], ["VERB", "AUX", "ADP"]),
    "SCENE": (["ADP", "DET"], ["PUNCT", "VERB", "AUX"]),
    "EVENT": (["ADP", "DET"], ["VERB", "AUX", "ADP"]),
    "CONCEPT": (["ADJ", "DET"], ["VERB", "AUX", "ADJ"]),
    "ARC": (["DET", "ADJ"], ["VERB", "AUX"]),
    "ACT": (["DET", "NUM"], ["PUNCT", "VERB", "AUX"]),
    "CHAPTER": (["DET", "NUM"], ["PUNCT", "VERB", "AUX"]),
    "BEAT": (["DET", "ADJ"], ["VERB", "AUX"]),
    "TIMELINE": (["ADP", "DET"], ["NOUN", "VERB", "AUX"]),
    "NARRATIVE": (["ADJ", "DET"], ["VERB", "AUX"]),
    "NETWORK": (["ADJ", "DET"], ["VERB", "AUX"]),
}
_CLASSES = {"PREP": "ADP", "CONJ": "CCONJ", "MODAL": "AUX", "REL": "PRON"}


def context_classes(sentence: str, start: int, end: int, around: int = 3) -> tuple[list[str], list[str]]:
    """Word classes of the ``around`` tokens before and after a place."""
    tokens = [(m.start(), m.end(), S.tag(m.group())) for m in re.finditer(r"[^\W_]+(?:['-][^\W_]+)*|[^\w\s]", sentence)]
    name = lambda c: "NUM" if c == "NUM" else _CLASSES.get(c, c)
    return [name(c) for a, b, c in tokens if b <= start][-around:], [name(c) for a, b, c in tokens if a >= end][:around]


def disambiguate(entities: DataFrame, mention: str, sentence: str, start: int, limit: int = 5) -> DataFrame:
    """(entity_id, score, confidence): entities (id, kind, text) ranked for a mention.

    The best ``limit`` by lexical score of the mention's words; where the words
    around the mention fit the entity's kind, the score grows by a fifth and
    the confidence is high, else medium.
    """
    before, after = context_classes(sentence, start, start + len(mention))
    terms = list(dict.fromkeys(re.findall(r"\w{2,}", mention.lower())))
    fits = F.lit(False)
    for kind, (lead, follow) in CONTEXTS.items():
        if set(lead) & set(before) or set(follow) & set(after):
            fits = fits | (F.col("kind") == kind)
    top = R.search(R.build_postings(entities, "id", {"content": F.col("text")}), terms, limit, "id").select("id", "score")
    ranked = top.join(entities.select("id", "kind"), "id")
    return ranked.select(F.col("id").alias("entity_id"), (F.col("score") * F.when(fits, 1.2).otherwise(1.0)).alias("score"), F.when(fits, "high").otherwise("medium").alias("confidence")).orderBy(F.desc(F.round("score", 9)), "entity_id")
