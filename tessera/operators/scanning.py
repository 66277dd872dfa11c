"""Scanners over documents: one pass, Arrow batches, rows out.

A dictionary is broadcast up to a bounded number of entities.  A larger one is
dealt into shards of that size; each shard's automaton finds all its names, and
the hits of a document are then resolved together, so that results are those of
one automaton over all names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scan as S
from tessera.operators.traversal import _cut, small

#: Entities up to which a dictionary is broadcast (some 100 bytes each with its automaton).
BROADCAST_ENTITIES = 500_000


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}


#: Texts that a worker turns into Python strings at once, and rows after which it gives out what it has.
SLICE_TEXTS, SLICE_ROWS = 32, 4096


def _rows(docs: DataFrame, fn: Callable[[str], list[dict]], fields: dict[str, str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of fn(text) beside the document's id.  A worker holds the rows of a few texts, not those of a whole Arrow batch."""

    def run(batches):
        for batch in batches:
            place, columns = [], {n: [] for n in fields}
            for at in range(0, batch.num_rows, SLICE_TEXTS):
                for i, body in enumerate(batch.column(1).slice(at, SLICE_TEXTS).to_pylist(), at):
                    for r in fn(body or ""):
                        place.append(i)
                        for n, column in columns.items():
                            value = r.get(n)
                            column.append(list(value.items()) if type(value) is dict else value)
                if len(place) >= SLICE_ROWS or at + SLICE_TEXTS >= batch.num_rows:
                    ids = batch.column(0).take(pa.array(place, pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, _KINDS[fields[n]]) for n, v in columns.items())], [doc, *fields])
                    place, columns = [], {n: [] for n in fields}

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, text).mapInArrow(run, f"{doc} {kind}, " + ", ".join(f"{n} {k}" for n, k in fields.items()))


_SPAN = {"start": "int", "end": "int", "kind": "string", "label": "string", "captures": "map<string,string>"}


def scan_syntax(docs: DataFrame, table: str = "unified") -> DataFrame:
    """(doc_id, start, end, kind, label, captures)."""
    return _rows(docs, lambda t: S.scan_syntax(t, table), _SPAN)


def scan_triples(docs: DataFrame) -> DataFrame:
    return _rows(docs, S.scan_triples, {"start": "int", "end": "int", "subject": "string", "predicate": "string", "object": "string"})


_MENTION = {"start": "int", "end": "int", "entity_id": "string", "kind": "string", "confidence": "double"}
_BUILT: dict[tuple, S.Dictionary] = {}


def _shards(entities: DataFrame) -> list:
    """The dictionary as broadcasts of at most BROADCAST_ENTITIES rows or so each: one, if it is small."""
    rows = entities.select("id", "label", "kind", "aliases")
    sc = entities.sparkSession.sparkContext
    first = rows.limit(BROADCAST_ENTITIES + 1).collect()  # worked out once: a dictionary may be a count over all texts
    if len(first) <= BROADCAST_ENTITIES:
        return [sc.broadcast([tuple(r) for r in first])]
    del first
    count = -(-2 * rows.count() // BROADCAST_ENTITIES)  # twice as many, for hashes deal unevenly
    part = lambda k: rows.where(F.pmod(F.xxhash64("id"), F.lit(count)) == k)
    return [sc.broadcast([tuple(r) for r in part(k).collect()]) for k in range(count)]


def _finder(held, every: bool = False, **how) -> Callable[[str], list[dict]]:
    key = (held.id if hasattr(held, "id") else id(held), tuple(sorted(how.items())))

    def find(text: str) -> list[dict]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = S.Dictionary(held.value, **how)
        found = _BUILT[key].find_all(text) if every else _BUILT[key].find(text)
        return [h | {"entity_id": str(h["entity_id"])} for h in found]

    return find


def find_mentions(docs: DataFrame, entities: DataFrame, *, alias: float = 0.95, generated: bool = True) -> DataFrame:
    """(doc_id, start, end, entity_id, kind, confidence): labels, aliases and generated aliases in the texts."""
    shards = _shards(entities)
    if len(shards) == 1:
        return _rows(docs, _finder(shards[0], alias=alias, generated=generated), _MENTION)
    every = None
    for held in shards:
        hits = _rows(docs, _finder(held, True, alias=alias, generated=generated), _MENTION)
        every = hits if every is None else every.unionByName(hits)
    spans = F.collect_list(F.struct("start", (-F.col("end")).alias("last"), (-F.col("confidence")).alias("low"), "entity_id", "kind"))
    kept = _resolved(every.groupBy("doc_id").agg(F.array_sort(spans).alias("spans")))
    return kept.select("doc_id", F.inline("spans")).select("doc_id", "start", (-F.col("last")).alias("end"), "entity_id", "kind", (-F.col("low")).alias("confidence"))


def _resolved(grouped: DataFrame) -> DataFrame:
    """Spans sorted by start, longest and best first: each that begins at or after the end of the last kept one."""
    kind = grouped.schema["spans"].dataType.simpleString()
    zero = f"named_struct('last', 0, 'kept', CAST(array() AS {kind}))"
    step = "(a, x) -> IF(x.start >= a.last, named_struct('last', -x.last, 'kept', concat(a.kept, array(x))), a)"
    return grouped.withColumn("spans", F.expr(f"aggregate(spans, {zero}, {step}).kept"))


def find_exact(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Labels at 1.0 and aliases at .9 only."""
    return find_mentions(docs, entities, alias=0.9, generated=False)


def find_mentions_by_join(docs: DataFrame, entities: DataFrame, most_words: int = 4) -> DataFrame:
    """Whole-word mentions by joining word n-grams with names: any number of entities.  Only n-grams of as many words as
    some name has are made, and they are not moved where the names can be broadcast."""
    names = entities.select("id", "kind", F.explode(F.concat(F.array(F.struct(F.col("label").alias("n"), F.lit(1.0).alias("c"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("n"), F.lit(0.95).alias("c"))))).alias("x"))
    names = names.select(F.lower("x.n").alias("gram"), F.col("id").cast("string").alias("entity_id"), "kind", F.col("x.c").alias("confidence"))
    names = small(names)
    sizes = sorted(r[0] for r in names.select(F.size(F.split("gram", " ")).alias("n")).where(F.col("n").between(1, most_words)).distinct().collect())
    words = docs.select("doc_id", F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}'-]+"), lambda w: w != "").alias("w"))

    def grams(n: int):
        if n == 1:
            return words.select("doc_id", F.posexplode("w").alias("start", "gram")).select("doc_id", F.struct("start", (F.col("start") + 1).alias("end"), "gram").alias("g"))
        places = F.sequence(F.lit(1), F.size("w") - n + 1)
        return words.where(F.size("w") >= n).select("doc_id", F.explode(F.transform(places, lambda i: F.struct((i - 1).cast("int").alias("start"), (i + n - 1).cast("int").alias("end"), F.array_join(F.slice("w", i, n), " ").alias("gram")))).alias("g"))

    every = None
    for n in sizes or [1]:
        every = grams(n) if every is None else every.unionByName(grams(n))
    return every.select("doc_id", "g.*").join(names, "gram").select("doc_id", "start", "end", "entity_id", "kind", "confidence")


def scan_temporal(docs: DataFrame, custom: list[str] = ()) -> DataFrame:
    """(doc_id, kind, text, start, end, confidence, metadata)."""
    scanner = S.TemporalScanner(custom)
    return _rows(docs, scanner.scan, {"kind": "string", "text": "string", "start": "int", "end": "int", "confidence": "double", "metadata": "map<string,string>"})


def _with_entities(docs: DataFrame, entities: DataFrame, fn, fields: dict[str, str]) -> DataFrame:
    shards = _shards(entities)
    if len(shards) == 1:
        find = _finder(shards[0], alias=0.95, generated=True)
        return _rows(docs, lambda t: fn(t, find(t)), fields)
    spans = find_mentions(docs, entities).groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("start", "end", "entity_id", "kind", "confidence")))).alias("spans"))
    both = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    return _rows(both.select("doc_id", F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), "spans")).alias("text")), lambda row: _apply(fn, row), fields)


def _apply(fn, row: str) -> list[dict]:
    row = json.loads(row or '{"text": ""}')
    return fn(row["text"], json.loads(row.get("spans") or "[]"))


def phrase_table(docs: DataFrame, patterns=None) -> DataFrame:
    """(doc_id, relation, start, end): every phrase of a relation in the texts, longest first at a place."""
    scanner = S.RelationScanner(patterns=patterns)
    return _rows(docs, scanner.phrases, {"relation": "string", "start": "int", "end": "int"})


def extract_relations(docs: DataFrame, entities: DataFrame, reach: int = 200, types: dict | None = None) -> DataFrame:
    """(doc_id, subject, relation, object, confidence, start, end)."""
    scanner = S.RelationScanner(reach, types=types)
    return _with_entities(docs, entities, scanner.extract, {"subject": "string", "relation": "string", "object": "string", "confidence": "double", "start": "int", "end": "int"})


def relations_as_of(phrases: DataFrame, mentions: DataFrame, reach: int = 200) -> DataFrame:
    """The same nearest-left, nearest-right choice as a relational as-of join: phrases (doc_id, relation, start, end), mentions (doc_id, entity_id, start, end)."""
    from tessera.operators.temporal import as_of_join

    m = mentions.select("doc_id", F.col("entity_id").alias("eid"), F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    p = phrases.select("doc_id", "relation", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    left = as_of_join(p, m, ["doc_id"], "p_start", "m_end", ["eid", "m_end"]).withColumnsRenamed({"eid": "subject", "m_end": "l_end"})
    both = as_of_join(left, m, ["doc_id"], "p_end", "m_start", ["eid", "m_start"], forward=True).withColumnRenamed("eid", "object")
    near = (F.col("p_start") - F.col("l_end") <= reach) & (F.col("m_start") - F.col("p_end") <= reach)
    return both.where(near).select("doc_id", "relation", "subject", "object", "p_start")


def chunks(docs: DataFrame) -> DataFrame:
    return _rows(docs, S.chunk, {"kind": "string", "text": "string", "start": "int", "end": "int", "head": "string"})


def dependencies(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk, head, score): chunk numbers of each sentence's attachments."""
    def run(text):
        return [{"chunk": i, "head": j, "score": s} for i, _, j, s in S.attach_sentences(text) if j is not None]

    return _rows(docs, run, {"chunk": "int", "head": "int", "score": "double"})


def structured_relations(docs: DataFrame, entities: DataFrame) -> DataFrame:
    return _with_entities(docs, entities, S.structured_relations, {"subject": "string", "verb": "string", "object": "string", "passive": "boolean", "flipped": "boolean", "confidence": "double", "start": "int", "end": "int", "modifiers": "map<string,string>"})


def state_changes(docs: DataFrame, entities: DataFrame) -> DataFrame:
    return _with_entities(docs, entities, S.state_changes, {"entity": "string", "state": "string", "trigger": "string", "start": "int"})


def quads(docs: DataFrame, entities: DataFrame) -> DataFrame:
    return _with_entities(docs, entities, S.quads, {"subject": "string", "verb": "string", "object": "string", "location": "string", "time": "string", "manner": "string"})


def facts(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, subject, verb, object): the quads, and the state changes with the verb STATE, in one pass over the texts."""
    def run(text, found):
        states = [{"subject": s["entity"], "verb": "STATE", "object": s["state"]} for s in S.state_changes(text, found)]
        return S.quads(text, found) + states

    return _with_entities(docs, entities, run, {"subject": "string", "verb": "string", "object": "string"})


def svo_relations(docs: DataFrame, entities: DataFrame, rules: list[tuple], token_limit: int = 12) -> DataFrame:
    return _with_entities(docs, entities, lambda t, e: S.svo_pairs(t, e, rules, token_limit), {"subject": "string", "relation": "string", "object": "string", "confidence": "double"})


def prepositional_relations(docs: DataFrame, entities: DataFrame, rules: list[tuple], token_limit: int = 12) -> DataFrame:
    return _with_entities(docs, entities, lambda t, e: S.prepositional_pairs(t, e, rules, token_limit), {"subject": "string", "relation": "string", "object": "string", "confidence": "double"})


def possession_relations(docs: DataFrame, entities: DataFrame, rules: list[tuple] = (), token_limit: int = 12) -> DataFrame:
    return _with_entities(docs, entities, lambda t, e: S.possession_pairs(t, e, rules, token_limit), {"subject": "string", "relation": "string", "object": "string", "confidence": "double"})


def attribute_dialogue(docs: DataFrame, cast: dict) -> DataFrame:
    """(doc_id, quote, start, end, speaker): cast is id -> (names, gender)."""
    return _rows(docs, lambda t: S.attribute_dialogue(t, S.Resolver(cast)), {"quote": "string", "start": "int", "end": "int", "speaker": "string"})


def analyze_narrative(docs: DataFrame, cast: dict) -> DataFrame:
    """(doc_id, chunk, kind, text, head_chunk, entity): chunks, where they attach, and whom they name."""
    def run(text):
        resolver = S.Resolver(cast)
        return [{"chunk": i, "kind": c["kind"], "text": c["text"], "head_chunk": j, "entity": resolver.resolve(c["head"]) if c["kind"] in ("NP", "PP") else None} for i, c, j, _ in S.attach_sentences(text)]

    return _rows(docs, run, {"chunk": "int", "kind": "string", "text": "string", "head_chunk": "int", "entity": "string"})


def sentence_table(docs: DataFrame) -> DataFrame:
    return _rows(docs, lambda t: [{"idx": i, "start": a, "end": b} for i, (a, b) in enumerate(S.sentence_spans(t))], {"idx": "int", "start": "int", "end": "int"})


def paragraph_table(docs: DataFrame) -> DataFrame:
    return _rows(docs, lambda t: [{"idx": i, "start": a, "end": b} for i, (a, b) in enumerate(S.paragraph_spans(t))], {"idx": "int", "start": "int", "end": "int"})


def span_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, sentences, paragraphs), a row for every document: 0 without a span, null for a null text."""
    counted = _rows(docs.where("text is not null"), lambda t: [{"sentences": len(S.sentence_spans(t)), "paragraphs": len(S.paragraph_spans(t))}], {"sentences": "long", "paragraphs": "long"})
    none = F.lit(None).cast("long")
    return counted.unionByName(docs.where("text is null").select("doc_id", none.alias("sentences"), none.alias("paragraphs")))


def concept_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concepts with counts, relations of a sentence): strength min(1, .5 + .1 (n - 1))."""
    def run(text):
        return [{"sentence": i, "concept": c} for i, (a, b) in enumerate(S.sentence_spans(text)) for c in S.concepts(text[a:b])]

    rows = _rows(docs, run, {"sentence": "int", "concept": "string"})
    counts = rows.groupBy("concept").agg(F.count("*").alias("n"))
    once = rows.distinct()
    pairs = once.alias("l").join(once.alias("r"), ["doc_id", "sentence"]).where(F.col("l.concept") < F.col("r.concept")).groupBy(F.col("l.concept").alias("a"), F.col("r.concept").alias("b")).agg(F.count("*").alias("n"))
    return counts, pairs.withColumn("strength", F.least(F.lit(1.0), 0.5 + 0.1 * (F.col("n") - 1)))


# -- link and entity syntax ------------------------------------------------------------

#: Kinds of links and their syntax.
LINKS = {"wikilink": r"\[\[([^\]\|]+)(?:\|[^\]]+)?\]\]", "entity": r"\[[A-Z_]+(?::[A-Z_]+)?\|([^\]\|]+)(?:\|\{[^}]+\})?\]", "mention": r"@([\w\-]+)", "backlink": r"<<([^>\|]+)(?:\|[^>]+)?>>"}


def parse_links(docs: DataFrame, around: int = 40) -> DataFrame:
    """(doc_id, link_type, target, start, context): ``around`` characters on each side of the link, with dots where cut."""
    patterns = [(kind, re.compile(p, re.ASCII)) for kind, p in LINKS.items()]

    def run(text):
        out = []
        for kind, pattern in patterns:
            for m in pattern.finditer(text):
                low, high = max(0, m.start() - around), min(len(text), m.end() + around)
                context = "..." * (low > 0) + text[low:high] + "..." * (high < len(text))
                out.append({"link_type": kind, "target": m[1].strip(), "start": m.start(), "context": context})
        return out

    return _rows(docs, run, {"link_type": "string", "target": "string", "start": "int", "context": "string"})


def backlinks(links: DataFrame) -> DataFrame:
    """(target, doc_id, n, first_type, first_context)."""
    first = F.min(F.struct("link_type", "context"))
    return links.groupBy(F.lower("target").alias("target"), "doc_id").agg(F.count("*").alias("n"), first.alias("f")).select("target", "doc_id", "n", F.col("f.link_type").alias("first_type"), F.col("f.context").alias("first_context"))


def link_relevance(position_kind: Column, context: Column) -> Column:
    """.6 of where it stands (title 1, heading .8, body .5, footnote .3) and .4 of whether the context is over 50 long."""
    place = F.when(position_kind == "title", 1.0).when(position_kind == "heading", 0.8).when(position_kind == "footnote", 0.3).otherwise(0.5)
    return 0.6 * place + 0.4 * F.when(F.length(context) > 50, 0.8).otherwise(0.5)


#: Letters up to which strings meet on what deletions leave of them, by number of edits: at most some 2,500 keys a string.
DELETED_UP_TO = {1: 64, 2: 40, 3: 24}


def _deletions(text: Column, edits: int) -> Column:
    """Hashes of all strings that up to ``edits`` deletions leave."""
    def less(v: Column) -> Column:
        return F.when(F.length(v) > 0, F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(v.substr(F.lit(1), i - 1), v.substr(i + 1, F.length(v))))).otherwise(F.array().cast("array<string>"))

    level = every = F.array(text)
    for _ in range(edits):
        level = F.array_distinct(F.flatten(F.transform(level, less)))
        every = F.concat(every, level)
    return F.transform(every, lambda v: F.xxhash64(v))


def _meeting(names: DataFrame, aliases: DataFrame, edits: int) -> DataFrame:
    """(low, alias, entity_id): at least all pairs of names (low) and aliases (alias, entity_id) within ``edits``."""
    short = DELETED_UP_TO.get(edits, -1)
    k = edits + 1
    begin = lambda size, i: F.floor(size * i / k).cast("int")
    size = F.length("alias")
    parts = F.transform(F.sequence(F.lit(0), F.lit(edits)), lambda i: F.struct(size.alias("size"), i.alias("part"), F.col("alias").substr(begin(size, i) + 1, begin(size, i + 1) - begin(size, i)).alias("text")))
    right = aliases.where(size >= short + 1 - edits).select("entity_id", "alias", F.inline(parts))
    low, length = F.col("low"), F.length("low")
    shifts = F.sequence(F.lit(-edits), F.lit(edits))
    keys = F.transform(F.sequence(F.greatest(length - edits, F.lit(0)), length + edits), lambda n: F.transform(F.sequence(F.lit(0), F.lit(edits)), lambda i: F.transform(shifts, lambda d: F.struct(
        n.cast("int").alias("size"), i.alias("part"), F.when(begin(n, i) + d >= 0, low.substr(begin(n, i) + d + 1, begin(n, i + 1) - begin(n, i))).alias("text")))))
    left = names.where(length > short).select("low", F.explode(F.array_distinct(F.flatten(F.flatten(keys)))).alias("k")).select("low", "k.*").where("text is not null")
    near = left.join(right, ["size", "part", "text"]).select("low", "alias", "entity_id")
    if short < 0:
        return near
    left = names.where(length <= short).select("low", F.explode(_deletions(low, edits)).alias("k"))
    right = aliases.where(size <= short + edits).select("alias", "entity_id", F.explode(_deletions(F.col("alias"), edits)).alias("k"))
    return near.unionByName(left.join(right, "k").select("low", "alias", "entity_id"))


def fuzzy_match(names: DataFrame, entities: DataFrame, most: int = 3) -> DataFrame:
    """(name, entity_id, distance): the nearest entity name or alias within ``most`` edits.

    names (name); entities (id, label, aliases).  First those within one edit
    are looked for; only names without any go on to two, and so on, so that
    names that are like many others do not meet all of them.  Strings within d
    edits have a string in common that d deletions or fewer leave of each.
    Long ones (DELETED_UP_TO) are cut instead: an alias into d + 1 parts, of
    which one stays whole in the name, at most d places off.  So none within
    the distance is missed.
    """
    every = entities.select(F.col("id").alias("entity_id"), F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    right = every.where("alias is not null").groupBy(F.lower("alias").alias("alias")).agg(F.min(F.struct("entity_id"))["entity_id"].alias("entity_id"))
    wanted = names.where("name is not null").select("name", F.lower("name").alias("low")).distinct()
    left, best = wanted.select("low").distinct(), None
    for edits in range(min(most, 1), most + 1):
        d = F.levenshtein(F.col("low"), F.col("alias"), edits)
        found = _cut(_meeting(left, right, edits).withColumn("d", d).where(F.col("d") >= 0).groupBy("low").agg(F.min(F.struct("d", "entity_id")).alias("b")))
        best = found if best is None else best.unionByName(found)
        if edits < most:
            left = _cut(left.join(found, "low", "left_anti"))
            if left.isEmpty():
                break
    return wanted.join(best, "low").select("name", "b.entity_id", F.col("b.d").alias("distance"))


def changed_chunks(old: DataFrame, new: DataFrame, share: float = 0.3, most: int = 10) -> DataFrame:
    """(doc_id, dirty, n, incremental): paragraphs (doc_id, idx, hash) of new texts without an equal in the old, with one
    neighbour on each side; a rescan is incremental under ``share`` and ``most`` dirty ones."""
    fresh = new.join(old.select("doc_id", "hash").distinct(), ["doc_id", "hash"], "left_anti").select("doc_id", F.explode(F.array(F.col("idx") - 1, F.col("idx"), F.col("idx") + 1)).alias("idx")).distinct()
    dirty = fresh.join(new.select("doc_id", "idx"), ["doc_id", "idx"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("dirty"))
    return new.groupBy("doc_id").agg(F.count("*").alias("n")).join(dirty, "doc_id", "left").fillna(0, ["dirty"]).withColumn("incremental", (F.col("dirty") < share * F.col("n")) & (F.col("dirty") < most))
