"""Scanners against plain restatements: quadratic loops over whole texts, no bisection, no automaton."""

import random

import pytest

from tessera.functions import scan as S
from tessera.operators import cooccurrence, scanning

WORDS = "the old king ran quickly to big London and saw red Ann who loved Bob in May . she became very happy , he said he knew it ! with by at from cold gave sword's Ann's house".split()


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 60))) for _ in range(150)]


def entities(text):
    return S.Dictionary([("e1", "Ann", "PERSON", []), ("e2", "Bob", "PERSON", []), ("e3", "London", "PLACE", []), ("e4", "sword", "ITEM", []), ("e5", "house", "ITEM", [])]).find(text)


def naive_names(text, names):
    """Leftmost, then longest, at every place."""
    low, out, at = text.lower(), [], 0
    while at < len(text):
        hit = max((n for n in names if low.startswith(n.lower(), at)), key=len, default=None)
        if hit:
            out.append((at, at + len(hit), names[hit]))
        at += len(hit) if hit else 1
    return out


def test_dictionary_is_leftmost_longest(texts):
    names = {"Ann": "a", "Ann who": "b", "who loved Bob": "c", "big London": "d", "London and": "e", "old king": "f"}
    d = S.Dictionary([(k, n, "X", []) for n, k in names.items()], generated=False)
    for t in texts:
        assert [(h["start"], h["end"], h["entity_id"]) for h in d.find(t)] == naive_names(t, names)


def test_attach_takes_the_best_head(texts):
    def naive(chunks):
        root = next((i for i, c in enumerate(chunks) if c["kind"] == "VP"), None)
        for i, c in enumerate(chunks):
            options = []
            for j, h in enumerate(chunks):
                pair, before = (c["kind"], h["kind"]), i < j
                bonus = {("NP", "VP"): 5.0 if before else 4.0, ("PP", "NP"): None if before else 5.0, ("PP", "VP"): 1.0 if before else 5.0, ("ADJP", "NP"): 1.0, ("CLAUSE", "NP"): 1.0, ("VP", "VP"): 1.0}.get(pair)
                if i != j and i != root and bonus is not None:
                    options.append((10 / abs(i - j) + bonus, -j))
            if options:
                yield i, -max(options)[1], max(options)[0]

    for t in texts:
        chunks = S.chunk(t)
        assert S.attach(chunks) == list(naive(chunks))


def test_structured_relations_and_state_changes(texts):
    for t in texts:
        found, chunks = entities(t), S.chunk(t)
        want, states = [], []
        for i, c in enumerate(chunks):
            before, after = [e for e in found if e["end"] <= c["start"]], [e for e in found if e["start"] >= c["end"]]
            if c["kind"] != "VP" or not before:
                continue
            s, o = max(before, key=lambda e: (e["end"], -e["start"])), min(after, key=lambda e: (e["start"], e["end"]), default=None)
            mods = [p for p in chunks[i + 1 :] if p["kind"] == "PP" and p["start"] - c["end"] <= 100]
            aux = any(w.lower() in S.LEXICON["AUX"] for w in c["text"].split()[:-1])
            passive = aux and (any(p["head"].lower() == "by" for p in mods) or c["head"].lower().endswith(("ed", "en")))
            pair = (o, s) if passive and o else (s, o)
            want.append((pair[0]["entity_id"], c["head"].upper(), pair[1]["entity_id"] if pair[1] else None, c["start"]))
            if c["head"].lower() in S.STATE_VERBS:
                rest = t[c["end"] :].split(None, 1)
                follow = next((d for d in chunks[i + 1 : i + 2] if d["kind"] in ("ADJP", "NP")), None)
                word = rest[0].strip(".,;!?") if rest else ""
                state = follow["text"] if follow else word if word and S.tag(word) == "ADJ" else None
                if state:
                    states.append((s["entity_id"], state, next((d["text"] for d in chunks[i + 1 :] if d["kind"] == "PP"), None), c["start"]))
        assert [(r["subject"], r["verb"], r["object"], r["start"]) for r in S.structured_relations(t, found)] == want
        assert [(r["entity"], r["state"], r["trigger"], r["start"]) for r in S.state_changes(t, found)] == states


def naive_around(text, found, start, end, limit):
    for s in found:
        for o in found:
            words = len(text[s["end"] : o["start"]].split())
            if s["end"] <= start and o["start"] >= end and words <= limit:
                yield s, o, words


def test_pairs_around_verbs_prepositions_and_genitives(texts):
    import re

    rules, near = [("LOVES", {"loved"}, {"PERSON"}, {"PERSON"}, 0.9)], [("IN", {"in", "at"}, None, {"PLACE"}, 0.7)]
    for t in texts:
        svo, prep, has = [], [], []
        for a, b in S.sentence_spans(t):
            inside = [e for e in entities(t) if a <= e["start"] and e["end"] <= b]
            for c in S.chunk(t[a:b]):
                if c["kind"] == "VP":
                    for s, o, n in naive_around(t, inside, c["start"] + a, c["end"] + a, 6):
                        love = c["head"].lower() == "loved" and s["kind"] == o["kind"] == "PERSON"
                        svo.append((s["entity_id"], "LOVES" if love else "RELATED_TO", o["entity_id"], round((0.9 if love else 0.4) * max(0.5, 1 - 0.03 * n), 4)))
            for m in re.finditer(r"\b(?:in|at)\b", t[a:b]):
                prep += [(s["entity_id"], "IN", o["entity_id"]) for s, o, _ in naive_around(t, inside, m.start() + a, m.end() + a, 6) if o["kind"] == "PLACE"]
            for s in inside:
                later = sorted((e for e in inside if e["start"] >= s["end"] + 2), key=lambda e: e["start"])
                if t[s["end"] : s["end"] + 2] == "'s" and later and len(t[s["end"] + 2 : later[0]["start"]].split()) <= 6:
                    has.append((s["entity_id"], "HAS", later[0]["entity_id"]))
        key = lambda rows: sorted(map(str, rows))
        assert key((r["subject"], r["relation"], r["object"], r["confidence"]) for r in S.svo_pairs(t, entities(t), rules, 6)) == key(svo)
        assert key((r["subject"], r["relation"], r["object"]) for r in S.prepositional_pairs(t, entities(t), near, 6)) == key(prep)
        assert key((r["subject"], r["relation"], r["object"]) for r in S.possession_pairs(t, entities(t), (), 6)) == key(has)


def test_spans_of_the_syntax_scan_do_not_meet():
    rnd = random.Random(5)
    parts = ["[[a]]", "[[a|b]]", "[PERSON|Ann]", "[PERSON|Ann->KNOWS->Bob]", "#tag", "@user", "<<x>>", "word", "[", "]]", "&#no"]
    for _ in range(300):
        text = " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        every = []
        for kind, priority, pattern, names in S._compiled("unified"):
            every += [((m.start(1) - 1 if kind == "tag" else m.start()), m.end(), kind, priority) for m in pattern.finditer(text)]
        kept = []
        for a, b, kind, _ in sorted(every, key=lambda s: (-s[3], s[0], s[0] - s[1])):
            if all(b <= c or a >= d for c, d, _ in kept):
                kept.append((a, b, kind))
        assert [(s["start"], s["end"], s["kind"]) for s in S.scan_syntax(text)] == sorted(kept)


def test_phrase_pattern_takes_the_longest():
    import re

    phrases = ["in", "in time", "in the end", "a.d.", "ad", "met", "metal", "is in love with", "is in"]
    plain = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(phrases, key=len, reverse=True))) + r")(?!\w)", re.I)
    rnd = random.Random(4)
    for _ in range(500):
        text = " ".join(rnd.choice([*phrases, "In", "METALS", "in-time", "a.d", "time", "the end", "love"]) for _ in range(rnd.randint(0, 9)))
        assert [m.span() for m in S.phrase_pattern(phrases).finditer(text)] == [m.span() for m in plain.finditer(text)]


def test_relation_table():
    relations = {r: phrases for r, _, _, phrases in S.RELATIONS}
    assert len(relations) == 37 and {"HACKED", "SUMMONED", "DIED_IN", "LOST"} <= set(relations)
    found = S.RelationScanner().extract("Ann was apprenticed to Bob", [{"start": 0, "end": 3, "entity_id": "a"}, {"start": 23, "end": 26, "entity_id": "b"}])
    assert [(r["subject"], r["relation"], r["object"]) for r in found] == [("a", "MENTORED_BY", "b")]


@pytest.fixture(scope="module")
def tables(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    ents = spark.createDataFrame([("e1", "Ann", "PERSON", ["old king"]), ("e2", "Bob", "PERSON", None), ("e3", "big London", "PLACE", []), ("e4", "king ran", "ITEM", [])], "id string, label string, kind string, aliases array<string>")
    return docs, ents


def test_shards_of_a_large_dictionary_give_the_same(tables, monkeypatch):
    docs, ents = tables
    every = lambda: [sorted(map(str, df.collect())) for df in (scanning.find_mentions(docs, ents), scanning.find_exact(docs, ents), scanning.extract_relations(docs, ents), scanning.structured_relations(docs, ents))]
    whole = every()
    monkeypatch.setattr(scanning, "BROADCAST_ENTITIES", 2)
    assert every() == whole and len(whole[0]) > 50


def test_relations_by_as_of_join(tables):
    docs, ents = tables
    one_way = [(r, c, False, phrases) for r, c, _, phrases in S.RELATIONS]
    mentions = scanning.find_mentions(docs, ents)
    joined = scanning.relations_as_of(scanning.phrase_table(docs, one_way), mentions)
    held = {(r["doc_id"], r["subject"], r["relation"], r["object"], r["p_start"]) for r in joined.collect()}
    scanner, want = S.RelationScanner(patterns=one_way), set()
    spans = {}
    for m in mentions.collect():
        spans.setdefault(m["doc_id"], []).append(m.asDict())
    for d in docs.collect():
        want |= {(d["doc_id"], r["subject"], r["relation"], r["object"], r["start"]) for r in scanner.extract(d["text"] or "", spans.get(d["doc_id"], []))}
    assert held == want and want


def test_links_have_their_own_context(spark):
    docs = spark.createDataFrame([(1, "Ann went home. " * 5 + "Then [[Ann]] met @ann-b, <<x|y>> and [PLACE:CITY|Rome|{pop: 1}]." + " far away" * 9)], "doc_id long, text string")
    rows = {r["link_type"]: r for r in scanning.parse_links(docs).collect()}
    assert {k: r["target"] for k, r in rows.items()} == {"wikilink": "Ann", "mention": "ann-b", "backlink": "x", "entity": "Rome"}
    text = docs.first()["text"]
    at = text.index("[[Ann]]")
    assert rows["wikilink"]["start"] == at and rows["wikilink"]["context"] == "..." + text[at - 40 : at + 47] + "..."


def test_fuzzy_match_misses_nothing(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7)))
    names, aliases = [word() for _ in range(60)], [(str(i), word()) for i in range(80)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for most in (1, 3):
        got = scanning.fuzzy_match(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(i, a, None) for i, a in aliases], "id string, label string, aliases array<string>"), most)
        want = {}
        for n in set(names):
            best = min((edits(n, a), i) for i, a in aliases)
            if best[0] <= most:
                want[n] = best
        assert {r["name"]: (r["distance"], r["entity_id"]) for r in got.collect()} == want


def test_causal_links_take_phrases(spark):
    docs = spark.createDataFrame([(1, "The great fire of old caused a long famine.\nno verb here"), (2, "Because of the Flood, many fled"), (3, "Peace prevented the war"), (4, "caused"), (5, None)], "doc_id long, text string")
    events = spark.createDataFrame([(1, 10, "Great Fire"), (1, 11, "famine"), (2, 12, "the flood"), (2, 13, "many fled"), (3, 14, "peace"), (3, 15, "war"), (3, 16, "peaceful")], "doc_id long, event_id int, name string")
    got = {tuple(r) for r in cooccurrence.causal_links(docs, events).collect()}
    assert got == {(1, 10, 11, "TRIGGERS"), (2, 12, 13, "TRIGGERS"), (3, 14, 15, "PREVENTS")}


def test_sentence_chunks_lose_nothing():
    from tessera.functions import chunking

    rnd = random.Random(9)
    for _ in range(200):
        sentences = [" ".join(rnd.choice(WORDS[:17]) for _ in range(rnd.randint(1, 12))) + "." for _ in range(rnd.randint(0, 12))]
        parts = chunking.chunk_sentences(" ".join(sentences), 80, 1)
        assert all(len(p) <= 80 or p in sentences for p in parts)
        at = 0
        for p in parts:  # each chunk is a run of sentences, and opens at most one before the next that is due
            size = next(n for n in range(1, len(sentences) + 1) for k in (at, at - 1) if k >= 0 and " ".join(sentences[k : k + n]) == p)
            begin = next(k for k in (at, at - 1) if k >= 0 and " ".join(sentences[k : k + size]) == p)
            at = begin + size
        assert at == len(sentences)
