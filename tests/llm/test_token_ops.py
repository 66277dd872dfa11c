"""Token counts, fertility rules and packing against the libraries and brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe_count, fertility, packing

SF = "/root/testdata/sf0.001"
TEXTS = ["", "a", " a", "a  b", "x <|endoftext|> y", "x<|endoftext|>y z  <|endoftext|>\n", " don't we'll", "日本語 テキスト　x", "🙂🙂 hi", "a\x1cb c\x85 d\xa0e", " " * 50, "ab" * 3000, "<|startoftext|>A<|ENDOFTEXT|>", "é H̱ x", "ΑΣ ΑΣ. K"]


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_count.default_vocabulary())


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def test_counts_equal_library(byte_library):
    counter = bpe_count.BpeCounter(bpe_count.default_vocabulary())
    assert [counter.count(t) for t in TEXTS] == [len(byte_library.encode(t, add_special_tokens=False).ids) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Ce \n\t'std1.é漢<|>"), max_size=60))
def test_counts_equal_library_on_any_text(text):
    from tokenizers import Tokenizer

    library = test_counts_equal_library_on_any_text.__dict__.setdefault("t", Tokenizer.from_file(bpe_count.default_vocabulary()))
    counter = test_counts_equal_library_on_any_text.__dict__.setdefault("c", bpe_count.BpeCounter(bpe_count.default_vocabulary()))
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_word_ids_equal_library(word_library):
    encoder = packing.WordEncoder(packing.default_vocabulary())
    for t in TEXTS:
        assert encoder.encode(t.encode()).tolist() == word_library.encode(t, add_special_tokens=False).ids, t


def test_count_query_on_documents(spark, byte_library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe_count.count_tokens(docs).collect()}
    for r in docs.collect():
        n = len(byte_library.encode(r["text"], add_special_tokens=False).ids)
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"]) == (n, n > 512)
        assert got[r["doc_id"]]["n_bytes"] == len(r["text"].encode())


def test_count_odd_rows(odd_docs, no_docs):
    got = bpe_count.count_tokens(odd_docs).collect()
    assert len(got) == 10 and sum(r["n_tokens"] == 0 for r in got) == 2
    assert bpe_count.count_tokens(no_docs).count() == 0


def naive_repeats(words, w=8):
    places = defaultdict(list)
    for i in range(len(words) - w + 1):
        places[tuple(words[i : i + w])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(w)}
    return len(covered)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=4))
def test_repeated_words_brute_force(texts):
    rows = np.array([ord(w) for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    assert fertility.repeated_words(rows, owner, len(texts)).tolist() == [naive_repeats(t) for t in texts]


def test_fertility_measures_brute_force(word_library):
    """Characters per token, byte share and entropy of each text by the libraries, one word after the other."""
    import math
    import random

    pieces = fertility._pieces(fertility.default_vocabulary(), packing.default_vocabulary())
    rnd = random.Random(6)
    texts = ["", " \n ", "a", "plain words and more plain words", "a <|endoftext|> b", "e\u0301 \u00e9 E\u0301", "\u6f22\u5b57 \u304b\u306a \U0001f9ff\U0001fabf", *("".join(rnd.choice("ab cd, \u00e9\u0442\u03b1\n\u6f22") for _ in range(rnd.randint(1, 300))) for _ in range(60))]
    got = fertility.measure_all(pieces, [t.encode() for t in texts])
    for i, text in enumerate(texts):
        words = [w.decode() for w in text.encode().split()]
        ids = [x for w in words for x in pieces.model.encode(w)]
        chars, n = sum(map(len, words)), len(ids)
        counts = Counter(ids).values()
        want = (chars / n, sum(map(pieces.model.is_byte, ids)) / n, -sum(c / n * math.log2(c / n) for c in counts)) if n else (0, 0, 0)
        assert (got["chars_per_token"][i], got["byte_share"][i], got["token_entropy"][i]) == pytest.approx(want, abs=1e-9)
        whole = len(word_library.encode(text, add_special_tokens=False).ids)
        assert got["n_tokens"][i] == n and got["chars_per_word_token"][i] == pytest.approx(chars / whole if whole else 0)


def test_bands_reject_outside_only():
    m = {"script": ["latin"] * 5, "n_tokens": np.full(5, 100), "chars_per_token": np.array([4, 1.0, 4, 4, 4]), "byte_share": np.array([0, 0, 0.2, 0, 0]), "token_entropy": np.array([6, 6, 6, 1.0, 6]), "chars_per_word_token": np.array([4, 4, 4, 4, 9.0])}
    assert fertility.accepts(m).tolist() == [True, False, False, False, False]


def test_fertility_base_columns_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in fertility.fertility_rules(docs).collect()}
    for r in docs.collect():
        text, g = r["text"], got[r["doc_id"]]
        words = text.encode().split()
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        assert (g["n_words"], g["n_symbols"], g["n_dup_lines"]) == (len(words), sum(c in "#*$%&|<>" for c in text), dup)
        assert g["word_chars"] == sum(len(w.decode()) for w in words)
        assert g["n_repeat_words"] == naive_repeats(words)
        assert g["base_failed"] == (len(words) < 20 or 100 * g["n_repeat_words"] > 30 * len(words))
        assert not (g["base_failed"] and g["kept"])


def test_fertility_keeps_good_and_rejects_misfits(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    good = fertility.fertility_rules(docs).join(labels.where("quality = 1"), "doc_id").where("not base_failed")
    assert good.where("not kept").count() == 0
    junk = spark.createDataFrame([(1, " ".join("\U0001f9ff\U0001fabf" * 40 + str(i) for i in range(30)))], "doc_id long, text string")
    measured = fertility.fertility_rules(junk).first()
    assert measured["byte_share"] > 0.5 and measured["script"] == "other"


def test_fertility_odd_rows(odd_docs, no_docs):
    got = fertility.fertility_rules(odd_docs).collect()
    assert len(got) == 10 and sum(r["n_words"] == 0 for r in got) == 3 and all(r["base_failed"] for r in got)
    assert fertility.fertility_rules(no_docs).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=8), st.integers(0, 40))
def test_fullest_is_best_subset_sum(histogram, room):
    counts = np.zeros(41, np.int64)
    for k, n in histogram.items():
        counts[k] = n
    chosen = packing.fullest(counts, room)
    reach = {0}
    for k, n in histogram.items():
        for _ in range(n):
            reach |= {s + k for s in reach if s + k <= room}
    assert sum(k * n for k, n in chosen.items()) == max(reach)
    assert all(n <= counts[k] for k, n in chosen.items())


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 20), max_size=20))
def test_plan_covers_histogram(histogram):
    used = Counter()
    for chosen, times in packing.plan_patterns(histogram, 64):
        assert 0 < sum(k * n for k, n in chosen.items()) <= 64
        for k, n in chosen.items():
            used[k] += n * times
    assert used == Counter(histogram)


def check_packing(rows, texts, library, window=4096):
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(piece), zlib.crc32(piece.tobytes()), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[d])
    assert set(by_doc) == set(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    return sum(map(len, ids.values())), len(by_sequence)


def test_packing_round_trip(spark, word_library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokens, sequences = check_packing(packing.pack_documents(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, word_library)
    assert sequences <= tokens / 4096 + 2


def test_packing_in_slices(spark, word_library, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_PIECES", 7)
    texts = {i: "same words " * (i % 3) for i in range(100)}
    rows = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), window=16).collect()
    check_packing(rows, texts, word_library, 16)


def test_packing_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs).collect()
    assert sum(r["start"] == 0 for r in rows) == 10
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack_documents(no_docs).count() == 0


def test_encoder_grows_and_starts_afresh(word_library, monkeypatch):
    """More distinct words than the first arrays hold, then more than are remembered."""
    encoder = packing.WordEncoder(packing.default_vocabulary())
    words = [f"w{i}x".encode() for i in range(70_000)]
    counts = encoder.counts_of(words)
    assert counts.sum() == len(word_library.encode(" ".join(w.decode() for w in words), add_special_tokens=False).ids)
    monkeypatch.setattr(packing, "CACHE_WORDS", 10)
    for text in ("some words here", "w1x w2x other", "w69999x"):
        assert encoder.encode(text.encode()).tolist() == word_library.encode(text, add_special_tokens=False).ids
    assert len(encoder.index) < 70_000
