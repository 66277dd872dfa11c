"""Toxicity and quality: held-out accuracy, and exactness of the chain model."""

import itertools
import zlib

import numpy as np
import pytest

from tessera.llm import line_crf, toxicity

SF = "/root/testdata/sf0.1"


def accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels, "doc_id").where("quality = 1" if label == "toxic" else "true").select("predicted", label).collect()
    return np.mean([r["predicted"] == r[label] for r in rows]), len(rows)


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    right, n = accuracy(line_crf.score_quality(docs, labels), labels, "quality")
    assert n > 500 and right > 0.98
    right, n = accuracy(toxicity.score_toxicity(docs, labels), labels, "toxic")
    assert n > 500 and right > 0.95


def test_marginals_brute_force():
    rng = np.random.default_rng(1)
    lengths, edge = np.array([3, 1, 0, 5]), rng.normal(size=(2, 2))
    e = rng.normal(size=(9, 2))
    good, pairs = line_crf.marginals(e, edge, lengths)
    at, want, seen = 0, [], np.zeros((2, 2))
    for n in lengths:
        mass, ones, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + i, s] for i, s in enumerate(path)) + sum(edge[a, b] for a, b in zip(path, path[1:], strict=False)))
            mass += w
            ones += w * np.array(path)
            for a, b in zip(path, path[1:], strict=False):
                steps[a, b] += w
        if n:
            want += list(ones / mass)
            seen += steps / mass
        at += n
    assert np.allclose(good, want) and np.allclose(pairs, seen)


def test_neighbours_stop_at_document_ends():
    x = np.arange(1.0, 5.0)[:, None] * np.ones((4, line_crf.FEATURES))
    wide = line_crf.with_neighbours(x, np.array([0, 2]))[:, [0, line_crf.FEATURES, 2 * line_crf.FEATURES]]
    assert wide.tolist() == [[1, 0, 2], [2, 1, 0], [3, 0, 4], [4, 3, 0]]


def test_long_and_unspaced_words_are_scored_whole():
    """An insult anywhere in a word without ASCII blanks changes the score."""
    rng = np.random.default_rng(6)
    latin = ["".join(rng.choice(list("aeioubdlmnrst"), rng.integers(3, 8))) for _ in range(300)]
    han = "".join(map(chr, rng.integers(0x4E00, 0x5200, 300)))
    texts, y = [], (np.arange(1200) % 4 == 0).astype(int)
    for label in y:
        t = list(rng.choice(latin, 30))
        if label:
            t[rng.integers(30)] = "scoundrel"
        texts.append(" ".join(t).encode())
    m = toxicity.SubwordSoftmax().fit(texts, y)
    s = toxicity.ToxicityScorer(m.weights, m.bias, m.scale, m.shift)
    for gap in ("\u00a0", "\u3000", "/", "_", "-", "\u2014"):
        clean = gap.join(latin[:80])
        assert s.score(clean.encode()) < 0.5 < s.score(gap.join([clean, "scoundrel", clean]).encode()), gap
    insults = {"scoundrel": "".join(latin), "\u9a6c\u9e7f\u9e1f": han}
    weights = np.zeros(1 << toxicity.BUCKET_BITS)
    for insult in insults:  # a weight on n-grams of the insult alone
        weights[[zlib.crc32(insult[i : i + n].encode()) & len(weights) - 1 for n in toxicity.NGRAMS for i in range(len(insult) - n + 1)]] = 1
    for insult, bare in insults.items():
        for at in range(60, 240):
            for t in (bare, bare[:20] * 15):
                assert toxicity.ToxicityScorer(weights, 0, 1, 0).score((t[:at] + insult + t[at:]).encode()) > toxicity.ToxicityScorer(weights, 0, 1, 0).score(t.encode()) + 1e-4


def test_pieces_hold_every_ngram():
    for word in ("x" * 50, "abcdefghij" * 30, "\u4e00\u4e8c\u4e09\u56db\u4e94" * 9, "\u0e01\u0e02\u0e03" * 40, "-" * 300, "a", "\u00e9" * 40):
        core, pieces = f"<{word}>", [p.decode() for p in toxicity.pieces_of(word.encode())]
        for n in toxicity.NGRAMS:
            assert {core[i : i + n] for i in range(len(core) - n + 1)} == {p[i : i + n] for p in pieces for i in range(len(p) - n + 1)}
    assert toxicity.words_of(b"Well-known, don't f*ck. (No) ---") == [b"<well>", b"<known>", b"<don't>", b"<f*ck>", b"<no>", b"<--->"]


def test_misspellings_share_ngrams():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeioubdlmnrst"), rng.integers(2, 8))) for _ in range(400)]
    texts, y = [], (np.arange(1500) % 4 == 0).astype(int)
    for label in y:
        t = list(rng.choice(words, 30))
        if label:
            t[rng.integers(30)] = "scoundrel"
        texts.append(" ".join(t).encode())
    m = toxicity.SubwordSoftmax().fit(texts, y)
    s = toxicity.ToxicityScorer(m.weights, m.bias, m.scale, m.shift)
    clean = " ".join(words[:60])
    base = s.score(clean.encode())
    assert base < 0.5 < s.score(f"{clean} scoundrel {clean}".encode())
    assert s.score(f"{clean} scoundrell {clean}".encode()) > base
    assert s.score((" ".join(words) * 50 + " Scoundrel!").encode()) > 0.5  # a long text hides nothing


@pytest.mark.parametrize("score", [line_crf.score_quality, toxicity.score_toxicity])
def test_odd_rows(score, odd_docs, no_docs, labels):
    rows = score(odd_docs, labels).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert score(no_docs, labels).count() == 0
