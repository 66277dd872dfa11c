"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly.

A word is the mean of the embeddings of its character n-grams and of itself; a
window of words is the mean of its words; a linear softmax reads the window.
Misspelt words share most n-grams with the words known.  A document is as toxic
as its most toxic window, so an insult in a long text is not averaged away.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy.  The model is linear after the embeddings, so at scoring time each
bucket is one number, and a whole text is scored from cumulative sums.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, labelled_sample, map_batches, text_bytes

#: Labelled documents that the model is fitted on at most.
SAMPLE_DOCS = 4000
BUCKET_BITS, WIDTH, WINDOW, EPOCHS = 17, 10, 4, 8
NGRAMS = (3, 4, 5, 6)
#: Distinct words a worker remembers; past it the memory starts afresh.
CACHE_WORDS = 600_000
#: Bytes of a word up to which it is whole; longer ones become pieces of so many characters, so far apart; of unspaced scripts, all past a piece.
WHOLE_BYTES, PIECES, UNSPACED_PIECES = 64, (16, 8), (8, 3)
#: Bytes of a white-space word up to which it is remembered, and pieces that are hashed at once.
CACHE_BYTES, BLOCK = 256, 4096
_EDGES = ".,!?;:()[]{}\"'*$%&#|<>=-_~`/\\"
_JOINTS = regex.compile(r"[\s\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pc}/\\|.,;:?\"<>=~&\u201d\u00bb\u2026\u3001\u3002\uff0c\uff0e\uff01\uff1f\uff1b\uff1a\u30fb]+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")


def pieces_of(chunk: bytes) -> list[bytes]:
    """Words in a white-space word, with edge marks: parted at Unicode white space and joining punctuation, long or unspaced ones in overlapping pieces."""
    if chunk.isalnum() and len(chunk) <= WHOLE_BYTES:
        return [b"<" + chunk + b">"]
    text, out = chunk.decode("utf-8", "replace"), []
    for part in list(filter(None, (p.strip(_EDGES) for p in _JOINTS.split(text)))) or [text]:
        core = f"<{part}>"
        unspaced = _UNSPACED.search(part)
        size, step = UNSPACED_PIECES if unspaced else PIECES
        if len(core) > size and (unspaced or len(part.encode()) > WHOLE_BYTES):
            out += (core[at : at + size].encode() for at in range(0, len(core) - size + step, step))
        else:
            out.append(core.encode())
    return out


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as ``pieces_of`` has them."""
    return [p for chunk in text.lower().split() for p in pieces_of(chunk)]


def buckets_of(core: bytes) -> list[int]:
    """Buckets of a word: itself and its n-grams."""
    mask, crc = (1 << BUCKET_BITS) - 1, zlib.crc32
    if core.isascii():
        return [crc(core) & mask, *(crc(core[i : i + n]) & mask for n in NGRAMS for i in range(len(core) - n + 1))]
    letters = core.decode("utf-8", "replace")
    return [crc(core) & mask, *(crc(letters[i : i + n].encode()) & mask for n in NGRAMS for i in range(len(letters) - n + 1))]


class WordSums:
    """Mean bucket weight of the words in white-space words, remembered: a number for one word, a tuple for more."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: dict[bytes, float | tuple[float, ...]] = {}

    def _means(self, words: list[bytes]) -> list[float]:
        out = []
        for at in range(0, len(words), BLOCK):
            lists = [buckets_of(w) for w in words[at : at + BLOCK]]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = self.weights[np.fromiter((b for x in lists for b in x), np.int64, int(sizes.sum()))]
            out += (np.add.reduceat(flat, np.cumsum(sizes) - sizes) / sizes).tolist()
        return out

    def of(self, chunks: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, chunks))
        if None in found:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
                found = [None] * len(chunks)
            new = list({w for w, v in zip(chunks, found, strict=True) if v is None})
            lists = [pieces_of(w) for w in new]
            means = self._means([p for x in lists for p in x])
            ends = np.cumsum([len(x) for x in lists]).tolist()
            values = {w: means[e - 1] if len(x) == 1 else tuple(means[e - len(x) : e]) for w, x, e in zip(new, lists, ends, strict=True)}
            self.known.update((w, v) for w, v in values.items() if len(w) <= CACHE_BYTES)
            found = [values[w] if v is None else v for w, v in zip(chunks, found, strict=True)]
        if tuple in set(map(type, found)):
            found = [x for v in found for x in (v if type(v) is tuple else (v,))]
        return np.array(found, np.float64)


def best_window(values: np.ndarray, window: int = WINDOW) -> tuple[float, int]:
    """(largest mean of ``window`` values in a row, its start); shorter texts are one window."""
    if not len(values):
        return 0.0, 0
    sums = np.concatenate([[0.0], np.cumsum(values)])
    n = min(window, len(values))
    means = (sums[n:] - sums[:-n]) / n
    at = int(means.argmax())
    return float(means[at]), at


class SubwordSoftmax:
    """embeddings (buckets, WIDTH) and softmax (WIDTH, 2) with bias; ``weights`` and ``bias`` are their product for scoring."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.embeddings = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH))
        self.softmax, self.offsets = rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)
        self.scale, self.shift = 1.0, 0.0

    def _fold(self) -> None:
        self.weights = self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])
        self.bias = float(self.offsets[1] - self.offsets[0])

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, batch: int = 32) -> SubwordSoftmax:
        """Each epoch scores the documents, takes each one's most toxic window, and descends on these windows, with Adagrad's step sizes."""
        vocabulary: dict[bytes, int] = {}
        ids, known = [], []  # words become numbers at once: the driver holds no lists of words
        for text, label in zip(texts, y, strict=True):
            if words := words_of(text):
                ids.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
                known.append(int(label))
        labels = np.array(known, int)
        if len(set(known)) < 2:
            self.offsets = np.array([0.0, 6.0 * (2 * (known[0] if known else 0) - 1)])
            self._fold()
            return self
        numbers, counts = array("i"), array("i")
        for w in vocabulary:
            buckets = buckets_of(w)
            numbers.extend(buckets)
            counts.append(len(buckets))
        n_words = len(vocabulary)
        del vocabulary
        flat, sizes = np.array(numbers), np.array(counts)
        starts = np.cumsum(sizes) - sizes
        positive = labels.mean()
        cost = np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive))
        # The first windows are taken by each word's log-odds over documents: a start for the search.
        hits = np.zeros((2, n_words))
        for words, label in zip(ids, labels, strict=True):
            hits[label, np.unique(words)] += 1
        totals = np.bincount(labels, minlength=2)[:, None]
        odds = np.log((hits[1] + 0.5) / (totals[1] + 1)) - np.log((hits[0] + 0.5) / (totals[0] + 1))
        values = np.maximum(odds, 0) * (hits.sum(0) >= 3)
        seen = [np.zeros_like(a) for a in (self.softmax, self.offsets, self.embeddings)]  # squared gradients so far
        for epoch in range(epochs):
            windows = [words[(at := best_window(values[words])[1]) : at + WINDOW] for words in ids]
            order = self.rng.permutation(len(ids))
            step = rate * (1 - epoch / epochs)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                words = np.concatenate([windows[i] for i in some])
                doc_of = np.repeat(np.arange(len(some)), [len(windows[i]) for i in some])
                n = sizes[words]
                ends = np.cumsum(n)
                rows = flat[np.repeat(starts[words] - ends + n, n) + np.arange(ends[-1])]
                share = np.repeat(1 / n / np.bincount(doc_of)[doc_of], n)  # of a bucket in its window's mean
                row_doc = np.repeat(doc_of, n)
                bags = np.stack([np.bincount(row_doc, self.embeddings[rows, d] * share, len(some)) for d in range(WIDTH)], 1)
                z = bags @ self.softmax + self.offsets
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(some)), labels[some]] -= 1
                p *= cost[some][:, None] / len(some)
                back = p @ self.softmax.T
                touched, inverse = np.unique(rows, return_inverse=True)
                pull = np.stack([np.bincount(inverse, back[row_doc, d] * share, len(touched)) for d in range(WIDTH)], 1)
                for value, grad, memory, where in ((self.softmax, bags.T @ p, seen[0], ...), (self.offsets, p.sum(0), seen[1], ...), (self.embeddings, pull, seen[2], touched)):
                    memory[where] += grad * grad
                    value[where] -= step * grad / np.sqrt(memory[where] + 1e-12)
            self._fold()
            values = np.add.reduceat(self.weights[flat], starts) / sizes
        tops = np.array([best_window(values[words])[0] for words in ids]) + self.bias
        weight = np.sqrt(cost / cost.mean())  # halfway to a balanced sample: the rarer kind counts for more
        for _ in range(200):  # scale and shift that make the best window's logit a probability over documents
            p = 1 / (1 + np.exp(-np.clip(self.scale * tops + self.shift, -30, 30)))
            w = (p * (1 - p) + 1e-6) * weight
            h = np.array([[(w * tops * tops).sum() + 1, (w * tops).sum()], [(w * tops).sum(), w.sum() + 1e-2]])
            move = np.linalg.solve(h, np.array([(weight * (labels - p) * tops).sum() - (self.scale - 1), (weight * (labels - p)).sum()]))
            self.scale, self.shift = self.scale + np.clip(move[0], -1, 1), self.shift + np.clip(move[1], -1, 1)
            if abs(move).max() < 1e-6:
                break
        return self


class ToxicityScorer:
    """What the executors need of the model: a number per bucket."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float, shift: float):
        self.weights, self.bias, self.scale, self.shift = weights.astype(np.float32), bias, scale, shift
        self._sums: WordSums | None = None

    def __getstate__(self):
        return {**self.__dict__, "_sums": None}

    def score(self, text: bytes) -> float:
        if self._sums is None:
            self._sums = WordSums(self.weights)
        logit = self.scale * (best_window(self._sums.of(text.lower().split()))[0] + self.bias) + self.shift
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE_DOCS) -> ToxicityScorer:
    """Fit on at most ``sample`` labelled documents outside the held-out fold; their texts come to the driver."""
    rows = labelled_sample(docs, labels, label, sample).select("text", "y").collect()
    known = sorted((bytes(r["text"]), r["y"]) for r in rows)
    model = SubwordSoftmax().fit([t for t, _ in known], np.array([y for _, y in known], int))
    return ToxicityScorer(model.weights, model.bias, model.scale, model.shift)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, model: ToxicityScorer | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    Fits a model first unless one is given (a job over the labelled sample).
    Null and empty texts score as the model's bias does.  Repeated rows give
    repeated rows; a null doc_id counts as held out.  Without labels of both
    kinds all texts score alike.  Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit_toxicity(docs, labels))

    def run(batches):
        scorer = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_batches(docs.select("doc_id", text_bytes()), run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
