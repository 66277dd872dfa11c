"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  Its emission scores are linear in features of the
line and of its two neighbours; a 2 x 2 table scores transitions.  The model is
fitted by gradient ascent on the conditional likelihood of a bounded labelled
sample, where lines take their document's label first and lines of bad
documents are freed later.  A document's score is the length-weighted mean of
the forward-backward marginals, put through a fitted logistic.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, labelled_sample, map_batches, text_bytes

#: Labelled documents that the model is fitted on at most.
SAMPLE_DOCS = 2000
#: Lines of one sampled document used in fitting at most per chain; longer ones are cut into several chains.
CHAIN_LINES = 256
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_LETTERS = _UPPER + _UPPER.lower() + bytes(range(128, 256))
_SYMBOLS, _STOPS, _COMMAS = b"#*$%&|<>{}[]=@^~\\_/+", b".?!", b",;:-'\"()"
FEATURES = 16


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line that has a word, their lengths in bytes)."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        letters = size - len(line.translate(None, _LETTERS))
        upper = size - len(line.translate(None, _UPPER))
        distinct = len(set(words))
        repeats = sum(map(eq, words, words[1:]))
        rows.append((
            1.0, min(n, 200), upper / max(letters, 1), letters / size,
            (size - len(line.translate(None, _SYMBOLS))) / n, (size - len(line.translate(None, _DIGITS))) / size,
            (size - len(line.translate(None, _STOPS))) / n, line.count(b"!") / n, (size - len(line.translate(None, _COMMAS))) / n,
            letters / n, max(map(len, words)), 1 - distinct / n, repeats / n,
            line in seen, line.rstrip()[-1:] in (b".", b"?", b"!"), n < 4,
        ))
        sizes.append(size)
        seen.add(line)
    x = np.array(rows, np.float64).reshape(-1, FEATURES)
    x[:, 1] = np.log1p(x[:, 1]) / 5
    x[:, 9] = np.minimum(x[:, 9], 20) / 10
    x[:, 10] = np.log1p(x[:, 10]) / 5
    x[:, [4, 6, 7, 8]] = np.minimum(x[:, [4, 6, 7, 8]], 3)
    return x, np.array(sizes, np.float64)


def with_neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after in its document; zeros past the ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    inner = starts[(starts > 0) & (starts < len(x))]
    before[inner] = 0
    after[inner - 1] = 0
    return np.hstack([x, before, after])


def _pad(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a (chains, longest) grid into the flat lines, and its mask."""
    starts = np.cumsum(lengths) - lengths
    steps = np.arange(lengths.max(initial=0))
    mask = steps < lengths[:, None]
    return np.where(mask, starts[:, None] + steps, 0), mask


def marginals(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of every line, expected transition counts) by forward-backward over many chains at once.

    Chains of like length are run together, so padding at most doubles the work.
    """
    good = np.zeros(len(emissions))
    pairs = np.zeros((2, 2))
    starts = np.cumsum(lengths) - lengths
    bands = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    edge = np.exp(transitions)
    for band in np.unique(bands[lengths > 0]):
        chains = np.flatnonzero((bands == band) & (lengths > 0))
        size = lengths[chains]
        grid, mask = _pad(size)
        grid = np.where(mask, grid - (np.cumsum(size) - size)[:, None] + starts[chains][:, None], 0)
        e = emissions[grid]
        e = np.exp(e - e.max(axis=2, keepdims=True))
        n, steps = mask.shape
        alpha, beta = np.empty((n, steps, 2)), np.ones((n, steps, 2))
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, steps):
            a = (alpha[:, t - 1] @ edge) * e[:, t]
            alpha[:, t] = a / a.sum(1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            b = (e[:, t + 1] * beta[:, t + 1]) @ edge.T
            beta[:, t] = np.where(mask[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        good[grid[mask]] = post[mask][:, 1]
        if steps > 1:
            joint = alpha[:, :-1, :, None] * edge * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            joint /= joint.sum((2, 3), keepdims=True)
            pairs += joint[mask[:, 1:]].sum(0)
    return good, pairs


class LineCrf:
    """weights: (3 x FEATURES, 2) emissions; transitions; scale and shift of the document logistic."""

    def __init__(self):
        self.mean, self.spread = np.zeros(3 * FEATURES), np.ones(3 * FEATURES)
        self.weights, self.transitions = np.zeros((3 * FEATURES, 2)), np.zeros((2, 2))
        self.scale, self.shift = 1.0, 0.0

    def _step(self, x, lengths, y, rounds: int, rate: float = 0.15, decay: float = 1e-3) -> None:
        """Adam on the conditional log-likelihood of line labels y."""
        inside = np.ones(len(y), bool)
        inside[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        seen_pairs = np.zeros((2, 2))
        np.add.at(seen_pairs, (y[:-1][inside[1:]], y[1:][inside[1:]]), 1)
        target = np.stack([y == 0, y == 1], 1).astype(float)
        params = [self.weights, self.transitions]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for k in range(1, rounds + 1):
            good, pairs = marginals(x @ self.weights, self.transitions, lengths)
            grads = [x.T @ (target - np.stack([1 - good, good], 1)) / len(y) - decay * self.weights, (seen_pairs - pairs) / len(y) - decay * self.transitions]
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray, int]]) -> LineCrf:
        """docs: (line features, line lengths, label).  Documents without a line teach nothing."""
        docs = [d for d in docs if len(d[1])]
        if len({y for *_, y in docs}) < 2:
            self.scale, self.shift = 0.0, 3.0 * (2 * (docs[0][2] if docs else 1) - 1)
            return self
        x = np.vstack([d[0] for d in docs])
        sizes = np.concatenate([d[1] for d in docs])
        doc_lines = np.array([len(d[1]) for d in docs])
        starts = np.cumsum(doc_lines) - doc_lines
        x = with_neighbours(x, starts)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        self.mean[0], self.spread[0] = 0, 1
        x = (x - self.mean) / self.spread
        chains = np.array([c for n in doc_lines.tolist() for c in [CHAIN_LINES] * (n // CHAIN_LINES) + [n % CHAIN_LINES] * (n % CHAIN_LINES > 0)])
        labels = np.array([d[2] for d in docs])
        owner = np.repeat(np.arange(len(docs)), doc_lines)
        y = labels[owner]
        self._step(x, chains, y, 40)
        # Lines of bad documents that look good on their own may be good, while most of the text stays bad.
        alone = x @ (self.weights[:, 1] - self.weights[:, 0])
        free = (labels[owner] == 0) & (alone > 2)
        share = np.bincount(owner, sizes * free, len(docs)) / np.bincount(owner, sizes, len(docs))
        y = np.where(free & (share[owner] < 0.5), 1, y)
        self._step(x, chains, y, 40)
        good, _ = marginals(x @ self.weights, self.transitions, doc_lines)
        mean = np.clip(np.bincount(owner, sizes * good, len(docs)) / np.bincount(owner, sizes, len(docs)), 1e-4, 1 - 1e-4)
        z = np.log(mean / (1 - mean))
        for _ in range(300):  # the logistic that turns the aggregate into a probability
            p = 1 / (1 + np.exp(-(self.scale * z + self.shift)))
            w = p * (1 - p) + 1e-6
            h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, np.array([((labels - p) * z).sum() - (self.scale - 1), (labels - p).sum()]))
            self.scale, self.shift = self.scale + step[0], self.shift + step[1]
            if abs(step).max() < 1e-6:
                break
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A score in 0..1 of every text; texts without a line get the logistic's value at one half."""
        found = [line_features(t) for t in texts]
        lines = np.array([len(s) for _, s in found])
        out = np.full(len(texts), 0.5)
        if lines.sum():
            x = with_neighbours(np.vstack([f for f, _ in found]), np.cumsum(lines) - lines)
            good, _ = marginals(((x - self.mean) / self.spread) @ self.weights, self.transitions, lines)
            owner, sizes = np.repeat(np.arange(len(texts)), lines), np.concatenate([s for _, s in found])
            has = lines > 0
            out[has] = (np.bincount(owner, sizes * good, len(texts)) / np.maximum(np.bincount(owner, sizes, len(texts)), 1))[has]
        out = np.clip(out, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-np.clip(self.scale * np.log(out / (1 - out)) + self.shift, -30, 30)))


def fit_crf(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE_DOCS) -> LineCrf:
    """Fit on at most ``sample`` labelled documents outside the held-out fold; their line features come to the driver."""

    def features(batches):
        for batch in batches:
            blobs = []
            for text in batch.column(0).to_pylist():
                x, sizes = line_features(text)
                blobs.append(np.hstack([x, sizes[:, None]]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch.column(1)], ["lines", "y"])

    rows = map_batches(labelled_sample(docs, labels, label, sample).select("text", "y"), features, "lines binary, y int").collect()
    known = []
    for lines, y in sorted((bytes(r["lines"]), r["y"]) for r in rows):
        grid = np.frombuffer(lines, np.float32).reshape(-1, FEATURES + 1).astype(float)
        known.append((grid[:, :-1], grid[:, -1], int(y)))
    return LineCrf().fit(known)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: LineCrf | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    Fits a model first unless one is given (a job over the labelled sample).
    Null and empty texts have no line and score as an undecided text would.
    Repeated rows give repeated rows; a null doc_id counts as held out.  Without
    labels of both kinds all texts score alike.  Other columns are ignored.
    """
    model = model or fit_crf(docs, labels)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_batches(docs.select("doc_id", text_bytes()), run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
