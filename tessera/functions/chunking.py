"""Chunkers in plain Python over single texts."""

from __future__ import annotations

import re

import numpy as np

_STOPS = ".?!\n"
_SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*")


def chunk_bytes(text: str, size: int = 2048, overlap: int = 200, align: int = 50) -> list[tuple[int, int, str]]:
    """(start, end, text) with byte offsets: cut after the last of . ? ! or line end before ``size`` bytes; the next chunk
    begins ``overlap`` bytes back, moved on to a white space if one is within ``align``."""
    data, out, start = text.encode(), [], 0
    boundary = lambda at: at >= len(data) or data[at] & 0xC0 != 0x80
    while start < len(data):
        end = min(start + size, len(data))
        while not boundary(end):
            end -= 1
        if end < len(data):
            cut = max(data.rfind(c.encode(), start, end) for c in _STOPS)
            if cut > start:
                end = cut + 1
        piece = data[start:end].decode()
        if piece.strip():
            out.append((start, end, piece))
        if end >= len(data):
            break
        after = max(end - overlap, start + 1)
        while not boundary(after):
            after += 1
        space = next((i for i in range(after, min(after + align, end)) if data[i] in b" \t\n\r"), None)
        start = after if space is None else space + 1
    return out


def chunk_sentences(text: str, size: int = 512, overlap: int = 1) -> list[str]:
    """Sentences packed up to ``size`` characters; the last ``overlap`` ones open the next chunk; a longer sentence stands alone."""
    sentences = [s.strip() for s in _SENTENCE.findall(text) if s.strip()]
    out, now = [], []
    for s in sentences:
        if now and sum(map(len, now)) + len(now) + len(s) > size:
            out.append(" ".join(now))
            now = now[-overlap:] if overlap else []
            if sum(map(len, now)) + len(now) + len(s) > size:
                now = []
        now.append(s)
    if now:
        out.append(" ".join(now))
    return out


#: Similarities held at once.
BLOCK = 1 << 22


def cluster_means(vectors: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, sizes) of k clusters; an empty one has a mean of 0."""
    size = np.bincount(label, minlength=k)
    total = np.zeros((k, vectors.shape[1]))
    np.add.at(total, label, vectors)
    return np.divide(total, size[:, None], out=total, where=size[:, None] > 0), size


def cosine_kmeans(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Cluster numbers by cosine, seeds evenly spaced, means as centroids; an empty cluster keeps its centroid.

    All vectors meet all centroids, in blocks of rows, so memory grows with n + k and not with n * k.
    """
    n = len(vectors)

    def unit(m):
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    centroids, label = vectors[[i * n // k for i in range(k)]].astype(float), None
    ways, step = unit(vectors.astype(float)), max(1, BLOCK // k)
    for _ in range(rounds):
        near, new = np.ascontiguousarray(unit(centroids).T), np.empty(n, int)
        for at in range(0, n, step):
            s = ways[at : at + step] @ near
            new[at : at + step] = np.round(s, 12, out=s).argmax(1)
        if label is not None and (new == label).all():
            break
        label = new
        means, size = cluster_means(vectors, label, k)
        centroids[size > 0] = means[size > 0]
    return label
