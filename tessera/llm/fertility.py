"""Quality rules on tokeniser fertility.

Two public vocabularies are asked how well they fit a text: characters per
token of both, and of the one with byte fallback the share of tokens that are
bytes because no piece fits, and the entropy of the token counts.  Each script
has bands; a text outside its script's bands is rejected.  Plain counts of
words, symbols, repeated lines and repeated words come with it.  The texts of a
batch are measured together: distinct words are encoded once, and windows and
entropies are sorts over the whole batch.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import packing
from tessera.llm.common import Numbers, map_batches, text_bytes
from tessera.llm.packing import WordEncoder

#: Distinct words a worker remembers; past it the memory starts afresh.
CACHE_WORDS = 800_000
#: Words of a repeat window.
REPEAT_WINDOW = 8
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
#: First code points of blocks, and the script each block counts for.
_BLOCKS = [(0, "other"), (0x41, "latin"), (0x5B, "other"), (0x61, "latin"), (0x7B, "other"), (0xAA, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xE00, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "cjk"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0x20000, "cjk"), (0x30000, "other")]
_BLOCK_STARTS = np.array([b for b, _ in _BLOCKS])
SCRIPTS = sorted({s for _, s in _BLOCKS})
_BLOCK_SCRIPT = np.array([SCRIPTS.index(s) for _, s in _BLOCKS])

#: Per script: least and most characters per token, most byte-fallback share, least
#: token entropy in bits as a share of the most that so many tokens allow, and least
#: and most characters per token of the word vocabulary.
BANDS = {
    "latin": (1.35, 8.0, 0.10, 0.57, 1.3, 8.0),
    "greek": (0.5, 6.0, 0.30, 0.45, 0.4, 6.0),
    "cyrillic": (0.8, 7.0, 0.20, 0.45, 0.5, 7.0),
    "hebrew": (0.4, 6.0, 0.60, 0.40, 0.3, 6.0),
    "arabic": (0.4, 6.0, 0.60, 0.40, 0.3, 6.0),
    "indic": (0.3, 6.0, 0.80, 0.35, 0.2, 6.0),
    "cjk": (0.3, 4.0, 0.80, 0.40, 0.2, 4.0),
    "hangul": (0.3, 4.0, 0.80, 0.40, 0.2, 4.0),
    "other": (0.2, 8.0, 0.90, 0.35, 0.2, 8.0),
}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class WordPieces:
    """Pieces of words, encoded apart and remembered, with their number of tokens in the word vocabulary; ``rows`` numbers the words seen."""

    def __init__(self, path: str, encoder: WordEncoder):
        import sentencepiece

        self.encoder = encoder

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.index = Numbers()
        self.starts, self.sizes, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0
        self.others = np.zeros(1 << 16, np.int64)

    def learn(self, words: list[bytes]) -> None:
        pieces = self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, n = np.fromiter((i for p in pieces for i in p), np.int32, int(sizes.sum())), len(self.index)
        while n > len(self.starts):
            self.starts, self.sizes, self.others = (np.resize(x, 2 * len(x)) for x in (self.starts, self.sizes, self.others))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n - len(words) : n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n - len(words) : n] = sizes
        self.others[n - len(words) : n] = self.encoder.counts_of(words)
        self.used += len(ids)

    def rows(self, lists: list[list[bytes]]) -> np.ndarray:
        """The numbers of the words of all lists in a row."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        found = np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
        if self.index.new:
            self.learn(self.index.new)
            self.index.new = []
        return found

    def tokens(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def _pieces(path: str, words: str) -> WordPieces:
    return WordPieces(path, packing._encoder(words))


def repeated_words(rows: np.ndarray, owner: np.ndarray, texts: int, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Of each text, the words that lie in a window of words found at two places or more in it.

    ``rows`` are the words' numbers, text by text, and ``owner`` the text of each.
    """
    n = len(rows) - window + 1
    if n < 2:
        return np.zeros(texts, np.int64)
    mixed = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    keys = owner[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # windows of different texts never meet
    for i in range(window):
        keys ^= mixed[i : i + n]
        keys *= np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(31)
    inside = np.flatnonzero(owner[:n] == owner[window - 1 :])
    order = inside[np.argsort(keys[inside], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(rows) + 1, np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return np.bincount(owner[np.cumsum(edges)[:-1] > 0], minlength=texts)


def entropies(tokens: np.ndarray, owner: np.ndarray, texts: int, vocabulary: int) -> np.ndarray:
    """Entropy in bits of each text's token counts; 0 without a token."""
    n = np.bincount(owner, minlength=texts)
    keys = np.sort(owner * vocabulary + tokens)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(keys)])
    spread = np.bincount(keys[first] // vocabulary, counts * np.log2(counts), texts) if len(first) else np.zeros(texts)
    return np.where(n > 0, np.log2(np.maximum(n, 1)) - spread / np.maximum(n, 1), 0.0)


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script most letters belong to; 'other' without letters."""
    if text.isascii():
        return "latin" if text.lower() != text.upper() else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(_BLOCK_SCRIPT[np.searchsorted(_BLOCK_STARTS, points, "right") - 1], minlength=len(SCRIPTS))
    counts[SCRIPTS.index("other")] = 0
    return SCRIPTS[int(counts.argmax())] if counts.any() else "other"


def measure_all(pieces: WordPieces, texts: list[bytes]) -> dict[str, np.ndarray | list[str]]:
    """All counts and measures of each text."""
    lists, k = [t.split() for t in texts], len(texts)
    n_words = np.fromiter(map(len, lists), np.int64, k)
    rows, owner = pieces.rows(lists), np.repeat(np.arange(k), n_words)
    tokens, of = pieces.tokens(rows), np.repeat(owner, pieces.sizes[rows])
    n = np.bincount(of, minlength=k)
    decoded = [t.decode("utf-8", "replace") for t in texts]
    spaces = np.fromiter((len(t) - len(t.translate(None, _SPACES)) for t in texts), np.int64, k)
    chars = np.fromiter(map(len, decoded), np.int64, k) - spaces
    words = np.bincount(owner, pieces.others[rows], k)
    for i, text in enumerate(texts):
        if not pieces.encoder.plain(text):
            words[i] = len(pieces.encoder.encode(text))
    share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    return {
        "n_words": n_words, "word_chars": chars,
        "n_symbols": np.fromiter((len(t) - len(t.translate(None, _SYMBOLS)) for t in texts), np.int64, k),
        "n_dup_lines": np.fromiter(map(repeated_lines, texts), np.int64, k),
        "n_repeat_words": repeated_words(rows, owner, k),
        "n_tokens": n, "chars_per_token": share(chars, n), "byte_share": share(np.bincount(of, pieces.is_byte[tokens], k), n),
        "token_entropy": entropies(tokens, of, k, len(pieces.is_byte)), "chars_per_word_token": share(chars, words), "script": [script_of(t) for t in decoded],
    }


def accepts(m: dict, bands: dict = BANDS) -> np.ndarray:
    """True where the measures lie inside the bands of the text's script."""
    low, high, most_bytes, least_entropy, least_word, most_word = np.array([bands[x] for x in m["script"]], float).reshape(-1, 6).T
    room = np.where(m["n_tokens"] > 1, np.log2(np.clip(m["n_tokens"], 2, 2048)), 1.0)
    fits = (low <= m["chars_per_token"]) & (m["chars_per_token"] <= high) & (least_word <= m["chars_per_word_token"]) & (m["chars_per_word_token"] <= most_word)
    return fits & (m["byte_share"] <= most_bytes) & (m["token_entropy"] >= least_entropy * room)


_FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_tokens": "long", "chars_per_token": "double", "byte_share": "double", "token_entropy": "double", "chars_per_word_token": "double", "script": "string", "base_failed": "boolean", "kept": "boolean"}


def fertility_rules(docs: DataFrame, vocabulary: str | None = None, bands: dict | None = None, words: str | None = None) -> DataFrame:
    """Counts, fertility measures and verdict of every text, in one pass without a shuffle.

    base_failed: under 20 words, or over 30 % of the words in repeated windows.
    kept: not base_failed, and inside the bands of the text's script.  Null
    texts have no words and fail.  Repeated rows give repeated rows, null
    doc_ids stay null, other columns are ignored, an empty table gives none.
    ``vocabulary`` is the file with byte fallback, ``words`` the other.
    """
    path, limits, second = vocabulary or default_vocabulary(), bands or BANDS, words or packing.default_vocabulary()
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches):
        pieces = _pieces(path, second)
        for batch in batches:
            m = measure_all(pieces, batch.column(1).to_pylist())
            m["base_failed"] = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            m["kept"] = ~m["base_failed"] & accepts(m, limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[c], kinds[k]) for c, k in _FIELDS.items())], ["doc_id", *_FIELDS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", text_bytes()), run, f"doc_id {kind}, " + ", ".join(f"{c} {k}" for c, k in _FIELDS.items()))
