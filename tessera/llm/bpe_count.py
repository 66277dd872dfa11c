"""Token counts of a byte-level BPE by heap-and-linked-list merging.

The symbols of a pre-token form a doubly linked list.  A heap holds the
adjacent pairs by merge rank, then place; the lowest is popped, its two symbols
become one, and the pairs with the new neighbours are pushed.  The number of
tokens is the number of first symbols less the merges; no ids are made.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, text_bytes

#: Distinct chunks a worker remembers; past it the memory starts afresh.
CACHE_CHUNKS = 1_000_000
#: Fixed value: the published pattern that splits text before byte-level merges.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = -1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes bytes that don't print as the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class BpeCounter:
    """Counts tokens as the vocabulary's library does, special tokens in texts included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        number = {alphabet[b]: b for b in range(256)}  # a symbol is held as a small number while merging
        self.pair: dict[int, int] = {}  # two symbols -> rank, then the joined symbol in the low 20 bits
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            joined = number.setdefault(left + right, len(number))
            self.pair[number[left] << 20 | number[right]] = rank << 20 | joined
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(PRETOKEN)
        self.tokens: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merge_count(self, data: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(data)
        get, bits = self.pair.get, n.bit_length()
        heap = [hit << bits | i for i, (a, b) in enumerate(zip(data, data[1:])) if (hit := get(a << 20 | b))]
        if not heap:
            return n
        symbols, before, after, count = list(data), list(range(-1, n - 1)), list(range(1, n + 1)), n
        heapq.heapify(heap)
        pop, push, place = heapq.heappop, heapq.heappush, (1 << bits) - 1
        while heap:
            top = pop(heap)
            i = top & place
            j = after[i]
            a = symbols[i]
            if a is None or j == n or get(a << 20 | symbols[j]) != top >> bits:
                continue  # one of the two has merged meanwhile
            count -= 1
            symbols[i] = joined = top >> bits & 0xFFFFF
            symbols[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if hit := get(joined << 20 | symbols[k]):
                    push(heap, hit << bits | i)
            h = before[i]
            if h >= 0 and (hit := get(symbols[h] << 20 | joined)):
                push(heap, hit << bits | h)
        return count

    def _plain(self, text: str) -> int:
        total, known = 0, self.tokens
        for token in self.split.findall(text):
            n = known.get(token)
            if n is None:
                if len(known) >= CACHE_CHUNKS:
                    known.clear()
                n = self.merge_count(token.encode())
                if len(token) < 64:
                    known[token] = n
            total += n
        return total

    def whole(self, text: str) -> int:
        """Tokens of a text: specials are one each and split what is around them."""
        if self.special is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += 1 + self._plain(text[at : m.start()])
            at = m.end()
        return total + self._plain(text[at:])

    def _chunk(self, chunk: str, first: bool) -> int:
        """A chunk between single spaces; _ODD if its tokens depend on what is around it."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return _ODD
        return self.whole(chunk if first else " " + chunk)

    def count(self, text: str) -> int:
        """Tokens of a text.

        A space between two other characters that aren't white space always
        opens a token, so such chunks are counted apart and remembered; texts
        with other spaces are counted whole.
        """
        if not text:
            return 0
        head, *rest = text.split(" ")
        total = self._chunk(head, True)
        if total == _ODD:
            return self.whole(text)
        known = self.chunks
        counts = list(map(known.get, rest))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    chunk = rest[i]
                    n = known.get(chunk)
                    if n is None:
                        if len(known) >= CACHE_CHUNKS:
                            known.clear()
                        n = self._chunk(chunk, False)
                        if len(chunk) < 64:
                            known[chunk] = n
                    counts[i] = n
        if counts and min(counts) < 0:
            return self.whole(text)
        return total + sum(counts)


@lru_cache(maxsize=2)
def _counter(path: str) -> BpeCounter:
    return BpeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text, in one pass without a shuffle.

    Null texts count as empty (0 bytes, 0 tokens).  Repeated rows give repeated
    rows, null doc_ids stay null, other columns are ignored.  ``vocabulary`` is
    the path of a byte-level BPE file that every worker can open.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [counter.count(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = map_batches(docs.select("doc_id", text_bytes()), run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
