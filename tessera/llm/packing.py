"""Sequence packing by minimum bin slack.

Documents become token ids, are cut at the window, and only what remains of
each is packed.  Remainders are known by their length alone, so the packing is
planned on the histogram of lengths, whose size is the window's: take the
longest length left, find by a bitset subset-sum over the other lengths (with
their counts) the multiset that brings the window closest to full, backtrack
its counts, and repeat the pattern as often as the histogram allows.  Pieces
then find their place from their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe_count import byte_alphabet
from tessera.llm.common import Numbers, map_batches, materialize, text_bytes

WINDOW = 4096
#: The id that ends each document.
END_ID = 2
#: Distinct words a worker remembers; past it the memory starts afresh.
CACHE_WORDS = 1_000_000
#: Longer lists of pieces of one length are dealt by hash into slices of about so many, or of so small a part of all pieces, and each slice is ranked for itself.
SLICE_PIECES, MOST_SLICES = 256, 100_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words whose pre-tokens are plain to see: Latin letters without those whose lower case changes length, digits, printable ASCII but the apostrophe.
_LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017f"
_EASY = re.compile(rf"[{_LETTERS}0-9!-&(-/:-@\[-`{{-~]+")
_PRETOKENS = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class WordEncoder:
    """Ids of whole texts.

    The vocabulary drops white space and case and no token crosses white space,
    so the words between ASCII white space are encoded apart and remembered.
    Words whose pre-tokens are plain to see go to the library's model piece by
    piece, others to the library.  Texts with a marker of special tokens, or
    with combining marks, whose composition can depend on case, go there whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        alphabet = byte_alphabet()
        self.to_bytes = {b: alphabet[b] for b in range(128, 256)}
        self._clear()

    def _clear(self) -> None:
        self.index = Numbers()
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, words: list[bytes]) -> None:
        tokenize, easy, pretokens, table = self.model.tokenize, _EASY.fullmatch, _PRETOKENS.findall, self.to_bytes
        ids, sizes, rest = array("I"), array("q"), []
        for n, word in enumerate(words):
            before = len(ids)
            if word.isalpha():  # bytes: true of ASCII letters alone
                ids.extend([t.id for t in tokenize(word.decode())])
            else:
                text = word.decode("utf-8", "replace")
                if easy(text):
                    for part in pretokens(text.lower()):
                        ids.extend([t.id for t in tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(table))])
                else:
                    rest.append((n, text))
            sizes.append(len(ids) - before)
        ids, sizes = np.array(ids, np.uint32), np.array(sizes, np.int64)
        if rest:
            at, texts = zip(*rest, strict=True)
            found, counts = self._by_library(texts)
            at = np.array(at)
            places = np.repeat(np.cumsum(sizes)[at], counts)
            sizes[at] = counts
            ids = np.insert(ids, places, found)
        self._store(ids, sizes)

    def _by_library(self, texts: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text); texts are joined, for a call costs more than a word."""
        ids, counts = [], []
        for at in range(0, len(texts), 256):
            some = texts[at : at + 256]
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            begun = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(encoded.offsets))
            counts.append(np.bincount(np.searchsorted(ends, begun, "right"), minlength=len(some)))
            ids.append(np.array(encoded.ids, np.uint32))
        return np.concatenate(ids), np.concatenate(counts)

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.index)
        while n > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n - len(sizes) : n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n - len(sizes) : n] = sizes
        self.used += len(ids)

    def plain(self, text: bytes) -> bool:
        """True if the ids of a text are those of its words."""
        return not (b"<|" in text or b"\xcc" in text or b"\xcd" in text)

    def counts_of(self, words: list[bytes]) -> np.ndarray:
        """How many ids each word has, within plain texts."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        places = self._places(map(bytes.lower, words), len(words))  # learning may replace the array
        return self.sizes[places]

    def _places(self, words, n: int) -> np.ndarray:
        places = np.fromiter(map(self.index.__getitem__, words), np.int64, n)
        if self.index.new:
            self._learn(self.index.new)
            self.index.new = []
        return places

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text.  Words of all texts are looked up together."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        whole = [not self.plain(t) for t in texts]
        lists = [[] if w else t.lower().split() for t, w in zip(texts, whole, strict=True)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        n = int(counts.sum())
        places = self._places(chain.from_iterable(lists), n)
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[places] - ends + sizes, sizes) + np.arange(ends[-1] if n else 0)]
        cuts = np.r_[0, ends][np.cumsum(counts)]
        out = np.split(flat, cuts[:-1]) if texts else []
        for i, w in enumerate(whole):
            if w:
                out[i] = np.array(self.tokenizer.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return out

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut_pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids cut at every ``window`` ids."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, found in enumerate(encoder.encode_all(batch.column(1).to_pylist())):
                ids = np.append(found, np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", text_bytes()), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is closest to ``room`` from below.

    One bitset per item holds the sums that the items so far can reach; counts
    are split into powers of two, and the choice is read backwards.
    """
    items, reach, full = [], [1], (1 << room + 1) - 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        left = min(int(counts[length]), room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            items.append((length, take))
            reach.append(reach[-1] | reach[-1] << length * take & full)
            left -= take
            take *= 2
        if reach[-1] >> room & 1:
            break
    best, chosen = reach[-1].bit_length() - 1, {}
    for (length, take), before in zip(reversed(items), reversed(reach[:-1]), strict=True):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= length * take
    return chosen


def plan_patterns(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(lengths of a sequence with their counts, how many such sequences), covering the histogram exactly."""
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    plan, longest = [], window
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return plan
        counts[longest] -= 1
        chosen = fullest(counts, window - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(int(counts[length]) // n for length, n in chosen.items())
        for length, n in chosen.items():
            counts[length] -= n * times
        plan.append((chosen, times))


def placing_table(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks: the pieces of ``length`` from rank ``first`` on go ``per`` to a sequence from ``sequence`` on, from ``offset`` there."""
    rows, ranks, sequence = [], {}, 0
    for chosen, times in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            per, first = chosen[length], ranks.get(length, 0)
            rows.append((length, first, sequence, per, offset))
            ranks[length] = first + per * times
            offset += per * length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "first": table[:, 1], "sequence": table[:, 2], "per": table[:, 3], "offset": table[:, 4]}


def pack_documents(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Null texts are empty: a document of one id, the end.  Repeated rows are
    packed each, null doc_ids stay null, other columns are ignored, an empty
    table gives no rows.  Writes the pieces once; the driver holds a histogram
    of ``window`` counts, the plan made from it, and at most MOST_SLICES counts
    more.
    """
    pieces = materialize(cut_pieces(docs, window, vocabulary).withColumn("piece", F.xxhash64("doc_id", "start", "ids_crc32")), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    per_slice = max(SLICE_PIECES, sum(histogram.values()) // MOST_SLICES)
    long = [{"length": length, "slices": -(-n // per_slice)} for length, n in histogram.items() if n > per_slice]
    spark = docs.sparkSession
    slices = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(long)), "array<struct<length:bigint,slices:bigint>>")))
    slice_of = F.pmod(F.col("piece"), F.coalesce(F.col("slices"), F.lit(1).cast("long")))
    sliced = pieces.join(F.broadcast(slices), "length", "left").withColumn("slice", slice_of).drop("slices")
    # A row for a length and a slice: at most ``window`` and MOST_SLICES.
    sizes = sorted(tuple(r) for r in sliced.groupBy("length", "slice").agg(F.count("*").alias("n")).collect())
    length, part, n = np.array(sizes, np.int64).reshape(-1, 3).T
    before = np.cumsum(n) - n
    before -= before[np.searchsorted(length, length)]  # within the length
    table = placing_table(plan_patterns(histogram, window))
    first_row = np.searchsorted(table["length"], np.arange(window + 2))
    held = spark.sparkContext.broadcast((length << 32 | part, before, table, first_row))

    order = Window.partitionBy("length", "slice").orderBy("piece", "doc_id", "start", "ids_crc32")
    ranked = sliced.withColumn("rank", F.row_number().over(order) - 1).drop("piece")

    def run(batches):
        keys, before, table, first_row = held.value
        for batch in batches:
            length, part, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "slice", "rank"))
            rank = rank + before[np.searchsorted(keys, length << 32 | part)]
            at = np.empty(len(rank), np.int64)
            for value in np.unique(length):  # the last run of this length that starts at or before the rank
                here = length == value
                low, high = first_row[value], first_row[value + 1]
                at[here] = low + np.searchsorted(table["first"][low:high], rank[here], "right") - 1
            inside = rank - table["first"][at]
            per = table["per"][at]
            sequence = table["sequence"][at] + inside // per
            offset = table["offset"][at] + inside % per * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_batches(ranked, run, schema)
