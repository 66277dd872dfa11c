"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over token positions: places marked 0 are ignored, so a
hash matches although the tokens there differ.  Hashes of the benchmark items
and of the training texts are joined; around each hit the item is laid against
the text on the hit's diagonal and the overlap is verified token by token,
substitutions allowed.  The masks are such that every overlap the verifier
accepts holds a hit: an item under 8 tokens counts only if whole, and has one
hash of all its tokens.

Training hashes are met first with a bitmap of the benchmark's hashes, whose
size is bounded whatever the benchmark's; only stretches of text around hashes
that pass are moved, as far as the items with such hashes reach, and the join
decides.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Numbers, join_small, map_batches, materialize, text_bytes

#: Fixed masks of weight 6: 1 reads a token, 0 ignores it.
SEEDS = ("1111011", "110010111", "11011101", "1111000011", "10101111")
#: An overlap needs this many equal tokens, or fewer that are half of the item; and this share of its length equal.
MIN_TOKENS, LEAST_TOKENS, MIN_ITEM, MIN_SHARE = 13, 8, 0.5, 0.8
#: Bits of the bitmap: 64 or more a hash within these powers of two (32 MB at most).  A hash sets the bits that three parts of it name.
LEAST_BITS, MOST_BITS = 16, 28
_PARTS = (np.uint64(36), np.uint64(18), np.uint64(0))
#: High bits of a hash that name its place in the table of reaches.
REACH_BITS = 16
#: Distinct words a worker remembers; past it the memory starts afresh.
CACHE_WORDS = 600_000
#: Tokens hashed at once, so that they stay in the processor's cache.
BLOCK = 1 << 15
#: Letters that are written without spaces are a token each.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}"
_WORD = regex.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[\p{{L}}\p{{N}}\p{{M}}])+")
_PUNCTUATION = b".,;:!?()[]{}\"'*-"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93], np.uint64)


class Tokens:
    """Hashes of lower-cased words; white-space words are numbered and remembered with the words they hold."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.index = Numbers()
        self.starts, self.sizes, self.hashes, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 17, np.uint64), 0

    def _learn(self, words: list[bytes]) -> None:
        digest, find = xxhash.xxh64_intdigest, _WORD.findall
        hashes, sizes = [], []
        for word in words:
            core = word.strip(_PUNCTUATION)
            if core.isalnum():  # bytes: true of ASCII letters and digits alone
                hashes.append(digest(core))
                sizes.append(1)
            else:
                found = find(core.decode("utf-8", "replace").lower())
                hashes += [digest(w.encode()) for w in found]
                sizes.append(len(found))
        n, sizes = len(self.index), np.array(sizes, np.int64)
        while n > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(hashes) > len(self.hashes):
            self.hashes = np.resize(self.hashes, 2 * len(self.hashes))
        self.hashes[self.used : self.used + len(hashes)] = np.array(hashes, np.uint64)
        self.starts[n - len(sizes) : n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n - len(sizes) : n] = sizes
        self.used += len(hashes)

    def of_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words of all texts in a row, where each text begins and the last ends)."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        lists = [t.lower().split() for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        n = int(counts.sum())
        places = np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, n)
        if self.index.new:
            self._learn(self.index.new)
            self.index.new = []
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        flat = self.hashes[np.repeat(self.starts[places] - ends + sizes, sizes) + np.arange(ends[-1] if n else 0)]
        return flat, np.r_[0, np.r_[0, ends][np.cumsum(counts)]].astype(np.int64)

    def of(self, text: bytes) -> np.ndarray:
        return self.of_all([text])[0]


@lru_cache(maxsize=1)
def _tokens() -> Tokens:
    return Tokens()


def seed_hashes(tokens: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash under a mask at every place where it fits."""
    n = max(0, len(tokens) - len(mask) + 1)
    keys = np.full(n, number + 1, np.uint64)
    for k, offset in enumerate(i for i, c in enumerate(mask) if c == "1"):
        keys ^= tokens[offset : offset + n]
        keys *= _MULTIPLIERS[k]
        keys ^= keys >> np.uint64(32)
    return keys


def masks_for(short: list[int]) -> list[tuple[int, str]]:
    """(number, mask): the seeds, and a mask of ones for each length in ``short``, the lengths under LEAST_TOKENS that items have."""
    return [*enumerate(SEEDS), *((len(SEEDS) + n, "1" * n) for n in short)]


def item_hashes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of an item: under every seed, or of the whole if it is short."""
    own = masks_for([len(tokens)])[len(SEEDS) :] if 0 < len(tokens) < LEAST_TOKENS else masks_for([])
    found = [seed_hashes(tokens, mask, number) for number, mask in own]
    return np.concatenate(found), np.concatenate([np.arange(len(f)) for f in found])


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item, item_id, n_tokens, tokens, hashes, places: every distinct item once; ``item`` tells items apart."""

    def run(batches):
        for batch in batches:
            tokens = [_tokens().of(t) for t in batch.column(2).to_pylist()]
            found = [item_hashes(t) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in tokens], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary()),
                 pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))],
                ["item", "item_id", "n_tokens", "tokens", "hashes", "places"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.select(F.xxhash64("item_id", F.coalesce("text", F.lit(""))).alias("item"), "item_id", text_bytes()).dropDuplicates(["item"])
    return map_batches(rows, run, f"item long, item_id {kind}, n_tokens long, tokens binary, hashes array<bigint>, places array<bigint>")


class HashFilter:
    """The bitmap of the benchmark's hashes, and how far left and right of a hash an item with such a one reaches at most."""

    def __init__(self, bits: int):
        self.bits, self.bitmap = bits, np.zeros(1 << bits - 3, np.uint8)
        self.left, self.right = np.zeros(1 << REACH_BITS, np.int32), np.zeros(1 << REACH_BITS, np.int32)

    def _places(self, keys: np.ndarray, part: int) -> np.ndarray:
        return keys >> _PARTS[part] & np.uint64((1 << self.bits) - 1)

    def add(self, keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        for part in range(len(_PARTS)):
            places = self._places(keys, part)
            np.bitwise_or.at(self.bitmap, places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))
        named = keys >> np.uint64(64 - REACH_BITS)
        np.maximum.at(self.left, named, left.astype(np.int32))
        np.maximum.at(self.right, named, right.astype(np.int32))

    def merge(self, other: HashFilter) -> None:
        self.bitmap |= other.bitmap
        self.left, self.right = np.maximum(self.left, other.left), np.maximum(self.right, other.right)

    def passing(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys whose three bits are set and whose high bits an item's hash has: others reach nowhere, and would make empty stretches."""
        at = None
        for part in range(len(_PARTS)):
            places = self._places(keys if at is None else keys[at], part)
            held = np.flatnonzero(self.bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1)
            at = held if at is None else at[held]
        return at[self.right[keys[at] >> np.uint64(64 - REACH_BITS)] > 0]


def build_filter(items: DataFrame, count: int) -> HashFilter:
    """The filter of all items' hashes: at most 16 tasks make theirs, and the driver joins one after another."""
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * max(1, count) - 1).bit_length()))

    def run(batches):
        own = HashFilter(bits)
        for batch in batches:
            for n, hashes, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                place = np.array(places, np.int64)
                own.add(np.array(hashes, np.int64).view(np.uint64), place, n - place)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (own.bitmap, own.left, own.right)], ["bitmap", "left", "right"])

    whole = HashFilter(bits)
    for row in map_batches(items.select("n_tokens", "hashes", "places").coalesce(16), run, "bitmap binary, left binary, right binary").toLocalIterator():
        other = HashFilter(LEAST_BITS)
        other.bitmap, other.left, other.right = np.frombuffer(row["bitmap"], np.uint8), np.frombuffer(row["left"], np.int32), np.frombuffer(row["right"], np.int32)
        whole.merge(other)
    return whole


def find_stretches(tokens: np.ndarray, edges: np.ndarray, masks: list[tuple[int, str]], held: HashFilter) -> tuple[np.ndarray, ...]:
    """(first token, end token, first hit) of each stretch, then (place, hash) of the hits in their order.

    ``edges`` are where texts begin in ``tokens`` and where the last ends; a
    stretch lies in one text and holds every item laid on one of its hits.
    """
    at, keys = [], []
    for number, mask in masks:
        for low in range(0, len(tokens) - len(mask) + 1, BLOCK):
            hashes = seed_hashes(tokens[low : low + BLOCK + len(mask) - 1], mask, number)
            there = held.passing(hashes)
            places = low + there
            text = np.searchsorted(edges, places, "right")
            inside = places + len(mask) <= edges[text]  # a mask over the end of a text reads the next
            at.append(places[inside])
            keys.append(hashes[there[inside]])
    at, keys = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((at, np.int64), (keys, np.uint64)))
    text, named = np.searchsorted(edges, at, "right"), keys >> np.uint64(64 - REACH_BITS)
    low, high = np.maximum(at - held.left[named], edges[text - 1]), np.minimum(at + held.right[named], edges[text])
    order = np.argsort(low, kind="stable")
    at, keys, low, high = at[order], keys[order], low[order], high[order]
    far = np.maximum.accumulate(high) if len(high) else high
    first = np.flatnonzero(np.r_[True, low[1:] >= far[:-1]]) if len(low) else np.zeros(0, np.int64)
    return low[first], far[np.r_[first[1:], len(far)] - 1] if len(first) else far, first, at, keys


def _stretches(docs: DataFrame, held, masks: list[tuple[int, str]]) -> DataFrame:
    """doc_id, copy, start, tokens, hits: stretches of text around hashes that the filter holds."""

    def run(batches):
        for batch in batches:
            tokens, edges = _tokens().of_all(batch.column(1).to_pylist())
            begin, end, first, at, keys = find_stretches(tokens, edges, masks, held.value)
            text = np.searchsorted(edges, begin, "right") - 1
            counts = np.diff(np.r_[first, len(at)])
            hits = pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(at - np.repeat(begin, counts))], ["hash", "pos"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)].astype(np.int32)), hits)
            parts = pa.array([tokens[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
            rows = pa.array(text.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(begin - edges[text]), parts, lists], ["doc_id", "copy", "start", "tokens", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_bytes(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("copy"))
    return map_batches(rows, run, f"doc_id {kind}, copy long, start long, tokens binary, hits array<struct<hash:bigint,pos:bigint>>")


def best_run(equal: np.ndarray, item: int) -> tuple[int, int, int]:
    """(equal tokens, length, start) of the verified overlap with the most equal tokens, or zeros.

    Every run that begins and ends on an equal token is looked at: from the
    i-th to the j-th equal token, at places p, the share is enough if v_j >=
    v_i - k, where v = n * i - d * p for the share d / n and k = n - d.  The
    farthest i of each j is found in the running minimum of v.  Of equally many
    tokens the shortest and then the first run counts.
    """
    places = np.flatnonzero(equal)
    if not len(places):
        return 0, 0, 0
    share = Fraction(str(MIN_SHARE))
    v = share.denominator * np.arange(len(places)) - share.numerator * places
    first = np.searchsorted(-np.minimum.accumulate(v), -(v + share.denominator - share.numerator))
    counts = np.arange(len(places)) - first + 1
    n = int(counts.max())
    if not (n >= MIN_TOKENS or n >= min(LEAST_TOKENS, item) and n >= MIN_ITEM * item):
        return 0, 0, 0
    ends = np.flatnonzero(counts == n)
    lengths = places[ends] - places[first[ends]] + 1
    best = int(lengths.argmin())
    return n, int(lengths[best]), int(places[first[ends[best]]])


def _verify(batches):
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        kept, found = [], []
        for i, (text, item, diagonals) in enumerate(zip(*(columns[c].to_pylist() for c in ("tokens", "item_tokens", "diagonals")), strict=True)):
            text, item = np.frombuffer(text, np.uint64), np.frombuffer(item, np.uint64)
            best = (0, 0, 0)
            for diagonal in diagonals:
                a, b = max(0, diagonal), min(len(text), diagonal + len(item))
                n, length, start = best_run(text[a:b] == item[a - diagonal : b - diagonal], len(item))
                best = max(best, (n, -length, -(a + start)))
            if best[0]:
                kept.append(i)
                found.append((best[0], -best[1], -best[2]))
        take = pa.array(kept, pa.int32())
        matched, length, at = (pa.array([f[k] for f in found], pa.int64()) for k in range(3))
        yield pa.RecordBatch.from_arrays([*(columns[c].take(take) for c in ("doc_id", "copy", "start", "item", "item_id", "n_tokens")), matched, length, at], ["doc_id", "copy", "start", "item", "item_id", "n_tokens", "matched", "length", "at"])


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_tokens, matched, length, start, similarity: the best overlap of each text with each item.

    Words are lower-cased runs of letters, digits and marks; of scripts without
    spaces every letter is one.  An overlap has at least 13 equal tokens, or 8
    (the whole item if shorter) that are half the item, and they are 0.8 of its
    length; every such overlap is found.  similarity is equal tokens over the
    item's tokens; start counts the text's words from 0.  Items without a word
    are found in no text.  Null texts and items hold nothing; rows equal in
    doc_id and text give one row an item, and so do items equal in item_id and
    text; null ids stay null.  Other columns are ignored.
    """
    spark = docs.sparkSession
    items = materialize(benchmark_items(benchmark), "benchmark-items")
    size = items.agg(
        F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("hashes"), F.coalesce(F.sum(F.length("tokens") + 64), F.lit(0)).alias("bytes"),
        F.array_sort(F.collect_set(F.when(F.col("n_tokens").between(1, LEAST_TOKENS - 1), F.col("n_tokens")))).alias("short"),
    ).first()
    held = spark.sparkContext.broadcast(build_filter(items, int(size["hashes"])))
    stretches = materialize(_stretches(docs, held, masks_for(list(size["short"]))), "stretches")
    hits = stretches.select("copy", "start", F.explode("hits").alias("h")).select("copy", "start", "h.hash", "h.pos")
    keys = items.select("item", F.explode(F.arrays_zip("hashes", "places")).alias("k")).select("item", F.col("k.hashes").alias("hash"), F.col("k.places").alias("tpos"))
    met = join_small(hits, keys, ["hash"], 24 * int(size["hashes"])).groupBy("copy", "start", "item").agg(F.collect_set(F.col("pos") - F.col("tpos")).alias("diagonals"))
    laid = met.join(stretches.select("doc_id", "copy", "start", "tokens").dropDuplicates(["copy", "start"]), ["copy", "start"])
    laid = join_small(laid, items.select("item", "item_id", "n_tokens", F.col("tokens").alias("item_tokens")), ["item"], int(size["bytes"]))
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, copy long, start long, item long, item_id {item_kind}, n_tokens long, matched long, length long, at long"
    verified = map_batches(laid, _verify, schema)
    best = F.max_by(F.struct("item_id", "n_tokens", "matched", "length", (F.col("start") + F.col("at")).alias("start")), F.struct("matched", -F.col("length"), -(F.col("start") + F.col("at"))))
    return verified.groupBy("doc_id", "copy", "item").agg(best.alias("b")).select(
        "doc_id", "b.item_id", "b.n_tokens", "b.matched", "b.length", "b.start",
        F.round(F.col("b.matched") / F.col("b.n_tokens"), 6).alias("similarity"))


def contaminated_ids(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id of the texts with a verified overlap, each once."""
    return find_overlaps(docs, benchmark).select("doc_id").distinct()
