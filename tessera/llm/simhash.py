"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of
their 8 bytes.  The index lists fingerprints by the bytes they hold at given
positions; within a list, pairs tally their equal positional bytes, pairs with
5 or more are kept, and the bits of those are compared.  Lists of single bytes
would have 1/256 of all fingerprints each, so their pairs grow with the square
of the corpus; a list here stands for three positions at once, and the eight
triples used are such that any 5 positions of 8 contain one of them.  For very
many fingerprints fourteen quadruples do the same with shorter lists.

Exact copies are merged first.  A list longer than BLOCK is dealt as blocks,
and every pair of blocks meets in some task, so no list is cut or sampled.  A
task keeps links in its memory only and returns a spanning forest of them: at
most a row per fingerprint, whatever the number of links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_skewed, map_batches, materialize, text_bytes
from tessera.llm.components import connected_components

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
#: Positional bytes that linked fingerprints share at least.
MIN_SHARED = 8 - MAX_BITS
#: Three of four positions in either half: five positions of eight put three into one half.
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
#: The halves, and two positions of each half that are paired alike: any two positions of a half are paired in one of three ways, and any three hold a pair of each way.
_PAIRINGS = (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))
QUADS = [(0, 1, 2, 3), (4, 5, 6, 7), *((*a, *(p + 4 for p in b)) for way in _PAIRINGS for a in way for b in way)]
#: Distinct fingerprints up to which triples are the keys: lists then have four entries on average.  Beyond, quadruples keep lists short.
TRIPLE_PRINTS = 1 << 26
#: Fingerprints of one list that a task compares with each other at once.
BLOCK = 2048
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256)[None, :]
_BYTE_SHIFTS = np.arange(8, dtype=np.uint64) * np.uint64(8)


def fingerprint(text: bytes) -> int:
    """The SimHash of a text: a bit is 1 if set in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    stops = ends[min(SHINGLE_WORDS, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _BITS).ravel() * 2 > n
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long, of every row's whole text; 0 for null and empty."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", text_bytes()), run, f"doc_id {kind}, fp long")


def _forest(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (left, right) between places in ``values``: each place with its least root."""
    root = np.arange(len(values))
    while True:
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        moved = low < high
        if not moved.any():
            break
        np.minimum.at(root, high[moved], low[moved])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    tied = np.flatnonzero(root != np.arange(len(values)))
    return values[tied], values[root[tied]]


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then verification: equal positional bytes, then differing bits."""
    apart = a ^ b
    shared = np.zeros(apart.shape, np.uint8)
    for shift in _BYTE_SHIFTS:
        shared += ((apart >> shift) & np.uint64(255)) == 0
    near = shared >= MIN_SHARED
    near[near] = np.bitwise_count(apart[near]) <= MAX_BITS
    return near


def link_list(values: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of a list, as a forest.  side: 0 within a block, else 1 and 2, and only pairs across count."""
    first, second = (np.flatnonzero(side != 2), np.flatnonzero(side != 1))
    lefts, rights = [], []
    step = max(1, (1 << 20) // max(1, len(second)))
    for at in range(0, len(first), step):
        some = first[at : at + step]
        i, j = np.nonzero(_linked(values[some][:, None], values[second][None, :]))
        i, j = some[i], second[j]
        keep = i != j
        lefts.append(i[keep])
        rights.append(j[keep])
    return _forest(values, np.concatenate(lefts), np.concatenate(rights)) if lefts else (values[:0], values[:0])


def _link_sorted(batches):
    """Lists arrive in order of their key; a list may span batches.  Lists of two and more are linked."""
    held: list[pa.RecordBatch] = []

    def flush(table):
        key, fp, side = (table.column(c).to_numpy() for c in ("list", "fp", "side"))
        fp = fp.view(np.uint64)
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        sizes = np.diff(edges)
        us, vs = [], []
        pairs = edges[:-1][(sizes == 2)]  # most lists: all at once
        if len(pairs):
            a, b = fp[pairs], fp[pairs + 1]
            near = _linked(a, b) & (a != b)
            us.append(np.maximum(a, b)[near])
            vs.append(np.minimum(a, b)[near])
        for start, size in zip(edges[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            u, v = link_list(fp[start : start + size], side[start : start + size])
            us.append(u)
            vs.append(v)
        u, v = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = batch.column(batch.schema.get_field_index("list")).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))  # the last list may go on
        if cut == 0 or sum(b.num_rows for b in held) < 20_000:
            continue
        tail = held[-1].slice(cut)
        held[-1] = held[-1].slice(0, cut)
        table = pa.Table.from_batches(held).combine_chunks()
        held = [tail]
        if table.num_rows:
            yield flush(table)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield flush(table)


def index_lists(distinct: DataFrame, keys: list[tuple[int, ...]] = TRIPLES) -> DataFrame:
    """(list, fp, side): each fingerprint under the bytes at every set of positions in ``keys``, long lists dealt as pairs of blocks."""
    entries = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(n).cast("long").alias("table"), F.expr(" | ".join(f"shiftleft(shiftrightunsigned(fp, {8 * p}) & 255, {8 * k})" for k, p in enumerate(t))).alias("bytes"))
        for n, t in enumerate(keys)
    ])).alias("e")).select("fp", (F.shiftleft("e.table", 8 * len(keys[0])) + F.col("e.bytes")).alias("key"))
    # Lists past a block are few: what they hold is counted by key, and only their keys are joined.
    long_lists = entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = entries.join(long_lists, "key", "left")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # Block i meets each block j: pair (i, j) with i < j takes both, and (i, i) is the block alone.
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(block, j).alias("low"), F.greatest(block, j).alias("high"),
        F.when(j == block, 0).when(block < j, 1).otherwise(2).alias("side")))
    one = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side")))
    return dealt.select("fp", "key", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(others)).alias("m")).select(
        F.when(F.col("m.low") + F.col("m.high") + F.col("m.side") == 0, F.col("key") * 2).otherwise(F.xxhash64("key", "m.low", "m.high").bitwiseOR(F.lit(1))).alias("list"),
        "fp", F.col("m.side").cast("int").alias("side"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    component_id is the least doc_id among the rows whose fingerprints can be
    reached by links of at most 3 differing bits; null only if all of them are
    null.  Null and empty texts have fingerprint zero, linked like any other.
    Repeated rows give repeated rows; other columns are ignored.  Writes the
    fingerprints and the links to the shared folder; nothing comes to the
    driver but counts.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    size = distinct.agg(F.count("*").alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    lists = index_lists(distinct, TRIPLES if size["prints"] <= TRIPLE_PRINTS else QUADS)
    ordered = lists.repartition("list").sortWithinPartitions("list", "fp", "side")
    links = map_batches(ordered.select("list", "fp", "side"), _link_sorted, "u long, v long", rows=8192)
    roots = connected_components(links).withColumnRenamed("node", "fp")
    # Only distinct fingerprints meet their roots, and rows their fingerprint: many may share either.
    tied = materialize(distinct.join(roots, "fp").select("fp", "root", "first"), "roots")
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = join_skewed(tied.select("fp", "root"), least, "root", "n", size["prints"]).select("fp", "component_id", F.lit(True).alias("tied"))
    known = distinct.join(named, "fp", "left").select("fp", F.when(F.col("tied"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"), "n")
    rows = join_skewed(prints, materialize(known, "components"), "fp", "n", size["rows"])
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
