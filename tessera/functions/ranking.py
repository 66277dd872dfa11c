"""Ranking formulas: field-weighted BM25 with proximity, phrase and entropy parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults of a search.
DEFAULTS = {
    "k1": 1.2, "b": 0.75, "weights": {"title": 2.0, "content": 1.0}, "alpha": 0.5, "lambda": 0.5,
    "segments": 16, "idf_scale": 5.0, "phrase_boost": 1.5, "gamma": 0.5,
}


def idf(total: Column, df: Column) -> Column:
    """ln(1 + max(0, (N - df + .5) / (df + .5))); 0 for an unseen term."""
    return F.when(df == 0, 0.0).otherwise(F.log1p(F.greatest(F.lit(0.0), (total - df + 0.5) / (df + 0.5))))


def normalized_tf(tf: Column, length: Column, average: Column, b: float | Column, gamma_entropy: Column | float = 0.0) -> Column:
    """tf over its length norm; a given entropy term makes the norm larger."""
    norm = 1 - F.lit(b) + F.lit(b) * length / average + F.lit(gamma_entropy)
    return F.when((average <= 0) | (tf <= 0) | (norm <= 0), 0.0).otherwise(tf / norm)


def saturate(score: Column, k: float) -> Column:
    if k <= 0:
        return score
    return F.when(score <= 0, 0.0).otherwise((k + 1) * score / (k + score))


def segment_bit(position: Column, length: Column, segments: int = 16) -> Column:
    """The bit of the segment that holds a position."""
    return F.pow(F.lit(2.0), F.least(F.floor(position / length * segments), F.lit(segments - 1))).cast("long")


def remap_mask(mask: Column, source: int, target: int) -> Column:
    """Bit i of ``source`` segments moves to floor(i / source * target)."""
    moved = [F.when(F.getbit(mask, F.lit(i)) == 1, F.lit(1 << (i * target // source)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(source)]
    out = moved[0]
    for m in moved[1:]:
        out = out.bitwiseOR(m)
    return out


def adaptive_segments(length: Column) -> Column:
    return F.greatest(F.lit(8), F.least(F.lit(32), F.ceil(length / 50).cast("int")))


def pop_count(mask: Column) -> Column:
    return F.bit_count(mask)


def format_binary(mask: Column, width: int = 16) -> Column:
    return F.lpad(F.bin(mask), width, "0")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def adaptive_alpha(average_length: Column) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(1.5), average_length / 100))


def similarity_beta(total: Column) -> Column:
    return 1 / F.log(1 + total)


def entropy_part(tf: Column) -> Column:
    """-p ln p of p = sigmoid(min(tf, 10)), where p is not all but 0 or 1."""
    p = sigmoid(F.least(tf.cast("double"), F.lit(10.0)))
    return F.when((p > 1e-6) & (p < 0.999999), -p * F.log(p)).otherwise(0.0)


def proximity(common: Column, matched: Column, length: Column, average: Column, alpha: float, decay: float, segments: int) -> Column:
    """1 + alpha * (common segments / min(terms, segments)) * e^(-decay * length / average); 1 below two terms."""
    spread = F.bit_count(common) / F.least(matched, F.lit(segments))
    return F.when(matched < 2, 1.0).otherwise(1 + alpha * spread * F.exp(-decay * length / average))


def pairwise_bonus(masks: Column, alpha: float, segments: int) -> Column:
    """alpha times the mean share of common segments over all pairs of masks."""
    indexed = F.transform(masks, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    pairs = F.flatten(F.transform(indexed, lambda x: F.transform(F.filter(indexed, lambda y: y["i"] > x["i"]), lambda y: F.bit_count(x["m"].bitwiseAND(y["m"])) / segments)))
    return F.when(F.size(pairs) == 0, 0.0).otherwise(alpha * F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p) / F.size(pairs))


def earlier_overlap(masks: Column, segments: int) -> Column:
    """Of each mask, the mean share of segments common with the masks before it; 0 for the first."""
    def one(m, i):
        before = F.slice(masks, F.lit(1), i)
        return F.when(i == 0, 0.0).otherwise(F.aggregate(before, F.lit(0.0), lambda a, o: a + F.bit_count(m.bitwiseAND(o)) / segments) / i)

    return F.transform(masks, one)


def is_phrase(masks: Column) -> Column:
    """Every mask moved up one segment meets the next."""
    following = F.slice(masks, 2, 1 << 20)
    head = F.slice(masks, F.lit(1), F.size(following))
    return (F.size(masks) >= 2) & F.forall(F.zip_with(head, following, lambda a, b: F.shiftleft(a, 1).bitwiseAND(b) != 0), lambda x: x)


def normalize_score(score: Column, most: Column) -> Column:
    return F.when(most > 0, F.least(score / most, F.lit(1.0))).otherwise(0.0)


def estimate_capacity(documents: int, terms: int = 1) -> dict[str, float]:
    """Queries a second that the model expects, at most and sustained."""
    base = 155_000.0 if documents <= 100 else 8_600.0 if documents <= 1_000 else 437.0 if documents <= 10_000 else 437.0 * 10_000 / documents
    most = base / max(terms, 1) ** 1.5
    return {"max_qps": most, "sustained_qps": most / 2}
