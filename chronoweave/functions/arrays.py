"""Array expressions: ordered containment, alignment, n-grams, set measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 1 if both are empty, null if one is null."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), None).when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def ngrams(a: Column, n: int) -> Column:
    """All windows of n consecutive elements; empty if the array is shorter."""
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.slice(a, i, n))).otherwise(F.slice(F.array(a), 1, 0))


def alignment(pattern: Column, blocks: Column) -> Column:
    """0-based blocks of the leftmost match of an itemset sequence, null if there is none.

    Each item set must be contained in a block of its own, blocks strictly
    increasing. Taking the earliest block each time finds a match if any exists.
    An empty pattern matches with no blocks.
    """
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("hits"))

    def step(state: Column, items: Column) -> Column:
        rest = F.sequence(state["next"], F.size(blocks) - 1)
        fits = F.filter(F.when(state["next"] < F.size(blocks), rest).otherwise(F.array().cast("array<int>")), lambda j: F.size(F.array_except(items, F.get(blocks, j))) == 0)
        first = F.get(fits, F.lit(0))
        # A miss moves past the last block, so nothing matches after it.
        return F.struct(F.coalesce(first + 1, F.size(blocks) + 1).alias("next"), F.when(first.isNull(), state["hits"]).otherwise(F.concat(state["hits"], F.array(first))).alias("hits"))

    hits = F.aggregate(pattern, start, step)["hits"]
    return F.when(F.size(hits) == F.size(pattern), hits)


def contains_ordered(pattern: Column, blocks: Column) -> Column:
    """Whether an itemset sequence is contained in order."""
    return alignment(pattern, blocks).isNotNull()


def subsequence(pattern: Column, tokens: Column) -> Column:
    """Whether a flat token pattern occurs in order, gaps allowed."""
    matched = F.aggregate(tokens, F.lit(0), lambda k, t: F.when(F.get(pattern, k) == t, k + 1).otherwise(k))
    return matched == F.size(pattern)


def contiguous_at(pattern: Column, tokens: Column) -> Column:
    """0-based position of the first unbroken occurrence, null if none or for an empty pattern."""
    n = F.size(pattern)
    starts = F.when((F.size(tokens) >= n) & (n > 0), F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(starts, lambda i: F.slice(tokens, i + 1, n) == pattern), F.lit(0))


def masked(ids: Column, positions: Column, pad: Column) -> Column:
    """The array with the given 0-based positions replaced by pad."""
    return F.transform(ids, lambda x, i: F.when(F.array_contains(positions, i), pad).otherwise(x))


def tail_truncated(tokens: Column, n: int) -> Column:
    """At most n elements: the first one and the tail."""
    return F.when(F.size(tokens) > n, F.concat(F.slice(tokens, 1, 1), F.slice(tokens, -(n - 1), n - 1))).otherwise(tokens)


def padded(tokens: Column, n: int, pad: Column) -> Column:
    """Filled up to n elements."""
    return F.concat(tokens, F.array_repeat(pad, F.greatest(F.lit(0), F.lit(n) - F.size(tokens))))


def capped_union(a: Column, b: Column, n: int) -> Column:
    """Elements of a, then those of b not in a, at most n."""
    return F.slice(F.array_union(a, b), 1, n)
