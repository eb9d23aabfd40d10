"""Perturbations and pattern validation: masking against shuffled orders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.common import checkpointed, lookup
from chronoweave.functions import stats as S
from chronoweave.operators import matching as Ma
from chronoweave.operators import mining as M

#: A drop up to this is rounding, not a change of the score.
NOISE = 1e-12


def draws(df: DataFrame, n: int) -> DataFrame:
    """Every row n times, with `draw` 0..n-1."""
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def shuffled_within_visits(tokens: DataFrame, seed: int = 42) -> DataFrame:
    """Tokens (key, draw, pos, visit_idx, token) permuted inside each visit by hash; positions stay taken."""
    g = ["key", "draw", "visit_idx"]
    slot = tokens.select(*g, "pos").withColumn("r", F.row_number().over(W.partitionBy(*g).orderBy("pos")))
    moved = tokens.withColumn("r", F.row_number().over(W.partitionBy(*g).orderBy(F.xxhash64(F.lit(seed), "draw", "key", "pos"), "pos"))).drop("pos")
    return moved.join(slot.hint("merge"), [*g, "r"]).drop("r")


def shuffled_visits(tokens: DataFrame, seed: int = 42) -> DataFrame:
    """Whole visits permuted by hash: visit_idx becomes the new place; what lies before the first visit stays; one visit stays as it is."""
    v = tokens.where("visit_idx >= 0").select("key", "draw", "visit_idx").distinct()
    w = W.partitionBy("key", "draw")
    old = v.withColumn("r", F.row_number().over(w.orderBy("visit_idx"))).withColumnRenamed("visit_idx", "new_idx")
    new = v.withColumn("r", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "draw", "key", "visit_idx"), "visit_idx")))
    places = new.join(old.hint("merge"), ["key", "draw", "r"]).select("key", "draw", "visit_idx", "new_idx")
    return tokens.join(places.hint("merge"), ["key", "draw", "visit_idx"], "left").withColumn("visit_idx", F.coalesce("new_idx", "visit_idx")).drop("new_idx")


def masked_tokens(tokens: DataFrame, positions: DataFrame) -> DataFrame:
    """Tokens without the positions of each pattern: rows per (pattern_id, key) of positions(pattern_id, key, positions)."""
    return tokens.join(positions.hint("merge"), "key").where(~F.array_contains("positions", F.col("pos"))).drop("positions")


class LinearScorer:
    """A scorer: (tokens with n_visits, group columns) to (group columns, score); the logistic sum of token weights, scaled by the recency of the visit."""

    def __init__(self, weights: DataFrame):
        self.known = lookup(weights.select("token", "weight"), "token")

    def __call__(self, tokens: DataFrame, by: list[str]) -> DataFrame:
        recency = (F.col("visit_idx") + 1) / F.greatest(F.lit(1), F.col("n_visits"))
        rows = tokens.join(self.known, "token")
        return rows.groupBy(*by).agg(S.sigmoid(F.sum(F.col("weight") * recency)).alias("score"))


def linear_scorer(weights: DataFrame) -> LinearScorer:
    return LinearScorer(weights)


@lru_cache
def _orders(n: int) -> np.ndarray:
    return np.array(list(permutations(range(n))))


def _drops(shared, n_rows: int = 256):
    """Sums over the carriers of each pattern, as far as they are in the partition."""

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, steps = [n for n, _ in shared.value], [[sorted(set(items)) for items in p] for _, p in shared.value]
        root = M._tree(list(enumerate(steps)))
        n, sums = np.zeros(len(names), np.int64), np.zeros((4, len(names)))
        for whole in batches:
            for lo in range(0, whole.num_rows, n_rows):
                for r in whole.slice(lo, n_rows).to_pylist():
                    own: dict[int, dict[str, float]] = {}
                    for v, t, w in zip(r["visits"], r["tokens"], r["weights"]):
                        at = own.setdefault(v, {})
                        at[t] = at.get(t, 0.0) + w
                    found = list(M._matches(root, [own.get(v) for v in range(max(own) + 1)]))
                    if not found:
                        continue
                    places = np.array(sorted(own))
                    total, recency = np.array([sum(own[v].values()) for v in places]), (places + 1) / r["n"]
                    logit = total @ recency
                    order = _orders(len(places)) if r["orders"] is None else np.searchsorted(places, np.array(r["orders"]))
                    moved = sigmoid(logit) - sigmoid(total[order] @ recency)
                    gone = np.array([sum(own[h][t] * (h + 1) for items, h in zip(steps[i], hits) for t in items) for i, hits in found]) / r["n"]
                    mask = sigmoid(logit) - sigmoid(logit - gone)
                    ids = [i for i, _ in found]
                    n[ids] += 1
                    sums[:, ids] += [mask, mask > NOISE, np.full(len(ids), moved.mean()), np.full(len(ids), (moved > NOISE).mean())]
        some = np.flatnonzero(n)
        columns = [pa.array([names[i] for i in some], pa.string()), pa.array(n[some]), *(pa.array(x[some]) for x in sums)]
        yield pa.RecordBatch.from_arrays(columns, names=["pattern_id", "n", "mask", "pos_mask", "visits", "pos_visits"])

    return run


def _linear_validation(patterns: DataFrame, tokens: DataFrame, scorer: LinearScorer, n_draws: int, seed: int, tree_size: int = 100_000) -> DataFrame:
    """validate() of every carrier for a linear scorer, in one pass over the sequences: per pattern only sums leave a task.

    A masked score is the score without the sum of the masked terms. Orders within
    a visit leave it as it is. Where a sequence's visits have at most n_draws
    orders, each is taken once; otherwise n_draws are those of shuffled_visits.
    """
    spark = tokens.sparkSession
    x = F.array_sort(F.collect_list(F.struct("pos", "visit_idx", "token", F.coalesce("weight", F.lit(0.0)).alias("weight"))))
    per = tokens.where("visit_idx >= 0").join(scorer.known, "token", "left").groupBy("key").agg(F.greatest(F.lit(1), F.max("n_visits")).cast("double").alias("n"), x.alias("x"))
    few = max(k for k in range(1, 21) if factorial(k) <= max(1, n_draws))
    v = F.array_distinct(F.transform("x", lambda t: t["visit_idx"]))
    hashed = lambda d: F.transform("v", lambda i: F.struct(F.xxhash64(F.lit(seed), d, F.col("key"), i).alias("h"), i.alias("i")))
    orders = F.when(F.size("v") > few, F.transform(F.sequence(F.lit(0), F.lit(n_draws - 1)), lambda d: F.transform(F.array_sort(hashed(d)), lambda t: t["i"])))
    part = lambda name: F.transform("x", lambda t: t[name])
    rows = per.withColumn("v", v).select("n", part("visit_idx").alias("visits"), part("token").alias("tokens"), part("weight").alias("weights"), orders.alias("orders"))
    named = patterns.select("pattern_id", "pattern").where("pattern is not null and size(flatten(pattern)) > 0 and not exists(pattern, s -> size(s) = 0)")
    schema = "pattern_id string, n bigint, mask double, pos_mask double, visits double, pos_visits double"
    found = spark.createDataFrame([], schema)
    parts = -(-named.count() // tree_size)
    if parts > 1:
        rows = checkpointed(rows)
    for k in range(parts):
        shared = spark.sparkContext.broadcast([(r.pattern_id, r.pattern) for r in named.where(F.pmod(F.xxhash64("pattern_id"), F.lit(parts)) == k).collect()])
        one = rows.mapInArrow(_drops(shared), schema)
        found = one if k == 0 else found.unionByName(one)
    n = F.sum("n")
    return found.groupBy("pattern_id").agg(
        n.alias("n_matched"), (F.sum("mask") / n).alias("mean_mask"), F.lit(0.0).alias("mean_shuffle_within"), (F.sum("visits") / n).alias("mean_shuffle_visits"),
        (100 * F.sum("pos_mask") / n).alias("pct_mask"), F.lit(0.0).alias("pct_shuffle_within"), (100 * F.sum("pos_visits") / n).alias("pct_shuffle_visits"),
    )


def validate(patterns: DataFrame, tokens: DataFrame, scorer: Callable[[DataFrame, list[str]], DataFrame], n_draws: int = 5, max_keys: int = 0, seed: int = 42) -> DataFrame:
    """Score drop when a pattern is masked, and when orders are shuffled within and across visits.

    Every carrier is perturbed; a caller may ask for at most max_keys per pattern,
    drawn by a hash of the key. Any scorer sees n_draws shuffles of each sequence;
    of a linear one _linear_validation has the results without perturbed tokens.
    Output per pattern, ids being distinct: n_matched,
    and for mask, shuffle_within and shuffle_visits the mean drop and the share
    of positive drops; patterns without carriers have n_matched 0 and nulls.
    """
    if isinstance(scorer, LinearScorer) and not max_keys:
        out = _linear_validation(patterns, tokens, scorer, n_draws, seed)
        return patterns.select("pattern_id").join(out, "pattern_id", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    found = Ma.matched_positions(patterns, tokens)
    few = found.withColumn("r", F.row_number().over(W.partitionBy("pattern_id").orderBy(F.xxhash64(F.lit(seed), "key"), "key"))).where(F.col("r") <= max_keys).drop("r") if max_keys else found
    few = checkpointed(few)  # read five times
    own = tokens.join(few.select("key").distinct().hint("merge"), "key", "left_semi")
    base = scorer(own, ["key"]).withColumnRenamed("score", "base")
    many = draws(own, n_draws)
    gone = few.select("pattern_id", "key").join(scorer(masked_tokens(own, few), ["pattern_id", "key"]).hint("merge"), ["pattern_id", "key"], "left")
    mask = gone.join(base.hint("merge"), "key").select("pattern_id", "key", (F.col("base") - F.coalesce("score", F.lit(0.5))).alias("mask"))

    def shuffle(moved: DataFrame, name: str) -> DataFrame:
        s = scorer(moved, ["key", "draw"]).join(base.hint("merge"), "key").withColumn("x", F.col("base") - F.col("score"))
        return s.groupBy("key").agg(F.avg("x").alias(name), F.avg((F.col("x") > NOISE).cast("double")).alias(f"pos_{name}"))

    rows = mask.join(shuffle(shuffled_within_visits(many, seed), "shuffle_within").hint("merge"), "key", "left").join(shuffle(shuffled_visits(many, seed), "shuffle_visits").hint("merge"), "key", "left")
    out = rows.groupBy("pattern_id").agg(
        F.count("*").alias("n_matched"), F.avg("mask").alias("mean_mask"), F.avg("shuffle_within").alias("mean_shuffle_within"), F.avg("shuffle_visits").alias("mean_shuffle_visits"),
        (100 * F.avg((F.col("mask") > NOISE).cast("double"))).alias("pct_mask"), (100 * F.avg("pos_shuffle_within")).alias("pct_shuffle_within"), (100 * F.avg("pos_shuffle_visits")).alias("pct_shuffle_visits"),
    )
    return patterns.select("pattern_id").join(out, "pattern_id", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
