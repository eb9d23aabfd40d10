"""Where patterns match: occurrence attribution, statistics, order contrast, positions, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.common import checkpointed, lookup
from chronoweave.functions import arrays as A
from chronoweave.functions import text as X
from chronoweave.operators import mining as M


def _steps(patterns: DataFrame) -> DataFrame:
    """(pattern_id, step, token), hinted for joins against matches."""
    s = patterns.select("pattern_id", F.posexplode("pattern").alias("step", "items")).select("pattern_id", "step", F.explode("items").alias("token"))
    return lookup(s, "pattern_id")


def instance_scores(edges: DataFrame, patterns: DataFrame, block_sums: DataFrame) -> DataFrame:
    """(pattern_id, key, score): summed attribution of a pattern's tokens in the blocks it matched; missing sums count zero."""
    steps = _steps(patterns)
    hits = edges.select("pattern_id", "key", F.posexplode("hits").alias("step", "block_idx"))
    rows = hits.join(steps, ["pattern_id", "step"]).join(block_sums.hint("merge"), ["key", "block_idx", "token"], "left")
    return rows.groupBy("pattern_id", "key").agg(F.coalesce(F.sum("attr_sum"), F.lit(0.0)).alias("score"))


def pattern_stats(instances: DataFrame, stats: DataFrame) -> DataFrame:
    """Per pattern: mean, median and mean absolute score of its carriers, and how many, and how strongly, agree with its odds ratio.

    Concordant: positive scores where the odds ratio is above one, negative ones
    otherwise; the conditional impact is their mean, 0 if there is none.
    """
    rows = instances.join(stats.select("pattern_id", "odds_ratio"), "pattern_id")
    agrees = F.when(F.col("odds_ratio") > 1, F.col("score") > 0).otherwise(F.col("score") < 0)
    return rows.groupBy("pattern_id", "odds_ratio").agg(
        F.count("*").alias("n_carriers"), F.avg("score").alias("attr_mean"), F.median("score").alias("attr_median"), F.avg(F.abs("score")).alias("attr_abs_mean"),
        F.coalesce(F.avg(F.when(agrees, F.col("score"))), F.lit(0.0)).alias("conditional_impact"), F.count_if(agrees).alias("n_concordant"),
    )


def _visit_arrays(rows: DataFrame) -> DataFrame:
    """(key, blocks): each key's token sets by visit; block k is visit k, visits without tokens are null."""
    visits = rows.groupBy("key", "visit_idx").agg(F.collect_set("token").alias("items"))
    v = visits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("visit_idx", "items"))).alias("v"), F.max("visit_idx").alias("last"))
    return v.select("key", F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.try_element_at("v", k)).alias("blocks"))


def occurrences(patterns: DataFrame, attributions: DataFrame) -> DataFrame:
    """Carriers and scores over all attributed tokens, not the salient blocks: (pattern_id, key, score, n_matched).

    Each item set matches in the earliest visit after the match before; each of
    its tokens contributes its first attribution of that visit. Visits numbered
    below zero never match.
    """
    rows = attributions.where("visit_idx >= 0")
    found = M.carriers(patterns, _visit_arrays(rows))
    steps = _steps(patterns)
    first = rows.groupBy("key", "visit_idx", "token").agg(F.min_by("attr", "pos").alias("attr"))
    at = found.select("pattern_id", "key", F.posexplode("hits").alias("step", "visit_idx")).join(steps, ["pattern_id", "step"])
    return at.join(first.hint("merge"), ["key", "visit_idx", "token"]).groupBy("pattern_id", "key").agg(F.sum("attr").alias("score"), F.count("*").alias("n_matched"))


def matched_positions(patterns: DataFrame, tokens: DataFrame) -> DataFrame:
    """(pattern_id, key, positions): every position in a matched visit whose token belongs to the item set matched there."""
    rows = tokens.where("visit_idx >= 0")
    found = M.carriers(patterns, _visit_arrays(rows))
    steps = _steps(patterns)
    at = found.select("pattern_id", "key", F.posexplode("hits").alias("step", "visit_idx")).join(steps, ["pattern_id", "step"])
    return at.join(rows.select("key", "visit_idx", "token", "pos").hint("merge"), ["key", "visit_idx", "token"]).groupBy("pattern_id", "key").agg(F.array_sort(F.collect_set("pos")).alias("positions"))


def flat_occurrence(sequences: DataFrame, pattern: list[str], contiguous: bool) -> DataFrame:
    """(key, positions) of the first occurrence of a flat pattern among the events of `tokens`; markers don't break contiguity."""
    if not contiguous:
        return ordered_positions(sequences, [[x] for x in pattern])
    events = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("tok"))), lambda x: X.is_event(x["tok"]))
    rows = sequences.select("key", events.alias("e")).withColumn("t", F.transform("e", lambda x: x["tok"]))
    at = A.contiguous_at(F.array(*[F.lit(x) for x in pattern]), F.col("t"))
    return rows.withColumn("at", at).where("at is not null").select("key", F.transform(F.slice("e", F.col("at") + 1, len(pattern)), lambda x: x["pos"]).alias("positions"))


def ordered_positions(sequences: DataFrame, pattern: list[list[str]]) -> DataFrame:
    """(key, positions) where each item set's tokens come after the last position of the item set before, in one visit or not."""
    rows = sequences.select("key", F.col("tokens").alias("t"))
    state = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("hits"), F.lit(True).alias("ok"))
    for items in pattern:
        find = [F.when(state["next"] < F.size("t"), F.array_position(F.slice("t", state["next"] + 1, F.size("t")), F.lit(x))).otherwise(F.lit(0)).cast("int") for x in sorted(items)]
        at = [F.when(f > 0, state["next"] + f - 1) for f in find]
        ok = state["ok"]
        for a in at:
            ok = ok & a.isNotNull()
        state = F.struct(F.when(ok, F.greatest(F.lit(0), *at) + 1 if len(at) > 1 else F.coalesce(at[0], F.lit(0)) + 1).otherwise(state["next"]).cast("int").alias("next"), F.when(ok, F.concat(state["hits"], F.array(*at))).otherwise(state["hits"]).alias("hits"), ok.alias("ok"))
        rows = rows.withColumn("state", state)
        state = F.col("state")
    return rows.where(state["ok"]).select("key", F.array_sort(state["hits"]).alias("positions"))


def order_contrast(patterns: DataFrame, sequences: DataFrame, scores: DataFrame) -> DataFrame:
    """Carriers of a pattern against carriers of its reversal.

    scores: (key, score). Patterns need two steps and two distinct tokens. Output
    per pattern: n_forward, n_reversed, n_both, n_forward_only, n_reversed_only,
    the groups' mean scores, and mean_diff (forward only minus reversed only).
    """
    p = patterns.where((F.col("n_steps") >= 2) & (F.size(F.array_distinct(F.flatten("pattern"))) >= 2))
    both = p.select(F.concat(F.lit("f"), "pattern_id").alias("pattern_id"), "pattern").unionByName(p.select(F.concat(F.lit("r"), "pattern_id").alias("pattern_id"), F.reverse("pattern").alias("pattern")))
    found = M.carriers(both, sequences).select(F.left("pattern_id", F.lit(1)).alias("way"), F.expr("substring(pattern_id, 2)").alias("pattern_id"), "key")
    seen = found.groupBy("pattern_id", "key").agg(F.max(F.when(F.col("way") == "f", 1)).alias("f"), F.max(F.when(F.col("way") == "r", 1)).alias("r"))
    rows = seen.join(scores.select("key", "score"), "key", "left")
    fw, rv = F.col("f").isNotNull(), F.col("r").isNotNull()
    mean = lambda c: F.avg(F.when(c, F.col("score")))
    return rows.groupBy("pattern_id").agg(
        F.count_if(fw).alias("n_forward"), F.count_if(rv).alias("n_reversed"), F.count_if(fw & rv).alias("n_both"), F.count_if(fw & ~rv).alias("n_forward_only"), F.count_if(rv & ~fw).alias("n_reversed_only"),
        mean(fw).alias("mean_forward"), mean(rv).alias("mean_reversed"), mean(fw & ~rv).alias("mean_forward_only"), mean(rv & ~fw).alias("mean_reversed_only"),
    ).withColumn("mean_diff", F.col("mean_forward_only") - F.col("mean_reversed_only"))


def explanation(attributions: DataFrame, edges: DataFrame, patterns: DataFrame, block_sums: DataFrame, top: int = 20) -> DataFrame:
    """Per key: its top tokens by absolute attribution and its matched patterns with their share of the absolute mass.

    Output: key, kind (token or pattern), rank, name, value. A pattern's mass is
    the absolute sum of its tokens in the matched blocks over the key's total.
    """
    w = W.partitionBy("key").orderBy(F.desc(F.abs("attr")), "pos")
    tokens = attributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("key", F.lit("token").alias("kind"), "rank", F.col("token").alias("name"), F.col("attr").alias("value"))
    total = attributions.groupBy("key").agg(F.sum(F.abs("attr")).alias("total"))
    mass = instance_scores(edges, patterns, block_sums.withColumn("attr_sum", F.abs("attr_sum"))).join(total.hint("merge"), "key")
    share = F.col("score") / (F.col("total") + 1e-12)
    ranked = mass.withColumn("value", share).withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc(F.round("value", 9)), "pattern_id")))
    return tokens.unionByName(ranked.where(F.col("rank") <= top).select("key", F.lit("pattern").alias("kind"), "rank", F.col("pattern_id").alias("name"), "value"))


def exemplars(masses: DataFrame, patterns: DataFrame, n: int = 4, facts: DataFrame | None = None) -> DataFrame:
    """Diverse examples picked one by one from all keys: best tier, then most tokens not shown yet, patterns, mass, key.

    masses: (key, pattern_id, value). facts: (key, y, n_visits); tier 0 are positive
    keys of several visits, 1 other keys of several visits, 2 the rest; without
    facts there is one tier. Each pick is a distributed top-1; only it and the
    tokens shown so far, those of at most n keys, reach the driver.
    """
    spark = masses.sparkSession
    tokens = masses.join(patterns.select("pattern_id", F.array_distinct(F.flatten("pattern")).alias("t")), "pattern_id")
    rows = tokens.groupBy("key").agg(F.countDistinct("pattern_id").alias("n_patterns"), F.sum("value").alias("mass"), F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"))
    tier = F.lit(0)
    if facts is not None:
        rows = rows.join(facts.select("key", "y", "n_visits"), "key", "left")
        tier = F.when((F.col("n_visits") > 1) & (F.col("y") == 1), 0).when(F.col("n_visits") > 1, 1).otherwise(2)
    rows = checkpointed(rows.select("key", "n_patterns", "mass", "t", tier.alias("tier")))
    shown: list[str] = []
    out: list[tuple] = []
    while len(out) < n:
        new = F.size(F.array_except("t", F.array(*[F.lit(x) for x in shown]).cast("array<string>"))).alias("new")
        left = rows.where(~F.col("key").isin([r[1] for r in out])) if out else rows
        best = left.select("*", new).orderBy("tier", F.desc("new"), F.desc("n_patterns"), F.desc(F.round("mass", 9)), "key").first()
        if best is None:
            break
        out.append((len(out) + 1, best.key, best.n_patterns, best.mass, best.new))
        shown = sorted({*shown, *best.t})
    return spark.createDataFrame(out, "rank int, key string, n_patterns bigint, mass double, n_new_tokens int")


def token_means_in_patterns(edges: DataFrame, patterns: DataFrame, block_sums: DataFrame) -> DataFrame:
    """(pattern_id, token, attr_mean): mean attribution of each of a pattern's tokens over the blocks it matched."""
    steps = _steps(patterns)
    hits = edges.select("pattern_id", "key", F.posexplode("hits").alias("step", "block_idx"))
    return hits.join(steps, ["pattern_id", "step"]).join(block_sums, ["key", "block_idx", "token"]).groupBy("pattern_id", "token").agg(F.avg("attr_sum").alias("attr_mean"))
