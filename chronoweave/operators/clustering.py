"""Overlapping patterns: pairwise similarity of carriers, leader clusters, merged clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.common import checkpointed


def carrier_pairs(edges: DataFrame, threshold: float = 0.0, min_carriers: int = 1) -> DataFrame:
    """(a, b, n_both, similarity), a < b, of patterns that share carriers, by an equi-self-join on the carrier.

    The sizes bound the similarity, so pairs whose sizes exclude the threshold
    are dropped inside the join.
    """
    e = edges.select("pattern_id", "key").distinct()
    sizes = e.groupBy("pattern_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_carriers)
    e = e.join(sizes, "pattern_id")
    x, y = e.alias("x"), e.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.pattern_id") < F.col("y.pattern_id")) & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n"))
    both = x.join(y, met).groupBy(F.col("x.pattern_id").alias("a"), F.col("y.pattern_id").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).agg(F.count("*").alias("n_both"))
    return both.withColumn("similarity", F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).where(F.col("similarity") >= threshold)


def leader_clusters(pairs: DataFrame, ranked: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(pattern_id, leader): in rank order every pattern not yet taken leads and absorbs all later ones similar to itself.

    ranked: (pattern_id, rank), rank 1 first. A pattern leads exactly if no
    leader before it is similar to it. Solved in rounds instead of one pass: among
    the undecided, those with no undecided similar pattern before them lead, and
    what they absorb is decided with them. The result is the sequential one; no
    group is gathered, and each round is cut off by a checkpoint.
    """
    links = pairs.where(F.col("similarity") >= threshold).select("a", "b")
    r = ranked.select("pattern_id", "rank")
    ra = r.withColumnRenamed("pattern_id", "a").withColumnRenamed("rank", "ra")
    rb = r.withColumnRenamed("pattern_id", "b").withColumnRenamed("rank", "rb")
    both = links.join(ra, "a").join(rb, "b")
    # early precedes late.
    edges = checkpointed(both.select(F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("early"), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("late"), F.least("ra", "rb").alias("rank")))
    left = checkpointed(r.select("pattern_id"))
    done = None
    while True:
        live = edges.join(left.withColumnRenamed("pattern_id", "early"), "early").join(left.withColumnRenamed("pattern_id", "late"), "late")
        leaders = checkpointed(left.join(live.select(F.col("late").alias("pattern_id")).distinct(), "pattern_id", "left_anti"))
        took = live.join(leaders.withColumnRenamed("pattern_id", "early"), "early").groupBy("late").agg(F.min_by("early", "rank").alias("leader"))
        new = checkpointed(leaders.select("pattern_id", F.col("pattern_id").alias("leader")).unionByName(took.select(F.col("late").alias("pattern_id"), "leader")))
        done = new if done is None else checkpointed(done.unionByName(new))
        left = checkpointed(left.join(new.select("pattern_id"), "pattern_id", "left_anti"))
        if left.isEmpty():
            return done


def cluster_table(clusters: DataFrame, stats: DataFrame) -> DataFrame:
    """Clusters with size, carriers and direction: cluster_id by the leader's absolute mean, largest first.

    stats: (pattern_id, attr_mean, n_present, odds_ratio).
    """
    from pyspark.sql import Window as W

    lead = stats.select(F.col("pattern_id").alias("leader"), F.col("attr_mean").alias("leader_mean"))
    sizes = clusters.join(stats, "pattern_id").groupBy("leader").agg(F.count("*").alias("cluster_size"), F.sum("n_present").alias("cluster_total")).join(lead, "leader")
    numbered = sizes.withColumn("cluster_id", F.row_number().over(W.orderBy(F.desc(F.abs("leader_mean")), "leader")))
    direction = F.when(F.col("leader_mean") > 0, "risk").otherwise("protective").alias("direction")
    return clusters.join(stats, "pattern_id").join(numbered, "leader").select("cluster_id", (F.col("pattern_id") == F.col("leader")).alias("is_leader"), "pattern_id", "attr_mean", "n_present", "odds_ratio", "cluster_size", "cluster_total", F.col("leader").alias("leader_pattern"), "leader_mean", direction)


def merged_clusters(edges: DataFrame, order: DataFrame, threshold: float, max_patterns: int = 20_000) -> DataFrame:
    """(pattern_id, representative, n_union): each pattern joins the most similar cluster so far, if similar enough to the union of its carriers.

    order: (pattern_id, rank). The unions grow as patterns join, so the rule is
    sequential by definition; it runs over the components of patterns that share
    a carrier at all, one task per component, as no pattern can join a cluster it
    shares nothing with. A component of more than max_patterns patterns raises.
    """
    from chronoweave.operators.graph import components

    e = edges.select("pattern_id", "key").distinct()
    hub = e.groupBy("key").agg(F.min("pattern_id").alias("u"))
    comp = components(e.join(hub, "key").select("u", F.col("pattern_id").alias("v")))
    rows = order.select("pattern_id", "rank").join(comp, order["pattern_id"] == comp["node"], "left").select("pattern_id", "rank", F.coalesce("component", "pattern_id").alias("component"))
    big = rows.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > max_patterns).isEmpty()
    if not big:
        raise ValueError(f"more than {max_patterns} patterns share carriers; raise the support or the limit")
    sets = e.groupBy("pattern_id").agg(F.collect_list("key").alias("keys"))
    full = rows.join(sets, "pattern_id", "left").select("component", "pattern_id", "rank", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        clusters: list[tuple[str, set[str]]] = []
        out = []
        for p, keys in zip(*(pdf.sort_values("rank")[c] for c in ("pattern_id", "keys"))):
            own, best, at = set(keys), 0.0, -1
            for i, (_, union) in enumerate(clusters):
                small, large = sorted((len(own), len(union)))
                if not large or small / large < threshold:
                    continue
                both = len(own & union)
                j = both / (len(own) + len(union) - both)
                if j >= threshold and j > best:
                    best, at = j, i
            if at < 0:
                clusters.append((p, own))
                at = len(clusters) - 1
            else:
                clusters[at][1].update(own)
            out.append((p, at))
        return pd.DataFrame([(p, clusters[i][0], len(clusters[i][1])) for p, i in out], columns=["pattern_id", "representative", "n_union"])

    return full.groupBy("component").applyInPandas(greedy, "pattern_id string, representative string, n_union bigint")
