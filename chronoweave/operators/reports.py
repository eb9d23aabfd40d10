"""The data behind the report: selections and aggregates, without any drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.common import checkpointed
from chronoweave.functions import text as X
from chronoweave.operators import attribution as At
from chronoweave.operators import metrics as Me
from chronoweave.operators import mining as Mi


def performance(scores: DataFrame) -> DataFrame:
    """One row: label counts, ranking metrics and points on the curve."""
    counts = scores.agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"), F.count_if(F.col("y").isNull()).alias("n_unknown"))
    points = Me.curves(scores, F.col("score"), F.col("y")).agg(F.count("*").alias("n_points"))
    out = counts
    for x in (Me.auroc(scores, F.col("score"), F.col("y")), Me.average_precision(scores, F.col("score"), F.col("y")), points):
        out = out.join(F.broadcast(x))  # one row each
    return out


def entity_tokens(attributions: DataFrame, top: int = 20) -> DataFrame:
    """Per key: its top tokens by absolute attribution, re-ranked by signed value: (key, token, attr, rank)."""
    w = W.partitionBy("key").orderBy(F.desc(F.abs("attr")), "pos")
    rows = attributions.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("attr"), "pos"))).select("key", "token", "attr", "rank")


def pseudo_scored(scored: DataFrame, n: int) -> DataFrame:
    """Patterns ranked by odds ratio alone: the ratio above one, minus its inverse otherwise; n/2 per side."""
    p = F.when(F.col("odds_ratio") > 1, F.col("odds_ratio")).otherwise(-1 / F.col("odds_ratio"))
    return Mi.balanced_top(scored.withColumn("pseudo", p), F.col("pseudo"), n, "pattern_id")


def validation_panel(validation: DataFrame, n: int) -> DataFrame:
    """Validated patterns, n/2 rounded up from positive and the rest from negative drops, by the drop under masking."""
    rows = validation.dropna(subset=["mean_mask"])
    up = rows.where("mean_mask > 0").orderBy(F.desc("mean_mask"), "pattern_id").limit(-(-n // 2))
    return up.unionByName(rows.where("mean_mask <= 0").orderBy("mean_mask", "pattern_id").limit(n // 2))


def conditional_impact(stats: DataFrame, least: int = 5, k: int = 10) -> DataFrame:
    """(pattern_id, side, conditional_impact, rank): top k by absolute impact on either side of the odds ratio, with enough concordant carriers."""
    rows = stats.where(F.col("n_concordant") >= least).withColumn("side", F.when(F.col("odds_ratio") > 1, "risk").otherwise("protective"))
    w = W.partitionBy("side").orderBy(F.desc(F.abs("conditional_impact")), "pattern_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("pattern_id", "side", "conditional_impact", "rank")


def presence(edges: DataFrame, n_patterns: int = 10, n_keys: int = 30) -> DataFrame:
    """(pattern_id, key, present) of the most carried patterns and the keys that carry most of those."""
    e = edges.select("pattern_id", "key").distinct()
    p = e.groupBy("pattern_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern_id").limit(n_patterns).select("pattern_id")
    own = e.join(F.broadcast(p), "pattern_id", "left_semi")
    k = own.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(n_keys).select("key")
    # Both lists are top-k, so the grid has at most n_patterns * n_keys cells.
    grid = p.withColumn("one", F.lit(1)).join(F.broadcast(k.withColumn("one", F.lit(1))), "one").drop("one")
    return grid.join(own.withColumn("x", F.lit(1)), ["pattern_id", "key"], "left").select("pattern_id", "key", F.coalesce("x", F.lit(0)).alias("present"))


def union_of_tops(attributions: DataFrame, k: int = 8, cap: int = 12) -> DataFrame:
    """(key, tokens): an entity's k tokens of largest value, then its k of largest absolute value, each once, at most cap."""
    a = W.partitionBy("key").orderBy(F.desc("attr"), "pos")
    b = W.partitionBy("key").orderBy(F.desc(F.abs("attr")), "pos")
    rows = attributions.withColumn("a", F.row_number().over(a)).withColumn("b", F.row_number().over(b)).where((F.col("a") <= k) | (F.col("b") <= k))
    ordered = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col(r) <= k, F.struct(r, "token")))), lambda x: x["token"])
    return rows.groupBy("key").agg(F.array_join(F.slice(F.array_union(ordered("a"), ordered("b")), 1, cap), ",").alias("tokens"))


def characteristics(seq: DataFrame, marked: DataFrame) -> DataFrame:
    """(name, value) rows of a characteristics table, formatted."""
    lens = marked.groupBy("key").agg(F.count("*").alias("n_full"), F.count_if("is_salient").alias("n_salient"))
    m = lens.agg(F.avg("n_full").alias("a"), F.stddev_samp("n_full").alias("b"), F.avg("n_salient").alias("c"), F.stddev_samp("n_salient").alias("d"))
    s = seq.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"), F.avg("n_visits").alias("v"), F.stddev_samp("n_visits").alias("w"))
    pair = lambda x, y: F.format_string("%.1f (%.1f)", F.col(x), F.col(y))
    named = {"entities": F.col("n").cast("string"), "positive": F.col("pos").cast("string"), "negative": F.col("neg").cast("string"), "visits": pair("v", "w"), "length": pair("a", "b"), "salient length": pair("c", "d"), "salient share": F.format_string("%.1f%%", 100 * F.col("c") / F.col("a"))}
    return s.join(F.broadcast(m)).select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in named.items()])).alias("r")).select("r.*")


def threshold_stability(attributions: DataFrame, masses: list[float], reference: float, min_support: float, max_items: int = 2) -> DataFrame:
    """(mass, n_patterns, n_shared, similarity): patterns mined at each mass against those of the reference mass; two empty sets are alike."""
    mined = {}
    for m in sorted({*masses, reference}):
        blocks = At.block_arrays(At.salient_blocks(At.reselected(attributions, m)))
        mined[m] = checkpointed(Mi.mine_episodes(blocks, min_support, max_items).select(X.rendered("pattern").alias("pattern")))
    ref = mined[reference].withColumn("r", F.lit(1))
    out = None
    for m in masses:
        own = mined[m].withColumn("o", F.lit(1))
        row = own.join(ref, "pattern", "full").agg(F.count("o").alias("n_patterns"), F.count(F.col("o") + F.col("r")).alias("n_shared"), F.coalesce(F.count(F.col("o") + F.col("r")) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("similarity"))
        row = row.select(F.lit(m).alias("mass"), "n_patterns", "n_shared", "similarity")
        out = row if out is None else out.unionByName(row)
    return out
