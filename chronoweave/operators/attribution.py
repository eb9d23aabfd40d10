"""Token tables, a linear scorer with exact attributions, mass selection, blocks and attribution aggregates.

The normalised tables are
  tokens(key, y, n_visits, pos, visit_idx, token)     one row per position
  attributions = tokens + stream, attr [, is_salient]
  blocks(key, block_idx, items)                        salient tokens per visit
key is `entity|visit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.common import clean_id, lookup
from chronoweave.functions import stats as S
from chronoweave.functions import text as X


def sequence_rows(sequences: DataFrame) -> DataFrame:
    """(key, y, n_visits, tokens): one row per (entity, visit) with a sequence; repeated rows count once, the known label wins."""
    rows = sequences.select(F.concat_ws("|", clean_id("patient_id"), clean_id("index_hadm_id")).alias("key"), F.col("readmission").alias("y"), "n_visits", F.col("combined_full").alias("tokens"))
    return rows.where("tokens is not null and key != ''").groupBy("key").agg(F.max("y").alias("y"), F.max("n_visits").alias("n_visits"), F.max("tokens").alias("tokens"))


def token_rows(seq: DataFrame) -> DataFrame:
    """Positions of the clinical tokens with the visit each lies in (-1 before the first marker), without a shuffle."""
    marks = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i) == "[VISIT]")
    rows = seq.where(F.size("tokens") > 0).withColumn("marks", marks).select("key", "y", "n_visits", "marks", F.posexplode("tokens").alias("pos", "token"))
    at = F.size(F.filter("marks", lambda m: m <= F.col("pos"))) - 1
    return rows.where(X.is_event("token")).select("key", "y", "n_visits", "pos", at.alias("visit_idx"), "token")


def token_weights(tokens: DataFrame) -> DataFrame:
    """(token, n_pos, n_neg, weight): smoothed log odds of the label for carriers of a token. The closed-form linear scorer."""
    known = tokens.where("y is not null")
    per = known.select("key", "y", "token").distinct().groupBy("token").agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))
    totals = known.select("key", "y").distinct().agg(F.count_if(F.col("y") == 1).alias("t1"), F.count_if(F.col("y") == 0).alias("t0"))
    return _smoothed(per, totals)


def _smoothed(per: DataFrame, totals: DataFrame) -> DataFrame:
    a, b = F.col("n_pos"), F.col("n_neg")
    return per.join(F.broadcast(totals)).select("token", "n_pos", "n_neg", F.log(S.odds_ratio(a, b, F.col("t1") - a, F.col("t0") - b)).alias("weight"))


def sequence_weights(seq: DataFrame) -> DataFrame:
    """token_weights of rows (key, y, tokens), each key once: tokens are made distinct inside their row, so only counts are shuffled."""
    known = seq.where("y is not null").select("y", F.array_distinct(F.filter("tokens", X.is_event)).alias("t"))
    per = known.select("y", F.explode("t").alias("token")).groupBy("token").agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))
    return _smoothed(per, known.where(F.size("t") > 0).agg(F.count_if(F.col("y") == 1).alias("t1"), F.count_if(F.col("y") == 0).alias("t0")))


def linear_attributions(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """Exact attributions of the linear scorer: a token's weight, scaled by the recency of its visit.

    For a linear score, path attributions against the empty baseline are the
    terms of the sum, so no gradient is needed. Weights are one row per token:
    a lookup that is broadcast within its bound, never the tokens.
    """
    recency = (F.col("visit_idx") + 1) / F.greatest(F.lit(1), F.col("n_visits"))
    return tokens.join(lookup(weights.select("token", "weight"), "token"), "token").withColumn("attr", F.col("weight") * recency).withColumn("stream", X.stream("token")).drop("weight")


def scores(attributions: DataFrame, bias: float = 0.0) -> DataFrame:
    """(key, y, score): sigmoid of the summed attributions."""
    return attributions.groupBy("key", "y").agg(S.sigmoid(F.sum("attr") + bias).alias("score"))


def largest(attributions: DataFrame, n: int) -> DataFrame:
    """The n rows of largest absolute attribution per key, ties by position."""
    w = W.partitionBy("key").orderBy(F.desc(F.abs("attr")), "pos")
    return attributions.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def mass_selected(attributions: DataFrame, mass: float = 0.8, max_tokens: int = 50) -> DataFrame:
    """Mark the positions that carry `mass` of the absolute attribution, largest first.

    The token that crosses the mass is kept; ties go to the earlier position;
    max_tokens 0 is unlimited. Null attributions are never salient.
    """
    a = F.abs("attr")
    w = W.partitionBy("key").orderBy(F.desc_nulls_last(a), "pos")
    before = F.coalesce(F.sum(a).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(a).over(W.partitionBy("key"))
    keep = (before / (total + 1e-12) < mass) & F.col("attr").isNotNull()
    if max_tokens:
        keep = keep & (F.row_number().over(w) <= max_tokens)
    return attributions.withColumn("is_salient", F.coalesce(keep, F.lit(False)))


def reselected(attributions: DataFrame, mass: float) -> DataFrame:
    """The threshold study's rule: one token more than those within the mass, no cap, nothing where all attributions are zero."""
    a = F.abs("attr")
    w = W.partitionBy("key").orderBy(F.desc(a), "pos")
    total = F.sum(a).over(W.partitionBy("key"))
    rows = attributions.withColumn("t", total).withColumn("r", F.row_number().over(w))
    rows = rows.withColumn("c", (F.sum(a).over(w) <= mass * F.col("t")).cast("int"))
    return rows.withColumn("k", F.sum("c").over(W.partitionBy("key")) + 1).withColumn("is_salient", (F.col("r") <= F.col("k")) & (F.col("t") >= 1e-12)).drop("t", "r", "c", "k")


def salient_blocks(marked: DataFrame) -> DataFrame:
    """(key, y, block_idx, visit_idx, items) of salient tokens per visit.

    Membership is by token: once a token is salient anywhere in a sequence, each
    of its occurrences enters its visit's block, while is_salient is by position.
    Visits without salient tokens vanish; blocks are numbered over the rest.
    """
    chosen = marked.where("is_salient").select("key", "token").distinct()
    rows = marked.where("visit_idx >= 0").join(chosen, ["key", "token"], "left_semi")
    per = rows.groupBy("key", "y", "visit_idx").agg(F.array_sort(F.collect_set("token")).alias("items"))
    return per.withColumn("block_idx", F.row_number().over(W.partitionBy("key").orderBy("visit_idx")) - 1).select("key", "y", "block_idx", "visit_idx", "items")


def block_arrays(blocks: DataFrame) -> DataFrame:
    """(key, y, blocks): the item sets of a sequence in order."""
    return blocks.groupBy("key").agg(F.max("y").alias("y"), F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "items"))), lambda x: x["items"]).alias("blocks"))


def visit_token_sums(attributions: DataFrame) -> DataFrame:
    return attributions.groupBy("key", "visit_idx", "token").agg(F.sum("attr").alias("attr_sum"))


def block_token_sums(marked: DataFrame, blocks: DataFrame) -> DataFrame:
    """Summed attribution per (key, block, token), of salient positions in a block's visit."""
    rows = marked.where("is_salient and visit_idx >= 0")
    return rows.join(blocks.select("key", "visit_idx", "block_idx"), ["key", "visit_idx"]).groupBy("key", "block_idx", "token").agg(F.sum("attr").alias("attr_sum"))


def token_importance(attributions: DataFrame, min_entities: int = 10) -> DataFrame:
    """Two-level mean: sum per (token, entity), mean over entities; and the population mean over all entities.

    Grouped by entity, not by visit. Tokens in fewer than min_entities are left out.
    """
    rows = attributions.withColumn("entity", F.split_part("key", F.lit("|"), F.lit(1)))
    total = rows.agg(F.countDistinct("entity").alias("n_total"))
    per = rows.groupBy("token", "entity").agg(F.sum("attr").alias("s")).groupBy("token").agg(F.count("*").alias("n_present"), F.avg("s").alias("attr_mean"))
    out = per.where(F.col("n_present") >= min_entities).join(F.broadcast(total))
    return out.select("token", "n_present", "attr_mean", (F.col("n_present") / F.col("n_total")).alias("prevalence"), (F.col("attr_mean") * F.col("n_present") / F.col("n_total")).alias("population_mean"))


def occurrence_means(attributions: DataFrame) -> DataFrame:
    """Mean per occurrence, unlike token_importance."""
    return attributions.groupBy("token").agg(F.count("*").alias("n_occurrences"), F.avg("attr").alias("attr_mean"), F.avg(F.abs("attr")).alias("attr_abs_mean"))


def stream_means(attributions: DataFrame, streams: tuple[str, ...] = ("C", "D", "P")) -> DataFrame:
    """Label by stream: mean of the entities' summed absolute attribution."""
    per = attributions.where("y is not null").groupBy("key", "y", "stream").agg(F.sum(F.abs("attr")).alias("s"))
    return per.groupBy("y").pivot("stream", list(streams)).agg(F.avg("s"))


def entity_token_matrix(attributions: DataFrame, n_entities: int = 10, n_tokens: int = 8) -> DataFrame:
    """Long form (y, key, token, attr) of the top entities per label by summed absolute attribution and the top tokens overall; of a repeated token the last position counts."""
    rows = attributions.where("y is not null")
    per = rows.groupBy("y", "key").agg(F.sum(F.abs("attr")).alias("s"))
    # Ranked over one row per entity; each group first keeps its own best in every partition.
    top = per.withColumn("r", F.row_number().over(W.partitionBy("y").orderBy(F.desc(F.round("s", 9)), "key"))).where(F.col("r") <= n_entities)
    tokens = rows.groupBy("token").agg(F.sum(F.abs("attr")).alias("s")).orderBy(F.desc(F.round("s", 9)), "token").limit(n_tokens)
    cells = rows.join(F.broadcast(top.select("y", "key")), ["y", "key"], "left_semi").join(F.broadcast(tokens.select("token")), "token", "left_semi")
    return cells.groupBy("y", "key", "token").agg(F.max_by("attr", "pos").alias("attr"))


def net_over_visits(attributions: DataFrame) -> DataFrame:
    """Per visit: net attribution, running net, and the token with the largest absolute attribution."""
    lead = F.max_by(F.struct("token", "attr"), F.struct(F.abs("attr"), -F.col("pos")))
    per = attributions.groupBy("key", "visit_idx").agg(F.sum("attr").alias("net"), lead.alias("lead"))
    w = W.partitionBy("key").orderBy("visit_idx").rowsBetween(W.unboundedPreceding, 0)
    return per.select("key", "visit_idx", "net", F.sum("net").over(w).alias("running_net"), F.col("lead")["token"].alias("lead_token"), F.col("lead")["attr"].alias("lead_attr"))


def histogram(df: DataFrame, value: Column, bins: int = 40, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(bin, n) of equal bins, the last one closed; values outside are left out."""
    v = value.cast("double")
    at = F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins)).cast("int")
    return df.where((v >= lo) & (v <= hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def spread(df: DataFrame, value: Column, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """n, mean, population sd and the shares below `low` and above `high`."""
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.avg((value < low).cast("double")).alias("share_low"), F.avg((value > high).cast("double")).alias("share_high"))


def compression(marked: DataFrame) -> DataFrame:
    """Mean full and salient lengths and their ratio."""
    per = marked.groupBy("key").agg(F.count("*").alias("n_full"), F.count_if("is_salient").alias("n_salient"))
    return per.agg(F.avg("n_full").alias("mean_full"), F.avg("n_salient").alias("mean_salient"), (F.avg("n_salient") / F.avg("n_full")).alias("ratio"))
