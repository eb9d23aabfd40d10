"""Exact ranking metrics, curves, bootstrap intervals and descriptive tables."""

from __future__ import annotations

from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.common import ROWS_PER_BUCKET, checkpointed


def _steps(df: DataFrame, score: Column, label: Column) -> DataFrame:
    """(s, p, n): positives and negatives per distinct score. Rows without score or label are left out."""
    rows = df.select(score.cast("double").alias("s"), label.cast("int").alias("y")).where("s is not null and y is not null")
    return rows.groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))


def curves(df: DataFrame, score: Column, label: Column) -> DataFrame:
    """One row per distinct score, best first: s, tp, fp, tpr, fpr, precision, recall.

    Cumulative counts over an ordered column need a global order: ranges of about
    ROWS_PER_BUCKET distinct scores carry their totals over, and only those totals
    meet in one task.
    """
    steps = checkpointed(_steps(df, score, label))
    total = steps.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    parts = -(-steps.count() // ROWS_PER_BUCKET)
    rows = steps.withColumn("b", F.lit(0))
    if parts > 1:
        rows = checkpointed(steps.repartitionByRange(parts, F.desc("s")).withColumn("b", F.spark_partition_id()))
    inside = W.partitionBy("b").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    before = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carry = rows.groupBy("b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).select("b", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))  # one row per range
    out = rows.withColumn("tp", F.sum("p").over(inside)).withColumn("fp", F.sum("n").over(inside)).join(F.broadcast(carry), "b").withColumn("tp", F.col("tp") + F.col("p0")).withColumn("fp", F.col("fp") + F.col("n0"))
    out = out.join(F.broadcast(total))
    return out.select("s", "p", "n", "tp", "fp", (F.col("tp") / F.nullif("all_p", F.lit(0))).alias("tpr"), (F.col("fp") / F.nullif("all_n", F.lit(0))).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.nullif("all_p", F.lit(0))).alias("recall"))


def auroc(df: DataFrame, score: Column, label: Column) -> DataFrame:
    """One row `auroc`: the chance that a positive outranks a negative, ties half; 0.5 with a single class."""
    c = curves(df, score, label)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2.0))
    return c.agg(area.alias("x"), F.max("tp").alias("all_p"), F.max("fp").alias("all_n")).select(F.coalesce(F.col("x") / F.nullif(F.col("all_p") * F.col("all_n"), F.lit(0)), F.lit(0.5)).alias("auroc"))


def average_precision(df: DataFrame, score: Column, label: Column) -> DataFrame:
    """One row `average_precision`: precision summed over the steps in recall; 0 with a single class."""
    c = curves(df, score, label)
    ap = F.sum(F.col("p") * F.col("precision"))
    return c.agg(ap.alias("x"), F.max("tp").alias("all_p"), F.max("fp").alias("all_n")).select(F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), F.col("x") / F.col("all_p")).otherwise(0.0).alias("average_precision"))


def _metrics(y: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    order = np.argsort(-s, kind="stable")
    y, s, w = y[order], s[order], w[order]
    ends = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
    tp, fp = np.cumsum(w * y)[ends], np.cumsum(w * (1 - y))[ends]
    p, n = np.diff(tp, prepend=0.0), np.diff(fp, prepend=0.0)
    auc = float((n * (tp - p / 2)).sum() / (tp[-1] * fp[-1]))
    return auc, float((p * tp / np.maximum(tp + fp, 1e-300)).sum() / tp[-1])


def _poisson(cell: np.ndarray, w: np.ndarray, seed: int, r: int) -> np.ndarray:
    """Poisson counts of mean w, the same wherever a cell is met; the counts themselves for r < 0."""
    if r < 0:
        return w.astype(float)
    mix = (seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & (2**64 - 1)
    z = cell.astype(np.int64).view(np.uint64) + np.uint64(mix)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    out = np.zeros(len(w))
    for x in np.unique(w):
        at = w == x
        out[at] = np.searchsorted(_poisson_cdf(int(x)), u[at], side="right")
    return out


@lru_cache(4096)
def _poisson_cdf(mean: int) -> np.ndarray:
    k = np.arange(int(mean + 12 * mean**0.5 + 30))
    return np.cumsum(np.exp(k * np.log(mean) - mean - np.array([lgamma(x + 1) for x in k])))


def _resampled(cells: DataFrame, models: list[str], replicates: int, seed: int, n_buckets: int) -> DataFrame:
    """(id, model, metric, x) of each replicate without gathering the cells (y, models, w).

    Buckets are ranges of the score, best first; each cut value is a bucket of
    its own, so ties need no more than that bucket's totals. Replicates' totals
    per bucket are summed first, then every range starts from what precedes it.
    """
    cells = checkpointed(cells.withColumn("cell", F.xxhash64("y", *models)))
    parts = None
    for m in models:
        cuts = sorted(set(cells.stat.approxQuantile(m, [i / n_buckets for i in range(n_buckets + 1)], 0.25 / n_buckets)), reverse=True)
        n = 2 * len(cuts) + 2
        higher = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col(m)))
        rows = cells.select("y", "w", "cell", F.col(m).alias("s"), (2 * higher + F.col(m).isin(cuts).cast("int")).alias("b"))

        def totals(pdfs, n=n):
            p, q = np.zeros((replicates + 1, n)), np.zeros((replicates + 1, n))
            for t in pdfs:
                b, y, cell, w = (t[c].to_numpy() for c in ("b", "y", "cell", "w"))
                for r in range(-1, replicates):
                    k = _poisson(cell, w, seed, r)
                    p[r + 1] += np.bincount(b, k * y, n)
                    q[r + 1] += np.bincount(b, k * (1 - y), n)
            i, b = np.nonzero(p + q)
            yield pd.DataFrame({"id": i - 1, "b": b, "p": p[i, b], "n": q[i, b]})

        sums = rows.mapInPandas(totals, "id int, b int, p double, n double").groupBy("id", "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        w = W.partitionBy("id")
        upto = w.orderBy("b").rowsBetween(W.unboundedPreceding, 0)
        sums = checkpointed(sums.select("id", "b", "p", "n", (F.sum("p").over(upto) - F.col("p")).alias("p0"), (F.sum("n").over(upto) - F.col("n")).alias("n0"), F.sum("p").over(w).alias("pp"), F.sum("n").over(w).alias("nn")))

        def ranked(t, start):
            t = t.sort_values("s", ascending=False, kind="stable")
            s, y, cell, w = (t[c].to_numpy() for c in ("s", "y", "cell", "w"))
            ends = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
            out = []
            for r, p0, n0 in zip(start["id"], start["p0"], start["n0"]):
                k = _poisson(cell, w, seed, int(r))
                tp, fp = p0 + np.cumsum(k * y)[ends], n0 + np.cumsum(k * (1 - y))[ends]
                p, n = np.diff(tp, prepend=p0), np.diff(fp, prepend=n0)
                out.append((r, (n * (tp - p / 2)).sum(), (p * tp / np.maximum(tp + fp, 1e-300)).sum()))
            return pd.DataFrame(out, columns=["id", "area", "ap"])

        ranges = rows.where("b % 2 = 0").groupBy("b").cogroup(sums.where("b % 2 = 0").groupBy("b")).applyInPandas(ranked, "id int, area double, ap double")
        tp, fp = F.col("p0") + F.col("p"), F.col("n0") + F.col("n")
        ties = sums.where("b % 2 = 1").select("id", (F.col("n") * (tp - F.col("p") / 2)).alias("area"), (F.col("p") * tp / (tp + fp)).alias("ap"))
        whole = sums.groupBy("id").agg(F.max("pp").alias("pp"), F.max("nn").alias("nn")).where("pp > 0 and nn > 0")
        got = ranges.unionByName(ties).groupBy("id").agg(F.sum("area").alias("area"), F.sum("ap").alias("ap")).join(whole, "id")
        each = F.explode(F.array(F.struct(F.lit("auroc").alias("metric"), (F.col("area") / F.col("pp") / F.col("nn")).alias("x")), F.struct(F.lit("average_precision").alias("metric"), (F.col("ap") / F.col("pp")).alias("x"))))
        x = checkpointed(got.select("id", F.lit(m).alias("model"), each.alias("v")).select("id", "model", "v.metric", "v.x"))
        if parts is None:
            parts, first = x, x.select("id", "metric", F.col("x").alias("x0"))
        else:
            parts = parts.unionByName(x).unionByName(x.join(first, ["id", "metric"]).select("id", F.lit(f"{m} - {models[0]}").alias("model"), "metric", (F.col("x") - F.col("x0")).alias("x")))
    return parts


def bootstrap(df: DataFrame, label: str, models: list[str], replicates: int = 1000, seed: int = 42, max_cells: int = 1_000_000) -> DataFrame:
    """Percentile intervals of each model's metrics and of the differences to the first: (model, metric, estimate, lo, hi).

    All models share a replicate's resample. The rows are first reduced to
    distinct (label, scores) with counts. Up to max_cells, multinomial counts over
    those are drawn from a broadcast table; beyond it Poisson counts of the same
    means are drawn where the rows lie and ranked over range buckets (_resampled).
    The estimate is exact either way. Replicates with one class are skipped.
    """
    spark = df.sparkSession
    rows = df.select(F.col(label).cast("int").alias("y"), *[F.col(m).cast("double").alias(m) for m in models]).dropna()
    cells = rows.groupBy("y", *models).agg(F.count("*").alias("w"))
    if (n := cells.count()) > max_cells:
        return _intervals(_resampled(cells, models, replicates, seed, -(-n // ROWS_PER_BUCKET)))
    shared = spark.sparkContext.broadcast(cells.orderBy("y", *models).toPandas())

    def run(batches):
        t = shared.value
        y, w = t["y"].to_numpy(float), t["w"].to_numpy(float)
        for pdf in batches:
            out = []
            for r in pdf["id"]:
                k = np.random.default_rng([seed, int(r)]).multinomial(int(w.sum()), w / w.sum()).astype(float) if r >= 0 else w
                if (k * y).sum() in (0, k.sum()):
                    continue
                got = [_metrics(y, t[m].to_numpy(float), k) for m in models]
                for m, g in zip(models, got):
                    out += [(r, m, "auroc", g[0]), (r, m, "average_precision", g[1])]
                for m, g in list(zip(models, got))[1:]:
                    out += [(r, f"{m} - {models[0]}", "auroc", g[0] - got[0][0]), (r, f"{m} - {models[0]}", "average_precision", g[1] - got[0][1])]
            yield pd.DataFrame(out, columns=["id", "model", "metric", "x"])

    if not len(shared.value):
        return spark.createDataFrame([], "model string, metric string, estimate double, lo double, hi double")
    reps = spark.range(-1, replicates, 1, 16).mapInPandas(run, "id bigint, model string, metric string, x double")
    return _intervals(reps)


def _intervals(reps: DataFrame) -> DataFrame:
    """Estimate (id -1) and percentiles of (id, model, metric, x)."""
    return reps.groupBy("model", "metric").agg(F.max(F.when(F.col("id") < 0, F.col("x"))).alias("estimate"), F.expr("percentile(x, 0.025) filter (where id >= 0)").alias("lo"), F.expr("percentile(x, 0.975) filter (where id >= 0)").alias("hi"))


def class_weight(df: DataFrame, label: Column) -> DataFrame:
    """One row `pos_weight`: negatives per positive, 1 without positives."""
    return df.agg(F.coalesce(F.count_if(label == 0) / F.nullif(F.count_if(label == 1), F.lit(0)), F.lit(1.0)).alias("pos_weight"))


def cohort_summary(df: DataFrame, entity: Column, label: Column, n_visits: Column) -> DataFrame:
    """n_rows, n_entities, n_pos, pos_rate, multi_visit_share; the share is over all rows."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(entity).alias("n_entities"), F.count_if(label == 1).alias("n_pos"), F.avg(label.cast("double")).alias("pos_rate"), F.avg((n_visits > 1).cast("double")).alias("multi_visit_share"))


def quartiles(df: DataFrame, values: list[str], by: str) -> DataFrame:
    """(variable, group, n, mean, sd, q1, median, q3) of each value per group, exact."""
    long = df.select(by, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in values])).alias("r")).select(F.col(by).alias("group"), "r.variable", "r.x").where("x is not null")
    return long.groupBy("variable", "group").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.expr("percentile(x, 0.25)").alias("q1"), F.expr("percentile(x, 0.5)").alias("median"), F.expr("percentile(x, 0.75)").alias("q3"))


def level_shares(df: DataFrame, value: Column, by: str) -> DataFrame:
    """(group, level, n, percent) of a categorical value per group; null is a level of its own."""
    per = df.groupBy(F.col(by).alias("group"), F.coalesce(value.cast("string"), F.lit("missing")).alias("level")).agg(F.count("*").alias("n"))
    return per.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("group")))


def coverage(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, n_covered and percent of rows whose keys occur in `known`."""
    k = known.select(*keys).distinct().withColumn("__k", F.lit(1))
    return rows.join(k, keys, "left").agg(F.count("*").alias("n_rows"), F.count("__k").alias("n_covered"), (100.0 * F.count("__k") / F.nullif(F.count("*"), F.lit(0))).alias("percent"))
