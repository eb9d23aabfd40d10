"""One object for a whole run: attributions, patterns, explanations, validation, report.

Every step is a pure function of DataFrames elsewhere; this only wires them and
keeps artefacts. With a cache folder each artefact is a parquet table named by
the settings it depends on; nothing is ever deleted, other settings make another
table. Raw patterns mined at a support serve any higher one by filtering.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.common import checkpointed
from chronoweave.config import Config
from chronoweave.functions import text as X
from chronoweave.operators import attribution as At
from chronoweave.operators import clustering as Cl
from chronoweave.operators import matching as Ma
from chronoweave.operators import metrics as Me
from chronoweave.operators import mining as Mi
from chronoweave.operators import perturb as Pe
from chronoweave.operators import reports as Rp
from chronoweave.sources import tables as So


class Pipeline:
    """sequences: the raw sequence table (patient_id, index_hadm_id, readmission, n_visits, combined_full).

    weights: (token, weight) of a linear scorer; by default log odds fitted on
    the sequences that `train` selects.
    """

    def __init__(self, sequences: DataFrame, config: Config = Config(), weights: DataFrame | None = None, train: Column | None = None, cache: str | None = None):
        self.config, self.cache, self.spark = config, cache, sequences.sparkSession
        self.sequences = At.sequence_rows(sequences)
        self.tokens = At.token_rows(self.sequences)
        fitted = At.token_weights(self.tokens.where(train) if train is not None else self.tokens)
        self.weights = (weights if weights is not None else fitted).select("token", "weight")

    @classmethod
    def from_bundle(cls, spark: SparkSession, folder: str, sequences: DataFrame, cache: str | None = None) -> Pipeline:
        config, _, frames = So.load_bundle(spark, folder, ["weights"])
        return cls(sequences, Config(**config), frames["weights"], cache=cache)

    def save_bundle(self, folder: str) -> None:
        from dataclasses import asdict

        scores = self.scores
        metrics = {"auroc": Me.auroc(scores, F.col("score"), F.col("y")).first()[0], "average_precision": Me.average_precision(scores, F.col("score"), F.col("y")).first()[0]}
        So.save_bundle(folder, asdict(self.config), metrics, {"weights": self.weights})

    def _kept(self, name: str, build: Callable[[], DataFrame], *settings: str) -> DataFrame:
        if not self.cache:
            return checkpointed(build())
        path = os.path.join(self.cache, f"{name}-{self.config.digest(*settings)}")
        if not So._exists(self.spark, os.path.join(path, "_SUCCESS")):
            So.save(build(), path)
        return So.load(self.spark, path)

    @cached_property
    def attributions(self) -> DataFrame:
        """Attributed tokens with is_salient."""
        return self._kept("attributions", lambda: At.mass_selected(At.linear_attributions(self.tokens, self.weights), self.config.mass, self.config.max_tokens), "mass", "max_tokens")

    @cached_property
    def scores(self) -> DataFrame:
        return At.scores(self.attributions)

    @cached_property
    def blocks(self) -> DataFrame:
        return self._kept("blocks", lambda: At.salient_blocks(self.attributions), "mass", "max_tokens")

    @cached_property
    def arrays(self) -> DataFrame:
        return checkpointed(At.block_arrays(self.blocks).join(self.sequences.select("key", "tokens"), "key"))

    def raw_patterns(self) -> DataFrame:
        """(pattern, support) pooled over both outcome groups; a table mined at a lower support is filtered instead of mining again."""
        c = self.config
        known = self.arrays.where("y is not null")
        if c.method == "prefix":
            known = known.select("key", "y", F.transform(F.filter("tokens", lambda t: X.is_event(t)), lambda t: F.array(t)).alias("blocks"))
        base = os.path.join(self.cache, f"mined-{c.digest('mass', 'max_tokens', 'max_items', 'method')}") if self.cache else None
        have = []
        if base and So._exists(self.spark, base):
            have = sorted(r[0] for r in self.spark.read.parquet(base).select("at").distinct().collect() if r[0] <= c.min_support)  # one row per support mined so far
        n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
        if not have:
            groups = [Mi.mine_episodes(known.where(F.col("y") == y), c.min_support, c.max_items).withColumn("y", F.lit(y)) for y in sorted(n)]
            mined = groups[0]
            for g in groups[1:]:
                mined = mined.unionByName(g)
            if base:
                mined.withColumn("at", F.lit(c.min_support)).write.mode("append").partitionBy("at").parquet(base)
                have = [c.min_support]
            else:
                return mined
        rows = self.spark.read.parquet(base).where(F.abs(F.col("at") - have[-1]) < 1e-12)
        least = F.create_map(*[F.lit(x) for y in n for x in (y, max(1, -int(-(c.min_support * n[y]) // 1)))])
        return rows.where(F.col("support") >= least[F.col("y")]).select("pattern", "support", "y")

    @cached_property
    def patterns(self) -> DataFrame:
        return checkpointed(Mi.pattern_table(self.raw_patterns()))

    @cached_property
    def carriers(self) -> DataFrame:
        return checkpointed(Mi.carriers(self.patterns, self.arrays))

    @cached_property
    def scored(self) -> DataFrame:
        """Scored patterns after the step, cap and similarity filters of the settings."""
        c = self.config
        if c.method == "ngram":
            return checkpointed(Mi.mine_and_score(self.arrays, c.min_support, c.scoring_frac, c.max_items, "ngram", c.min_steps, c.cap, c.cap_metric))
        known = self.arrays.where("y is not null").select("key", "y")
        out = Mi.scored(self.carriers, known, Mi.support_floor(c.scoring_frac, c.min_support, known.count()))
        out = out.join(self.patterns.select("pattern_id", "n_tokens", "n_steps"), "pattern_id").where(F.col("n_steps") >= c.min_steps)
        if c.dedup:
            order = out.select("pattern_id", F.row_number().over(W.orderBy(F.desc("n_present"), F.desc("n_tokens"), "pattern_id")).alias("rank"))
            lead = Cl.merged_clusters(self.carriers.join(out.select("pattern_id"), "pattern_id", "left_semi"), order, c.dedup)
            out = out.join(lead.where("pattern_id = representative").select("pattern_id"), "pattern_id", "left_semi")
        return checkpointed(Mi.capped(out, c.cap, c.cap_metric) if c.cap else out)

    @cached_property
    def stats(self) -> DataFrame:
        sums = At.block_token_sums(self.attributions, self.blocks)
        return checkpointed(Ma.pattern_stats(Ma.instance_scores(self.carriers, self.patterns, sums), self.scored))

    def explain(self, key: str, top: int = 20) -> DataFrame:
        """Top tokens and matched patterns of one `entity|visit`; no rows if it is unknown."""
        one = F.col("key") == key
        sums = At.block_token_sums(self.attributions.where(one), self.blocks.where(one))
        return Ma.explanation(self.attributions.where(one), self.carriers.where(one), self.patterns, sums, top)

    def validate(self) -> DataFrame:
        kept = self.patterns.join(self.scored.select("pattern_id"), "pattern_id", "left_semi")
        return Pe.validate(kept, self.tokens, Pe.linear_scorer(self.weights), self.config.n_draws, self.config.max_keys, self.config.seed)

    def order_contrast(self) -> DataFrame:
        return Ma.order_contrast(self.patterns, self.arrays, self.scores)

    def compare(self, other: DataFrame, replicates: int = 1000) -> DataFrame:
        """Bootstrap comparison with another score (key, other) on the keys both have."""
        return Me.bootstrap(self.scores.join(other, "key").where("y is not null"), "y", ["score", "other"], replicates, self.config.seed)

    def report(self) -> dict[str, DataFrame]:
        """The tables behind the report."""
        pairs = Cl.carrier_pairs(self.carriers, 0.2, 3)
        ranked = self.stats.select("pattern_id", F.row_number().over(W.orderBy(F.desc(F.abs("attr_mean")), "pattern_id")).alias("rank"))
        stats = self.stats.withColumnRenamed("n_carriers", "n_present").select("pattern_id", "attr_mean", "n_present", "odds_ratio")
        return {
            "performance": Rp.performance(self.scores),
            "tokens": At.token_importance(self.attributions),
            "patterns": self.stats,
            "conditional": Rp.conditional_impact(self.stats),
            "clusters": Cl.cluster_table(Cl.leader_clusters(pairs, ranked, 0.2), stats),
            "streams": At.stream_means(self.attributions),
            "presence": Rp.presence(self.carriers),
            "characteristics": Rp.characteristics(self.sequences, self.attributions),
        }
