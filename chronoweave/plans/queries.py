"""Queries over the domain tables, one or more for each operator: (spark, data directory) -> DataFrame.

Doubles are rounded to six digits and arrays are joined to strings, so that
results can be compared across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.common import checkpointed, clean_id, table
from chronoweave.config import Config
from chronoweave.functions import arrays as A
from chronoweave.functions import stats as S
from chronoweave.functions import text as X
from chronoweave.operators import attribution as At
from chronoweave.operators import clustering as Cl
from chronoweave.operators import cohort as Co
from chronoweave.operators import matching as Ma
from chronoweave.operators import metrics as Me
from chronoweave.operators import mining as Mi
from chronoweave.operators import models as Mo
from chronoweave.operators import perturb as Pe
from chronoweave.operators import relational as Re
from chronoweave.operators import reports as Rp
from chronoweave.operators import risk as Ri
from chronoweave.sources import tables as So
from chronoweave.streaming import visits as St

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    """Register f(context) as a query of its name, doubles rounded."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = f(Context(spark, d))
        cols = [F.round(c, 6).alias(c) if isinstance(out.schema[c].dataType, T.DoubleType) else F.col(c) for c in out.columns]
        return out.select(*cols)

    run.__doc__ = f.__doc__
    QUERIES[f.__name__] = run
    return run


class Context:
    """The intermediate tables of one data directory, each built once per query."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.d, name)

    @cached_property
    def visits(self) -> DataFrame:
        return Co.visits(self.t("admissions"))

    @cached_property
    def labelled(self) -> DataFrame:
        return Co.followup_labels(self.visits, 30, ("ELECTIVE",))

    @cached_property
    def index(self) -> DataFrame:
        return Co.index_visits(self.labelled)

    @cached_property
    def conditions(self) -> DataFrame:
        return Co.condition_tokens(self.t("diagnoses"), ("Z",))

    @cached_property
    def entity_tokens(self) -> DataFrame:
        """(entity, visit, visit_idx, token, first_rank) of the index histories."""
        return Co.history(self.visits, self.index).join(self.conditions, "visit")

    @cached_property
    def seq(self) -> DataFrame:
        return At.sequence_rows(self.t("sequences"))

    @cached_property
    def tokens(self) -> DataFrame:
        return At.token_rows(self.seq)

    @cached_property
    def weights(self) -> DataFrame:
        return At.sequence_weights(self.seq)

    @cached_property
    def attr(self) -> DataFrame:
        return At.linear_attributions(self.tokens, self.weights)

    @cached_property
    def marked(self) -> DataFrame:
        return checkpointed(At.mass_selected(self.attr))

    @cached_property
    def blocks(self) -> DataFrame:
        return checkpointed(At.salient_blocks(self.marked))

    @cached_property
    def arrays(self) -> DataFrame:
        return At.block_arrays(self.blocks)

    @cached_property
    def block_sums(self) -> DataFrame:
        return At.block_token_sums(self.marked, self.blocks)

    @cached_property
    def patterns(self) -> DataFrame:
        """Every pattern of up to four items at the library's support, over all sequences."""
        return checkpointed(Mi.pattern_table(Mi.mine_episodes(self.arrays, Config().min_support, Config().max_items)))

    @cached_property
    def carriers(self) -> DataFrame:
        return checkpointed(Mi.carriers(self.patterns, self.arrays))

    @cached_property
    def scored(self) -> DataFrame:
        steps = self.patterns.select("pattern_id", "n_steps", "n_tokens")
        return Mi.scored(self.carriers, self.seq.select("key", "y"), 1, with_p=False).join(steps, "pattern_id")

    @cached_property
    def instances(self) -> DataFrame:
        return Ma.instance_scores(self.carriers, self.patterns, self.block_sums)

    @cached_property
    def stats(self) -> DataFrame:
        return Ma.pattern_stats(self.instances, self.scored)

    @cached_property
    def scores(self) -> DataFrame:
        s = At.scores(self.attr)
        return s.select("key", "y", F.round("score", 9).alias("score"))

    @cached_property
    def risk(self) -> DataFrame:
        return Ri.risk_index(self.visits, self.t("diagnoses"), acute=("EMERGENCY", "URGENT"))

    @cached_property
    def cohort(self) -> DataFrame:
        people = self.t("patients").select(clean_id("subject_id").alias("entity"), "gender", "anchor_age").where("entity is not null").groupBy("entity").agg(F.min("gender").alias("gender"), F.max("anchor_age").alias("age"))
        return self.index.join(people, "entity", "left").join(self.risk.select("visit", "score", "days"), "visit", "left")


# Cohort and tokens


@query
def visits(c: Context) -> DataFrame:
    return c.visits.select("entity", "visit", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "kind")


@query
def label_30d(c: Context) -> DataFrame:
    return Co.followup_labels(c.visits, 30).select("visit", "label")


@query
def label_30d_unplanned(c: Context) -> DataFrame:
    return c.labelled.select("visit", "label")


@query
def index_visit(c: Context) -> DataFrame:
    return c.index


@query
def token_union(c: Context) -> DataFrame:
    s = c.t("samples").select(clean_id("index_hadm_id").alias("visit"), F.explode("flat_tokens").alias("token")).where("visit is not null")
    return Co.token_union(c.conditions, s).groupBy("token").agg(F.count("*").alias("n_visits"))


@query
def frequency_ceiling(c: Context) -> DataFrame:
    s = c.t("samples").select(clean_id("index_hadm_id").alias("visit"), F.explode("flat_tokens").alias("token")).where("visit is not null").distinct()
    return Co.frequent_excluded(s, "D", 0.1).where(X.stream("token") == "D").groupBy("token").agg(F.count("*").alias("n_visits"))


@query
def excluded_names(c: Context) -> DataFrame:
    return Co.names_excluded(c.t("ndc_to_ingredient").distinct(), "drug_name", ("patch", "syrup")).groupBy("source").agg(F.count("*").alias("n"))


@query
def first_occurrence(c: Context) -> DataFrame:
    return Co.first_occurrences(c.entity_tokens).groupBy("entity").agg(F.count("*").alias("n"), F.sum("visit_idx").alias("idx_sum"))


@query
def chronic_filter(c: Context) -> DataFrame:
    return Co.chronic_filtered(c.entity_tokens, ("C5", "E6")).groupBy("entity").agg(F.count("*").alias("n"))


@query
def crosswalk(c: Context) -> DataFrame:
    m = c.t("ndc_to_ingredient").select(clean_id("rxcui").alias("rxcui"), clean_id("ingredient_rxcui").alias("ingredient"))
    return Co.one_to_one(m, "rxcui", "ingredient")


@query
def harmonized_codes(c: Context) -> DataFrame:
    m = c.t("ndc_to_ingredient").select(clean_id("rxcui").alias("rxcui"), clean_id("ingredient_rxcui").alias("ingredient"))
    rows = c.t("ndc_to_ingredient").select("map_id", clean_id("rxcui").alias("code")).distinct()
    return Co.harmonized(rows, "code", m, "rxcui", "ingredient")


@query
def drug_map_tokens(c: Context) -> DataFrame:
    m = c.t("ndc_to_ingredient")
    return Co.drug_tokens(m.where("source = 'ndc_api'").select(F.col("map_id").cast("string").alias("v"), "ndc"), "v", "ndc", m.select("ndc", "ingredient_rxcui"))


@query
def vocabulary(c: Context) -> DataFrame:
    return Co.vocabulary(c.tokens)


@query
def framed_sequences(c: Context) -> DataFrame:
    return Co.framed(c.entity_tokens, 24, 24).select("entity", F.array_join("tokens", " ").alias("tokens"))


@query
def encoded_sequences(c: Context) -> DataFrame:
    e = Co.encoded(c.seq.select(F.col("key").alias("entity"), "tokens"), Co.vocabulary(c.tokens))
    return e.select("entity", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("ids"))


@query
def split_by_entity(c: Context) -> DataFrame:
    return Co.entity_split(c.visits.select("entity").distinct(), "entity")


@query
def split_stored(c: Context) -> DataFrame:
    s = Co.entity_split(c.visits.select("entity").distinct(), "entity")
    lists = [s.where(F.col("split") == n).select("entity") for n in ("train", "val", "test")]
    return Co.stored_split(c.visits.select("entity", "visit"), "entity", *lists).groupBy("split").agg(F.count("*").alias("n"))


@query
def entity_subsample(c: Context) -> DataFrame:
    return Co.subsample(c.visits, "entity", 50)


# Sources and scalar functions


@query
def title_dictionary(c: Context) -> DataFrame:
    return So.titles(c.t("d_icd_diagnoses"))


@query
def drug_dictionary(c: Context) -> DataFrame:
    return So.drug_names(c.t("ndc_to_ingredient"))


@query
def token_labels(c: Context) -> DataFrame:
    t = So.token_titles(c.tokens, So.titles(c.t("d_icd_diagnoses")), So.drug_names(c.t("ndc_to_ingredient")))
    return t.select("token", "stream", X.code_version("token").alias("version"), "code", X.shortened(X.readable("token", "title"), 30).alias("label"), X.canonical_label("title").alias("canonical"))


@query
def short_titles(c: Context) -> DataFrame:
    t = So.titles(c.t("d_icd_diagnoses"))
    short = X.abbreviated("title", {"Acute injury of airway": "Airway injury"}, [("Congenital", "Cong."), ("Chronic", "Chr."), ("Recurrent", "Rec.")], [(", unspecified", ""), ("connective tissue", "conn. tissue")])
    return t.select("code", short.alias("short_title"))


@query
def ndc_normalized(c: Context) -> DataFrame:
    return c.t("ndc_to_ingredient").select("ndc").distinct().select("ndc", X.ndc11("ndc").alias("ndc11"))


@query
def pattern_text(c: Context) -> DataFrame:
    """Patterns rendered, parsed back and measured."""
    p = c.t("mined_patterns_train").select("pattern_id", X.canonical("pattern_key").alias("k")).distinct()
    return p.select("pattern_id", X.rendered("k").alias("text"), F.size(F.array_distinct(F.flatten("k"))).alias("n_distinct"), F.size("k").alias("n_steps"), (X.parsed(X.rendered("k")) == F.col("k")).alias("same"), X.rendered(F.reverse("k")).alias("reversed"))


@query
def pattern_filters(c: Context) -> DataFrame:
    """Multi-token cross-visit patterns with enough carriers."""
    p = c.t("mined_patterns_train").where((F.size("pattern_key") >= 2) & (F.size(F.array_distinct(F.flatten("pattern_key"))) >= 2) & (F.col("n_admissions_present") >= 5))
    return p.select("pattern_id", "pattern").distinct()


# Joins, aggregates, windows


@query
def emergency_lookback(c: Context) -> DataFrame:
    v = c.visits.withColumn("acute", F.coalesce(F.col("kind").isin("EMERGENCY", "URGENT"), F.lit(False)))
    return Ri.recent_count(v, "entity", "start", F.col("acute")).select("visit", "n_recent")


@query
def emergency_lookback_table(c: Context) -> DataFrame:
    ed = c.visits.where(F.col("kind").isin("EMERGENCY", "URGENT")).select("entity", F.col("start").alias("at"))
    return Ri.recent_count_between(c.visits, ed, "entity", "start", "at").select("visit", "n_recent")


@query
def comorbidity(c: Context) -> DataFrame:
    return Ri.comorbidity(c.t("diagnoses")).select("visit", F.col("index").alias("weight"), F.array_join("categories", ",").alias("categories"))


@query
def risk_index(c: Context) -> DataFrame:
    return c.risk.select("visit", "score", "l", "a", "c", "e", F.col("index").alias("weight"), "days")


@query
def risk_components_by_label(c: Context) -> DataFrame:
    return c.cohort.groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("days").alias("mean_days"))


@query
def risk_auroc(c: Context) -> DataFrame:
    return Me.auroc(c.labelled.join(c.risk, "visit"), F.col("score"), F.col("label"))


@query
def cohort_quartiles(c: Context) -> DataFrame:
    return Me.quartiles(c.cohort, ["age", "n_visits", "score"], "label").withColumnRenamed("group", "label")


@query
def cohort_levels(c: Context) -> DataFrame:
    return Me.level_shares(c.cohort, F.col("gender"), "label").withColumnRenamed("group", "label")


@query
def cohort_summary(c: Context) -> DataFrame:
    return Me.cohort_summary(c.index, F.col("entity"), F.col("label"), F.col("n_visits"))


@query
def key_coverage(c: Context) -> DataFrame:
    s = c.t("samples").select(clean_id("patient_id").alias("entity"), clean_id("index_hadm_id").alias("visit"))
    return Me.coverage(s, c.visits, ["entity", "visit"])


@query
def upserted_map(c: Context) -> DataFrame:
    m = c.t("ndc_to_ingredient").where("drug_name is not null and source is not null").select("drug_name", "map_id", "ingredient_rxcui", "source")
    return Re.upserted(m.where("source = 'ndc_api'"), m.where("source = 'drugname_api'"), ["drug_name"]).select("drug_name", "map_id", "source")


@query
def pending_keys(c: Context) -> DataFrame:
    m = c.t("ndc_to_ingredient").where("drug_name is not null")
    return Re.pending(m.where("source = 'drugname_api'").select("drug_name").distinct(), m.where("source = 'ndc_api'"), ["drug_name"])


@query
def same_keys(c: Context) -> DataFrame:
    return Re.same_keys(c.visits.select("visit"), c.t("diagnoses").select(clean_id("hadm_id").alias("visit")).where("visit is not null"), "visit")


@query
def finite_rows(c: Context) -> DataFrame:
    return Re.finite(c.cohort, ["age", "score", "days"]).agg(F.count("*").alias("n"))


# Attribution


@query
def token_weights(c: Context) -> DataFrame:
    return c.weights


@query
def attribution_totals(c: Context) -> DataFrame:
    return c.attr.groupBy("key").agg(F.count("*").alias("n"), F.sum("attr").alias("net"), F.sum(F.abs("attr")).alias("mass"))


@query
def mass_selection(c: Context) -> DataFrame:
    return c.marked.where("is_salient").select("key", "pos", "token")


@query
def reselected_tokens(c: Context) -> DataFrame:
    return At.reselected(c.attr, 0.6).where("is_salient").groupBy("key").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query
def salient_blocks(c: Context) -> DataFrame:
    return c.blocks.select("key", "block_idx", "visit_idx", F.array_join("items", ",").alias("items"))


@query
def visit_token_sums(c: Context) -> DataFrame:
    return At.visit_token_sums(c.attr).groupBy("token").agg(F.count("*").alias("n"), F.sum("attr_sum").alias("attr_sum"))


@query
def block_token_sums(c: Context) -> DataFrame:
    return c.block_sums.groupBy("token").agg(F.count("*").alias("n"), F.sum("attr_sum").alias("attr_sum"))


@query
def token_importance(c: Context) -> DataFrame:
    return At.token_importance(c.attr)


@query
def occurrence_means(c: Context) -> DataFrame:
    return At.occurrence_means(c.attr)


@query
def stream_pivot(c: Context) -> DataFrame:
    return At.stream_means(c.attr)


@query
def entity_token_matrix(c: Context) -> DataFrame:
    return At.entity_token_matrix(c.attr)


@query
def net_over_visits(c: Context) -> DataFrame:
    return At.net_over_visits(c.attr)


@query
def score_histogram(c: Context) -> DataFrame:
    return At.histogram(c.scores, F.col("score"))


@query
def score_spread(c: Context) -> DataFrame:
    return At.spread(c.scores, F.col("score"))


@query
def compression(c: Context) -> DataFrame:
    return At.compression(c.marked)


@query
def scaled_attributions(c: Context) -> DataFrame:
    s = Re.scaled_by_max(c.attr, "attr", "key")
    return s.groupBy("stream").agg(F.avg("scaled").alias("mean_scaled"))


# Mining and scoring


@query
def episodes_len2(c: Context) -> DataFrame:
    """Episode mining with at most two items, over all sequences with a salient block."""
    return Mi.mine_episodes(c.arrays, 0.02, 2).select(X.rendered("pattern").alias("pattern"), "support")


@query
def episodes_len4(c: Context) -> DataFrame:
    return Mi.mine_episodes(c.arrays, 0.02, 4).select(X.rendered("pattern").alias("pattern"), "support")


@query
def episode_pairs(c: Context) -> DataFrame:
    """The same patterns of at most two items by self-joins."""
    n = c.arrays.count()
    return Mi.pair_episodes(c.blocks, max(1, -(-2 * n // 100))).select(X.rendered("pattern").alias("pattern"), "support")


@query
def flat_sequences(c: Context) -> DataFrame:
    return Mi.mine_flat(c.seq, 0.1, 2, 3).select(X.rendered("pattern").alias("pattern"), "support")


@query
def ngram_support(c: Context) -> DataFrame:
    s = Mi.ngram_sets(c.seq, 1, 2)
    often = Mi.frequent_in_a_group(s, "ngram", 0.02)
    return s.join(often, "ngram", "left_semi").groupBy("ngram").agg(F.count("*").alias("n_keys"))


@query
def episode_carriers(c: Context) -> DataFrame:
    return c.carriers.select("pattern_id", "key", F.element_at("hits", 1).alias("first_block"), F.element_at("hits", -1).alias("last_block"))


@query
def pattern_scores(c: Context) -> DataFrame:
    return c.scored


@query
def pattern_pvalues(c: Context) -> DataFrame:
    return Mi.scored(c.carriers, c.seq.select("key", "y"), 1)


@query
def table_statistics(c: Context) -> DataFrame:
    """Odds ratio and chi-square recomputed from the delivered 2x2 counts."""
    a, b = F.col("n_present_readmit1"), F.col("n_present_readmit0")
    x, y = F.col("n_total_readmit1") - a, F.col("n_total_readmit0") - b
    rows = c.t("mined_patterns_train").where("n_present_readmit1 is not null")
    return rows.select("pattern_id", S.odds_ratio(a, b, x, y).alias("odds_ratio"), S.chi2_yates(a, b, x, y).alias("chi2")).distinct()


@query
def capped_patterns(c: Context) -> DataFrame:
    return Mi.capped(c.scored.withColumn("odds_ratio", F.round("odds_ratio", 9)), 10).select("pattern_id", "n_steps", "odds_ratio")


@query
def capped_by_prevalence(c: Context) -> DataFrame:
    return Mi.capped(c.scored.withColumn("prev_diff", F.round("prev_diff", 9)), 10, "prev_diff").select("pattern_id", "prev_diff")


@query
def balanced_patterns(c: Context) -> DataFrame:
    return Mi.balanced_top(c.stats.withColumn("attr_mean", F.round("attr_mean", 9)), F.col("attr_mean"), 10, "pattern_id").select("pattern_id", "attr_mean", F.col("rank"))


@query
def odds_extremes(c: Context) -> DataFrame:
    return Re.odds_top(c.scored.withColumn("odds_ratio", F.round("odds_ratio", 9)), 5).select("pattern_id", "odds_ratio", "side")


@query
def mined_by_group(c: Context) -> DataFrame:
    """The dispatcher: groups mined apart, pooled, located over everyone, scored."""
    return Mi.mine_and_score(checkpointed(c.arrays.join(c.seq.select("key", "tokens"), "key")), 0.05, max_items=2, cap=20)


@query
def ngrams_scored(c: Context) -> DataFrame:
    return Mi.mine_and_score(c.seq, 0.02, max_items=2, method="ngram", with_p=False).select("pattern_id", "n_present", "odds_ratio", "chi2")


@query
def pooled_patterns(c: Context) -> DataFrame:
    g = c.carriers.join(c.seq.select("key", "y"), "key").join(c.patterns, "pattern_id").groupBy("pattern", "y").agg(F.count("*").alias("n")).where("n >= 3")
    pos, neg = g.where("y = 1"), g.where("y = 0")
    only = Mi.one_sided(pos, neg).groupBy("side").agg(F.count("*").alias("n"))
    return only.unionByName(Mi.pooled_patterns(pos, neg).agg(F.lit("pooled").alias("side"), F.count("*").alias("n")))


# Matching and explanation


@query
def instance_scores(c: Context) -> DataFrame:
    return c.instances


@query
def pattern_stats(c: Context) -> DataFrame:
    return c.stats


@query
def occurrence_scores(c: Context) -> DataFrame:
    return Ma.occurrences(c.patterns, c.attr)


@query
def matched_positions(c: Context) -> DataFrame:
    m = Ma.matched_positions(c.patterns, c.tokens)
    return m.select("pattern_id", "key", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query
def order_contrast(c: Context) -> DataFrame:
    return Ma.order_contrast(c.patterns, c.arrays, c.scores)


@query
def token_means_in_patterns(c: Context) -> DataFrame:
    return Ma.token_means_in_patterns(c.carriers, c.patterns, c.block_sums)


@query
def explanations(c: Context) -> DataFrame:
    return Ma.explanation(c.attr.withColumn("attr", F.round("attr", 9)), c.carriers, c.patterns, c.block_sums, 5)


@query
def exemplars(c: Context) -> DataFrame:
    m = c.instances.select("key", "pattern_id", F.abs("score").alias("value"))
    return Ma.exemplars(m, c.patterns, facts=c.seq)


@query
def carrier_similarity(c: Context) -> DataFrame:
    return Cl.carrier_pairs(c.carriers, 0.2)


@query
def leader_clusters(c: Context) -> DataFrame:
    ranked = c.stats.select("pattern_id", F.row_number().over(W.orderBy(F.desc(F.abs(F.round("attr_mean", 9))), "pattern_id")).alias("rank"))
    return Cl.leader_clusters(Cl.carrier_pairs(c.carriers, 0.2), ranked, 0.2)


@query
def cluster_report(c: Context) -> DataFrame:
    ranked = c.stats.select("pattern_id", F.row_number().over(W.orderBy(F.desc(F.abs(F.round("attr_mean", 9))), "pattern_id")).alias("rank"))
    stats = c.stats.select("pattern_id", "attr_mean", F.col("n_carriers").alias("n_present"), "odds_ratio")
    return Cl.cluster_table(Cl.leader_clusters(Cl.carrier_pairs(c.carriers, 0.2), ranked, 0.2), stats)


@query
def merged_clusters(c: Context) -> DataFrame:
    order = c.scored.select("pattern_id", F.row_number().over(W.orderBy(F.desc("n_present"), "pattern_id")).alias("rank"))
    return Cl.merged_clusters(c.carriers, order, 0.2)


@query
def threshold_stability(c: Context) -> DataFrame:
    return Rp.threshold_stability(c.attr, [0.6, 0.8], 0.8, 0.02)


# Metrics, perturbation, models


@query
def auroc(c: Context) -> DataFrame:
    return Me.auroc(c.scores, F.col("score"), F.col("y"))


@query
def average_precision(c: Context) -> DataFrame:
    return Me.average_precision(c.scores, F.col("score"), F.col("y"))


@query
def roc_curve(c: Context) -> DataFrame:
    return Me.curves(c.scores, F.col("score"), F.col("y")).select(F.col("s").alias("threshold"), "tp", "fp", "tpr", "fpr", "precision")


@query
def class_weight(c: Context) -> DataFrame:
    return Me.class_weight(c.seq, F.col("y"))


@query
def bootstrap_intervals(c: Context) -> DataFrame:
    rows = c.scores.where("y is not null").withColumn("other", F.round(F.pmod(F.xxhash64("key"), F.lit(1000)) / 1000, 3))
    return Me.bootstrap(rows, "y", ["score", "other"], 200)


@query
def perturbation_validation(c: Context) -> DataFrame:
    """Every carrier of every pattern; the library's number of draws where a sequence's visits have more orders than that."""
    return Pe.validate(c.patterns, c.tokens, Pe.linear_scorer(c.weights), Config().n_draws)


def _held_out(c: Context, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (with entity) of the train and of the test split, by entity."""
    split = checkpointed(Co.entity_split(rows, "entity"))
    return split.where("split = 'train'"), split.where("split = 'test'")


def _ranking(scored: DataFrame, model: str, label: str = "label") -> DataFrame:
    s = checkpointed(scored)
    return Me.auroc(s, F.col("score"), F.col(label)).join(Me.average_precision(s, F.col("score"), F.col(label))).withColumn("model", F.lit(model))


@query
def risk_models(c: Context) -> DataFrame:
    """Ranking of the test split by the plain score and by logistic models on the total and on the components, fitted on the train split."""
    cols = ("score", "l", "a", "c", "e")
    train, test = _held_out(c, c.labelled.select("entity", "visit", "label").join(c.risk.drop("entity"), "visit").select("entity", "label", *[F.col(x).cast("double").alias(x) for x in cols]))
    out = _ranking(test, "plain")
    for name, own in (("total", ["score"]), ("components", ["l", "a", "c", "e"])):
        out = out.unionByName(_ranking(Mo.with_score(Mo.train_columns(train, own, "label"), test), name))
    return out


@query
def token_model(c: Context) -> DataFrame:
    """A logistic model over hashed tokens, trained on the train split and scored on the test split."""
    rows = Co.entity_split(c.seq.withColumn("entity", F.split_part("key", F.lit("|"), F.lit(1))), "entity").where("y is not null")
    m = Mo.train_tokens(rows.where("split = 'train'").select("tokens", "y"), max_iter=20)
    s = Mo.with_score(m, rows.where("split = 'test'").select("key", "tokens", "y"))
    return Me.auroc(s, F.col("score"), F.col("y"))


def _encoded(c: Context, length: int = 512) -> tuple[DataFrame, Mo.Encoder]:
    """All sequences (key, input_ids, and at: where in its sequence each id stands) and an untrained encoder.

    Beyond the encoder's 512 positions the first token and the tail are kept;
    tokens outside the vocabulary are left out.
    """
    v = Co.vocabulary(c.tokens)
    at = F.posexplode("tokens").alias("pos", "token")
    rows = c.seq.select("key", F.size("tokens").alias("n"), at).where((F.col("pos") == 0) | (F.col("pos") > F.col("n") - length)).join(v.select("token", "id"), "token")
    ids = F.array_sort(F.collect_list(F.struct("pos", "id")))
    e = rows.groupBy("key").agg(ids.alias("x")).select("key", F.transform("x", lambda x: x["id"]).alias("input_ids"), F.transform("x", lambda x: x["pos"]).alias("at"))
    return checkpointed(e), Mo.Encoder.random(v.count() + 3, 16, 2, 1, length)


def _placed(positions: DataFrame, encoded: DataFrame) -> DataFrame:
    """(pattern_id, key, positions) in the sequence turned into places among its ids; what the encoder doesn't see is left out."""
    place = F.transform("positions", lambda p: F.array_position("at", p).cast("int") - 1)
    return positions.join(encoded.select("key", "at"), "key").select("pattern_id", "key", F.filter(place, lambda i: i >= 0).alias("positions"))


@query
def encoder_scores(c: Context) -> DataFrame:
    return Mo.predicted(*_encoded(c))


@query
def attention_flow(c: Context) -> DataFrame:
    e, m = _encoded(c)
    return Mo.attention_flow(e, _placed(Ma.matched_positions(c.patterns, c.tokens), e), m)


@query
def extended_models(c: Context) -> DataFrame:
    """Ranking of the test split by a linear and a boosted model over seven features (score parts, age, visits, stay), fitted on the train split."""
    cols = ["l", "a", "c", "e", "age", "n_visits", "days"]
    people = c.cohort.select("entity", "visit", "label", "age", "n_visits")
    train, test = _held_out(c, people.join(c.risk.select("visit", "l", "a", "c", "e", "days"), "visit").select("entity", "label", *[F.col(x).cast("double").alias(x) for x in cols]).dropna())
    linear, boosted = (_ranking(Mo.with_score(Mo.train_columns(train, cols, "label", kind), test), kind) for kind in ("linear", "boosted"))
    return linear.unionByName(boosted)


@query
def encoder_training(c: Context) -> DataFrame:
    """History of an encoder trained on the train split and judged on the validation split."""
    e, start = _encoded(c)
    rows = e.join(c.seq.select("key", "y"), "key").withColumn("entity", F.split_part("key", F.lit("|"), F.lit(1)))
    split = checkpointed(Co.entity_split(rows, "entity"))
    _, history = Mo.train_encoder(split.where("split = 'train'"), split.where("split = 'val'"), start, epochs=3)
    return c.spark.createDataFrame([(h["epoch"], h["train_loss"], h["val_auroc"], h["val_average_precision"]) for h in history], "epoch int, train_loss double, val_auroc double, val_average_precision double")


@query
def path_attributions(c: Context) -> DataFrame:
    """Path attributions of the untrained encoder, summed per sequence."""
    e, m = _encoded(c)
    return Mo.path_attributions(e, m, 30).groupBy("key").agg(F.count("*").alias("n"), F.sum("attr").alias("attr_sum"))


def kernel_values(c: Context, e: DataFrame, m: Mo.Encoder, n: int = 0) -> DataFrame:
    """Masked-subset attributions of each sequence's clinical tokens: of the n of largest absolute path attribution, or with 0 of all."""
    specials = c.spark.createDataFrame([(i,) for i in range(len(X.SPECIALS))], "id int")
    events = e.select("key", F.posexplode("input_ids").alias("pos", "id")).join(F.broadcast(specials), "id", "left_anti").select("key", "pos")
    if n:
        events = At.largest(checkpointed(Mo.path_attributions(e, m)).join(events, ["key", "pos"]), n)
    return Mo.kernel_attributions(e, events.select("key", "pos"), m)


@query
def kernel_attributions(c: Context) -> DataFrame:
    return kernel_values(c, *_encoded(c), 15)


@query
def attribution_comparison(c: Context) -> DataFrame:
    """Per token: how often it occurs, and its mean path and mean kernel attribution side by side, each over all its positions."""
    e, m = _encoded(c)
    both = Mo.token_comparison(e, m, len(X.SPECIALS))
    names = Co.vocabulary(c.tokens).select("id", "token")
    return both.join(names, "id").select("token", F.col("n_path").alias("n_present"), "path", "kernel", (F.signum("path") == F.signum("kernel")).alias("same_sign"))


@query
def token_gradients(c: Context) -> DataFrame:
    e, m = _encoded(c)
    background = [list(r.input_ids) for r in e.orderBy("key").limit(20).collect()]
    return Mo.global_gradients(e, m, background)


@query
def excluded_tokens(c: Context) -> DataFrame:
    return Co.tokens_excluded(c.tokens, ["C:10_C5860", "D:RX_450958"]).agg(F.count("*").alias("n"))


@query
def flat_positions(c: Context) -> DataFrame:
    """First occurrences of one flat pattern, with gaps and unbroken, and of its item-set reading by position."""
    p = ["C:10_C5860", "C:10_E612"]
    found = [Ma.flat_occurrence(c.seq, p, False), Ma.flat_occurrence(c.seq, p, True), Ma.ordered_positions(c.seq, [[p[0]], [p[1]]])]
    rows = [f.select(F.lit(k).alias("kind"), "key", F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos")) for k, f in zip(("gapped", "unbroken", "ordered"), found)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# Reports and streaming


@query
def performance_report(c: Context) -> DataFrame:
    return Rp.performance(c.scores)


@query
def entity_report(c: Context) -> DataFrame:
    return Rp.entity_tokens(c.attr.withColumn("attr", F.round("attr", 9)), 5)


@query
def fallback_patterns(c: Context) -> DataFrame:
    return Rp.pseudo_scored(c.scored.withColumn("odds_ratio", F.round("odds_ratio", 9)), 10).select("pattern_id", "pseudo", "rank")


@query
def conditional_report(c: Context) -> DataFrame:
    return Rp.conditional_impact(c.stats.withColumn("conditional_impact", F.round("conditional_impact", 9)), 5, 5)


@query
def presence_matrix(c: Context) -> DataFrame:
    return Rp.presence(c.carriers, 10, 30)


@query
def importance_panel(c: Context) -> DataFrame:
    tokens = At.token_importance(c.attr).select(F.col("token").alias("name"), F.round("attr_mean", 9).alias("value"))
    pats = c.stats.select(F.col("pattern_id").alias("name"), F.round("attr_mean", 9).alias("value"))
    return Re.tagged_top(tokens, pats, ("token", "pattern"), "value", "name", 20)


@query
def rounded_ranking(c: Context) -> DataFrame:
    rows = c.stats.join(c.patterns.select("pattern_id", "n_steps"), "pattern_id").withColumn("attr_mean", F.round("attr_mean", 9))
    return Re.rounded_rank(rows, "attr_mean", "n_steps", "pattern_id").select("pattern_id", "rank")


@query
def imputed_patterns(c: Context) -> DataFrame:
    right = c.stats.where(F.col("n_carriers") % 2 == 0).select("pattern_id", "conditional_impact")
    left = c.scored.select("pattern_id", "odds_ratio")
    return Re.imputed_join(left, right, "pattern_id", ["conditional_impact"], F.col("odds_ratio") > 1).select("pattern_id", "conditional_impact")


@query
def union_of_tops(c: Context) -> DataFrame:
    """Per entity: its largest tokens by value, then those by absolute value, at most six."""
    return Rp.union_of_tops(c.attr.withColumn("attr", F.round("attr", 9)), 4, 6)


@query
def characteristics(c: Context) -> DataFrame:
    return Rp.characteristics(c.seq, c.marked)


@query
def event_sessions(c: Context) -> DataFrame:
    s = St.sessions(c.t("events"))
    return s.select("user_id", F.unix_seconds("start").alias("start_s"), "n_events", F.array_join("tokens", ",").alias("tokens"))


@query
def session_episodes(c: Context) -> DataFrame:
    return Mi.mine_episodes(St.session_sequences(St.sessions(c.t("events"), "1 hour")), 0.5, 2).select(X.rendered("pattern").alias("pattern"), "support")
