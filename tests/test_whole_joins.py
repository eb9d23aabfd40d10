"""Joins of exploded tables don't go through the driver, whatever their estimates say."""

import re

from pyspark.sql import functions as F

from chronoweave import common
from chronoweave.operators import attribution as At
from chronoweave.operators import matching as Ma
from chronoweave.operators import perturb as Pe
from chronoweave.plans.queries import Context


def sequences(spark, folder, n=40):
    data = [(str(i), f"h{i}", [1, 0, None][i % 3], 2, ["[CLS]", "[VISIT]", f"C:10_A{i % 7}", "C:10_B", "C:10_B", "[VISIT]", f"D:RX_{i % 5}", None]) for i in range(n)]
    spark.createDataFrame([*data, ("x", "y", 1, 1, ["[CLS]"])], "patient_id string, index_hadm_id string, readmission int, n_visits int, combined_full array<string>").coalesce(1).write.parquet(f"{folder}/sequences.parquet")
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attributions_broadcast_weights_and_never_tokens(spark, tmp_path, monkeypatch):
    c = Context(spark, sequences(spark, tmp_path))
    assert "rightHint=(strategy=broadcast)" in plan(c.attr)
    whole = sorted(map(str, c.attr.collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    d = At.linear_attributions(c.tokens, c.weights)
    assert "rightHint=(strategy=merge)" in plan(d) and "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString().replace("strategy", "")
    assert sorted(map(str, d.collect())) == whole


def test_weights_of_rows_are_those_of_tokens(spark, tmp_path):
    c = Context(spark, sequences(spark, tmp_path))
    order = lambda w: w.orderBy("token").select("token", "n_pos", "n_neg", F.round("weight", 12)).collect()
    assert order(At.sequence_weights(c.seq)) == order(At.token_weights(c.tokens)) != []


def keyed_broadcasts(df):
    """Joins by key for which the plan broadcasts a side."""
    return re.findall(r"BroadcastHashJoin \[[^\]]*\bkey#", df._jdf.queryExecution().executedPlan().toString())


def stored(c, folder, name):
    """A table of the context as parquet: its estimate is then as small as its file."""
    getattr(c, name).write.parquet(f"{folder}/{name}")
    return c.spark.read.parquet(f"{folder}/{name}")


def test_explanations_broadcast_no_side_by_key(spark, tmp_path):
    c = Context(spark, sequences(spark, tmp_path))
    attr, carriers, sums = (stored(c, tmp_path, n) for n in ("attr", "carriers", "block_sums"))
    out = Ma.explanation(attr, carriers, c.patterns, sums, 5)
    assert keyed_broadcasts(out) == []
    assert {r.kind for r in out.collect()} == {"token", "pattern"}


def test_occurrences_broadcast_no_side_by_key(spark, tmp_path):
    c = Context(spark, sequences(spark, tmp_path))
    out = Ma.occurrences(c.patterns, stored(c, tmp_path, "attr"))
    assert keyed_broadcasts(out) == []
    whole = {(r.pattern_id, r.key): (round(r.score, 9), r.n_matched) for r in out.collect()}
    one = {r.key: r.s for r in c.attr.where("token = 'C:10_B'").groupBy("key").agg(F.min_by("attr", "pos").alias("s")).collect()}
    assert {k: v for (p, k), v in whole.items() if p == "C:10_B"} == {k: (round(s, 9), 1) for k, s in one.items()}


def test_perturbed_tokens_are_no_broadcast(spark, tmp_path):
    c = Context(spark, sequences(spark, tmp_path))
    tokens = stored(c, tmp_path, "tokens")
    assert keyed_broadcasts(Ma.matched_positions(c.patterns, tokens)) == []
    score = Pe.linear_scorer(c.weights)
    assert "BuildLeft" not in score(tokens, ["key"])._jdf.queryExecution().executedPlan().toString()
    many = Pe.draws(tokens, 2)
    at = tokens.groupBy("key").agg(F.collect_list("pos").alias("positions"))
    for moved in (Pe.shuffled_within_visits(many), Pe.shuffled_visits(many), Pe.masked_tokens(tokens, at)):
        assert keyed_broadcasts(moved) == []
    out = Pe.validate(c.patterns, tokens, score)
    assert keyed_broadcasts(out) == []
    n = {r.pattern_id: r.n_matched for r in out.collect()}
    assert n["C:10_B"] == 40 and None not in n.values()
