"""Perturbation validation takes every carrier, and shuffles that change nothing count as no change."""

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from chronoweave.operators import matching as Ma
from chronoweave.operators import perturb as Pe
from chronoweave.plans.queries import QUERIES, Context


def sequences(spark, folder, n, visits):
    r = np.random.default_rng(1)
    data = []
    for i in range(n):
        tokens = ["[CLS]", "C:10_FIRST"]
        for k in range(visits(i)):
            tokens += ["[VISIT]", "C:10_B", *(f"C:10_{x}" for x in r.integers(0, 6, r.integers(0, 4)))]
        data.append((str(i), f"h{i}", int(r.random() < 0.2 + 0.6 * (i % 2)), visits(i), tokens))
    spark.createDataFrame(data, "patient_id string, index_hadm_id string, readmission int, n_visits int, combined_full array<string>").write.parquet(f"{folder}/sequences.parquet")
    return str(folder)


def test_every_carrier_counts(spark, tmp_path):
    d = sequences(spark, tmp_path, 450, lambda i: 1 + i % 4)
    c = Context(spark, d)
    want = {r.pattern_id: r.n for r in Ma.matched_positions(c.patterns, c.tokens).groupBy("pattern_id").agg(F.count("*").alias("n")).collect()}
    got = {r.pattern_id: r for r in QUERIES["perturbation_validation"](spark, d).collect()}
    assert {k: r.n_matched for k, r in got.items() if r.n_matched} == want and want["C:10_B"] == 450
    assert {(r.mean_shuffle_within, r.pct_shuffle_within) for r in got.values() if r.n_matched} == {(0.0, 0.0)}
    weight = {r.token: r.weight for r in c.weights.collect()}
    mask, moved = [], []
    for r in c.tokens.groupBy("key", "n_visits").agg(F.collect_list(F.struct("visit_idx", "token")).alias("x")).collect():
        total = np.zeros(r.n_visits)
        for v, t in r.x:
            if v >= 0:
                total[v] += weight[t]
        near = lambda w: 1 / (1 + np.exp(-(w * (np.arange(r.n_visits) + 1)).sum() / r.n_visits))
        first = total.copy()
        first[0] -= weight["C:10_B"]
        mask.append(near(total) - near(first))
        moved.append([near(total) - near(total[list(p)]) for p in permutations(range(r.n_visits))])  # all orders, none drawn
    b = got["C:10_B"]
    assert abs(b.mean_mask - np.mean(mask)) < 2e-6 and abs(b.mean_shuffle_visits - np.mean([np.mean(x) for x in moved])) < 2e-6
    assert abs(b.pct_shuffle_visits - 100 * np.mean([(np.array(x) > 1e-12).mean() for x in moved])) < 2e-6


def test_a_linear_scorer_is_as_any_other(spark, tmp_path):
    c = Context(spark, sequences(spark, tmp_path, 60, lambda i: (1, 5, 6, 9)[i % 4]))
    score = Pe.linear_scorer(c.weights)
    rows = lambda s: {r.pattern_id: list(r)[1:] for r in Pe.validate(c.patterns, c.tokens, s, 3).collect()}
    short, long = rows(score), rows(lambda tokens, by: score(tokens, by))
    assert set(short) == set(long) and len(short) > 20
    for k, r in long.items():
        assert np.allclose(np.array(short[k], float), np.array(r, float), atol=1e-9, equal_nan=True), k
