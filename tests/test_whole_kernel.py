"""Kernel attributions of every position, whatever their number."""

import numpy as np
from pyspark.sql import functions as F

from chronoweave.operators import models as Mo
from chronoweave.plans.queries import QUERIES, Context, _encoded
from tests.test_whole_encoder import sequences


def test_many_positions_split_pairs_and_sums_without_error(monkeypatch):
    r = np.random.default_rng(3)
    for k in (16, 60, 300):
        w, pairs = r.normal(size=k), r.normal(size=(k, k))
        monkeypatch.setattr(Mo.Encoder, "_without", lambda self, ids, pos, z: z @ w + ((z @ pairs) * z).sum(1))
        got = Mo.Encoder.random(5, 8, 2, 1).shapley_kernel(np.ones(k + 1, int), list(range(1, k + 1)))
        want = w + np.diag(pairs) + (pairs + pairs.T - 2 * np.diag(np.diag(pairs))).sum(1) / 2
        assert np.allclose(got, want, atol=1e-6)


def test_many_positions_are_near_the_exact_values():
    e, k = Mo.Encoder.random(60, 16, 2, 1), 16
    ids = np.concatenate([[1], np.random.default_rng(2).integers(3, 60, k)])
    z = (np.arange(2**k)[:, None] >> np.arange(k)) & 1
    f = e._without(ids, list(range(1, k + 1)), z)
    size = z.sum(1)
    share = np.array([1.0 / (k * np.prod([(k - 1 - i) / (i + 1) for i in range(s)])) for s in range(k)])
    want = np.array([((f[z[:, j] == 1] - f[(np.arange(2**k) ^ (1 << j))[z[:, j] == 1]]) * share[size[z[:, j] == 1] - 1]).sum() for j in range(k)])
    got = e.shapley_kernel(ids, list(range(1, k + 1)))
    assert abs(want.sum() - (f[-1] - f[0])) < 1e-9 and abs(got.sum() - want.sum()) < 1e-9
    assert np.sqrt(((got - want) ** 2).mean()) < 0.3 * want.std()


def test_comparison_has_every_position_of_every_token(spark, tmp_path):
    d = sequences(spark, tmp_path, (70, 10, 100, 400))
    c = Context(spark, d)
    e, m = _encoded(c)
    n = {r.id: r.n for r in e.select(F.explode("input_ids").alias("id")).where("id > 2").groupBy("id").agg(F.count("*").alias("n")).collect()}
    got = Mo.token_comparison(e, m).collect()
    assert {r.id: r.n_kernel for r in got} == {r.id: r.n_path for r in got} == n
    assert QUERIES["attribution_comparison"](spark, d).agg(F.sum("n_present")).first()[0] == sum(n.values())
