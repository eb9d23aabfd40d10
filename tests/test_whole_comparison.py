"""attribution_comparison attributes every sequence, once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import models as Mo
from chronoweave.plans.queries import QUERIES, Context, _encoded, kernel_values
from tests.test_whole_encoder import sequences


@pytest.mark.parametrize("layers", [1, 2])
def test_subsets_are_those_of_masked_runs(layers):
    e, r = Mo.Encoder.random(40, 16, 2, layers), np.random.default_rng(1)
    for ids, pos in ((r.integers(1, 40, 30), [2, 5, 29]), (r.integers(1, 40, 5), [1, 2, 3, 4]), (np.array([1, 7, 0, 9, 0]), [1, 2]), (r.integers(1, 40, 6), [0, 3])):
        z = r.integers(0, 2, (25, len(pos)))
        masked = np.repeat(ids[None], 25, 0)
        for j, p in enumerate(pos):
            masked[z[:, j] == 0, p] = Mo.PAD
        assert np.allclose(e._without(ids, pos, z), e.logits(masked), atol=1e-12, rtol=0)


def test_comparison_is_the_mean_of_both_attributions_in_one_pass(spark, tmp_path, monkeypatch):
    d = sequences(spark, tmp_path, (70, 10, 100, 40))
    c = Context(spark, d)
    e, m = _encoded(c)
    tokens = e.select("key", F.posexplode("input_ids").alias("pos", "id"))
    per = lambda df, col: {r.id: (r.n, r.x) for r in df.join(tokens, ["key", "pos"]).groupBy("id").agg(F.count("*").alias("n"), F.avg(col).alias("x")).collect()}
    path, kernel = per(Mo.path_attributions(e, m), "attr"), per(kernel_values(c, e, m), "value")
    got = {r.id: r for r in Mo.token_comparison(e, m).collect()}
    assert set(got) == set(path) & set(kernel)
    for i, r in got.items():
        assert (r.n_path, r.n_kernel) == (path[i][0], kernel[i][0]) and abs(r.path - path[i][1]) < 1e-9 and abs(r.kernel - kernel[i][1]) < 1e-6
    monkeypatch.setattr(Mo, "kernel_attributions", None)  # no second pass
    assert QUERIES["attribution_comparison"](spark, d).count() == len(got)
