"""Bootstrap beyond the broadcast bound neither rounds nor changes the estimate."""

import random

from pyspark.sql import functions as F

from chronoweave.operators import metrics as Me


def test_large_bootstrap_is_exact(spark):
    r = random.Random(2)
    y = [r.randrange(2) for _ in range(800)]
    data = [(v, 0.5 + 0.0001 * r.random() + 0.00003 * v, round(r.random() + v, 1)) for v in y]
    df = spark.createDataFrame(data, "y int, a double, b double")
    small = {(x.model, x.metric): x for x in Me.bootstrap(df, "y", ["a", "b"], 200).collect()}
    large = {(x.model, x.metric): x for x in Me.bootstrap(df, "y", ["a", "b"], 200, max_cells=50).collect()}
    assert set(small) == set(large)
    for k, x in large.items():
        assert abs(x.estimate - small[k].estimate) < 1e-9
        assert abs(x.lo - small[k].lo) < 0.03 and abs(x.hi - small[k].hi) < 0.03 and x.lo < x.estimate < x.hi
    for m in "ab":
        assert abs(large[m, "auroc"].estimate - Me.auroc(df, F.col(m), F.col("y")).first()[0]) < 1e-9
