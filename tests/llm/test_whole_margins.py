"""The margins are validated on every clean record, not on a sample."""

import numpy as np
from pyspark.sql import functions as F

from chronoweave.llm import encoding_repair as Er


def test_every_record_and_length_counts_for_the_margins(spark, monkeypatch):
    texts = [f"Der Bär läuft über die Brücke nach Köln, {i} Öfen." for i in range(4300)] + ["Größe und Maß. " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    seen = []
    old = Er.validated_margin

    def margin(good, bad):
        seen.append((int(good[-1]), int(bad[-1])))
        return old(good, bad)

    monkeypatch.setattr(Er, "validated_margin", margin)
    Er.repair_encoding(df, F.col("doc_id"), F.col("text"))
    assert [g for g, _ in seen] == [4301] * 4
    assert seen[0][1] + seen[1][1] > 2000


def test_margin_of_counts_is_that_of_gains():
    r = np.random.default_rng(5)
    good, bad = np.append(np.round(r.normal(0, 2, 500), 2), -np.inf), np.append(r.normal(9, 3, 400), [3.25, np.inf])
    n = [np.append(np.bincount(np.searchsorted(Er._CUTS, g), minlength=len(Er._CUTS) + 1), len(g)) for g in (good, bad)]
    loss = [10 * np.mean(good > c) + np.mean(bad <= c) for c in Er._CUTS]
    best = np.flatnonzero(loss <= min(loss) + 1e-12)
    assert Er.validated_margin(*n) == Er._CUTS[best[len(best) // 2]]
    assert Er.validated_margin(n[0] * 0, n[1]) == 6.0
