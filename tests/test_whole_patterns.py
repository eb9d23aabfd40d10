"""The pattern queries see every mined pattern, not a top-k of pairs."""

from pyspark.sql import functions as F

from chronoweave.operators import matching as Ma
from chronoweave.plans.queries import QUERIES, Context


def sequences(spark, folder):
    """Thirty entities whose three visits hold four tokens each, one of them in every visit, the first fifteen with the outcome."""

    def tokens(i):
        kind = "AB"[i < 15]
        return ["[CLS]", *[t for v in range(3) for t in ["[VISIT]", f"C:10_{kind}", *[f"C:10_{kind}{v}{j}" for j in range(3)]]]]

    data = [(str(i), f"h{i}", int(i < 15), 3, tokens(i)) for i in range(30)]
    spark.createDataFrame(data, "patient_id string, index_hadm_id string, readmission int, n_visits int, combined_full array<string>").write.parquet(f"{folder}/sequences.parquet")
    return str(folder)


def test_patterns_are_not_cut(spark, tmp_path):
    d = sequences(spark, tmp_path)
    p = Context(spark, d).patterns
    assert p.count() > 40
    assert p.where("n_steps >= 3").count() > 0 and p.where(F.exists("pattern", lambda s: F.size(s) > 1)).count() > 0
    assert QUERIES["pattern_pvalues"](spark, d).count() == p.count() == QUERIES["pattern_scores"](spark, d).count()


def test_exemplars_see_all_keys_and_tiers(spark):
    # Sixty keys carry the same two patterns; the one that brings other tokens carries a single pattern.
    p = spark.createDataFrame([("a", [["x"]]), ("b", [["y"]]), ("c", [["z"], ["w"], ["v"]])], "pattern_id string, pattern array<array<string>>")
    m = spark.createDataFrame([(f"k{i}", q, 1.0) for i in range(60) for q in "ab"] + [("other", "c", 0.1)], "key string, pattern_id string, value double")
    assert [(r.key, r.n_new_tokens) for r in Ma.exemplars(m, p, 2).collect()] == [("other", 3), ("k0", 2)]
    facts = spark.createDataFrame([("k7", 1, 3), ("k5", 0, 3), ("other", 1, 1)], "key string, y int, n_visits int")
    assert [r.key for r in Ma.exemplars(m, p, 3, facts).collect()] == ["k7", "k5", "other"]
