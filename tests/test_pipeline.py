import pytest
from pyspark.sql import functions as F

from chronoweave.config import Config
from chronoweave.pipeline import Pipeline
from tests.conftest import rows


def test_config():
    c = Config(mass=0.7)
    assert Config.from_json(c.to_json()) == c and c.digest("mass") != Config().digest("mass") and c.digest("cap") == Config().digest("cap")
    with pytest.raises(ValueError):
        Config.from_json('{"masss": 1}')


def raw(spark):
    data = []
    for i in range(40):
        y = i % 2
        first, second = ("C:10_A", "C:10_B") if i % 4 < 2 + y else ("C:10_B", "C:10_C")
        data.append((str(i), f"v{i}", y, 2, ["[CLS]", "[VISIT]", first, "D:RX_1", "[VISIT]", second, f"P:9_{i % 5}"]))
    return spark.createDataFrame(data, "patient_id string, index_hadm_id string, readmission int, n_visits int, combined_full array<string>")


def test_run_with_cache(spark, tmp_path):
    p = Pipeline(raw(spark), Config(min_support=0.1, max_items=2, n_draws=2), cache=str(tmp_path / "c"))
    names = {r.pattern_id for r in p.scored.collect()}
    assert "C:10_A -> C:10_B" in names
    # A higher support reuses what was mined, and gives what mining anew gives.
    high = Config(min_support=0.3, max_items=2)
    reused, anew = Pipeline(raw(spark), high, cache=str(tmp_path / "c")), Pipeline(raw(spark), high)
    assert rows(reused.raw_patterns().select("pattern", "support", "y")) == rows(anew.raw_patterns().select("pattern", "support", "y"))
    assert spark.read.parquet(*[str(x) for x in (tmp_path / "c").glob("mined-*")]).select("at").distinct().count() == 1
    assert {"token", "pattern"} == {r.kind for r in p.explain("0|v0").collect()} and p.explain("nobody").count() == 0
    assert p.validate().where("n_matched > 0").count() > 0
    assert set(p.report()) >= {"performance", "clusters"} and all(t.count() >= 0 for t in p.report().values())
    assert p.compare(p.scores.select("key", F.lit(0.5).alias("other")), 20).count() == 6
    p.save_bundle(str(tmp_path / "b"))
    again = Pipeline.from_bundle(spark, str(tmp_path / "b"), raw(spark))
    assert again.config == p.config and again.scores.count() == 40
    assert Pipeline(raw(spark), Config(min_support=0.1, max_items=2, dedup=0.5)).scored.count() <= len(names)
