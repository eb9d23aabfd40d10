"""Every record of samples gets a split; only the related pairs need both ids."""

from chronoweave.llm.queries import QUERIES


def test_records_without_an_id_are_assigned(spark, tmp_path):
    data = [("1", "a", 0), ("1", None, 1), (None, "a", 0), ("2", "", 0), (None, None, 0), ("3", "b", 0), ("3", "c", 0)]
    spark.createDataFrame(data, "patient_id string, index_hadm_id string, readmit_30d int").write.parquet(f"{tmp_path}/samples.parquet")
    got = QUERIES["p2_assigned"](spark, str(tmp_path)).collect()
    assert len(got) == 6 and len({r.split for r in got if r.group_id == "1"}) == 1 and sum(r.group_id == "1" for r in got) == 3
    assert QUERIES["p2_found"](spark, str(tmp_path)).count() == 2
