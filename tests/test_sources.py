import gzip

import pytest
from pyspark.sql import functions as F

from chronoweave.sources import tables as So
from chronoweave.streaming import visits as St
from tests.conftest import rows


def test_csv(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("id,name,n\n1,x,5\n2,,bad\n")
    assert rows(So.read_csv(spark, str(tmp_path), "a", "id string, name string, n int", ["id", "n"])) == [("1", 5), ("2", None)]
    with pytest.raises(FileNotFoundError):
        So.read_csv(spark, str(tmp_path), "b", "id string")
    So.write_csv(spark.createDataFrame([(1, [1, 2], "s")], "id int, l array<int>, _private string"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["id", "l"]


def test_bundle_registry_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "token string, id int")
    So.save_bundle(str(tmp_path / "b"), {"mass": 0.8}, {"auroc": 0.7}, {"vocab": df})
    config, metrics, frames = So.load_bundle(spark, str(tmp_path / "b"), ["vocab"])
    assert config == {"mass": 0.8} and metrics == {"auroc": 0.7} and rows(frames["vocab"]) == [("a", 1)]
    for i in range(2):
        So.register_run(spark, str(tmp_path / "runs"), f"r{i}", {"i": i})
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    want = spark.range(10).select(F.col("id").cast("string").alias("k"))
    done = []

    def work(part):
        done.append(part.count())
        return part.withColumn("v", F.lit(1))

    So.resume(want.where("k < '5'"), str(tmp_path / "r"), ["k"], work, 2)
    So.resume(want, str(tmp_path / "r"), ["k"], work, 2)
    assert sum(done) == 10 and spark.read.parquet(str(tmp_path / "r")).count() == 10


def test_titles(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"C:9_1": "One", "D:RX_2": "Two"}')
    assert rows(So.title_map(spark, str(tmp_path / "t.json"))) == [("C:9_1", "One"), ("D:RX_2", "Two")]


def test_sessions_batch_and_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    data = [(1, t0, "a"), (1, t0 + timedelta(hours=1), "b"), (1, t0 + timedelta(hours=20), "a"), (None, t0, "x"), (2, None, "y"), (3, t0 + timedelta(days=9), "z")]
    df = spark.createDataFrame(data, "user_id bigint, ts timestamp, event_type string")
    assert rows(St.sessions(df, "6 hours").select("user_id", "n_events", "tokens")) == [(1, 1, ["a"]), (1, 2, ["a", "b"]), (3, 1, ["z"])]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = []
    q = St.feed(stream, lambda b, i: got.extend(tuple(r) for r in b.select("user_id", "n_events").collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(got) == [(1, 1), (1, 2)]  # user 3's session is still open at the watermark


def test_short_names(spark):
    labels = spark.createDataFrame([("C:I509 (Heart failure, unspecified)",), ("C:E119 (Type 2 diabetes without compl)",), ("D:aspirin",), ("C:Z999 (Something else)",), ("Long description here that was cu",), (None,)], "label string")
    names = spark.createDataFrame([("C:I509 (Heart failure)", "HF"), ("Type 2 diabetes without complications", "T2D"), ("Long description here that was cut", "Long"), ("x", None)], "long string, short string")
    got = {r.label: r.short for r in So.short_names(labels, names).collect()}
    assert got == {"C:I509 (Heart failure, unspecified)": "HF", "C:E119 (Type 2 diabetes without compl)": "T2D", "D:aspirin": "aspirin", "C:Z999 (Something else)": "Something else", "Long description here that was cu": "Long"}
