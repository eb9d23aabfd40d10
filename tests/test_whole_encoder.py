"""The encoder queries see whole sequences, and positions stay with their tokens."""

import numpy as np
from pyspark.sql import functions as F

from chronoweave.operators import models as Mo
from chronoweave.plans.queries import QUERIES, Context, _encoded, _placed


def sequences(spark, folder, sizes):
    data = [(str(i), f"h{i}", i % 2, 2, ["[CLS]", "[VISIT]", f"C:10_RARE{i}", *[f"C:10_{j % 30}" for j in range(n - 3)]]) for i, n in enumerate(sizes)]
    spark.createDataFrame(data, "patient_id string, index_hadm_id string, readmission int, n_visits int, combined_full array<string>").write.parquet(f"{folder}/sequences.parquet")
    return str(folder)


def test_slope_is_the_gradient():
    e = Mo.Encoder.random(12, 8, 2, 2)
    ids = np.array([[1, 5, 7, 9, 3], [1, 4, 0, 0, 0]])
    x, pad = e.embed(ids), ids == 0
    f, g = e._slope(x, pad)
    assert np.allclose(f, e.run(x, pad)[0])
    for at in np.ndindex(x.shape):
        up, down = x.copy(), x.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert abs((e.run(up, pad)[0] - e.run(down, pad)[0])[at[0]] / 2e-5 - g[at]) < 1e-5


def test_loss_gradients_by_all_weights():
    e = Mo.Encoder.random(12, 8, 2, 2, max_len=6)
    ids, y = np.array([[1, 5, 7, 9, 3], [1, 4, 0, 0, 0], [1, 6, 6, 2, 0]]), np.array([1.0, 0.0, 1.0])
    loss, grads = e.loss(ids, y, 2.5)
    assert set(grads) == set(e.w)
    r = np.random.default_rng(1)
    for k, w in e.w.items():
        for _ in range(6):
            at = tuple(r.integers(0, d) for d in w.shape)
            if k == "tok" and at[0] == Mo.PAD:
                continue
            old = w[at]
            w[at] = old + 1e-5
            up = e.loss(ids, y, 2.5)[0]
            w[at] = old - 1e-5
            down = e.loss(ids, y, 2.5)[0]
            w[at] = old
            assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-5, k


def test_slope_at_full_length():
    e = Mo.Encoder.random(40, 16, 2, 2)
    r = np.random.default_rng(2)
    ids = r.integers(1, 40, (1, 512))
    x, pad = e.embed(ids), ids == 0
    g = e._slope(x, pad)[1]
    for p, d in zip(r.integers(0, 512, 12), r.integers(0, 16, 12)):
        up, down = x.copy(), x.copy()
        up[0, p, d] += 1e-4
        down[0, p, d] -= 1e-4
        assert abs((e.run(up, pad)[0] - e.run(down, pad)[0])[0] / 2e-4 - g[0, p, d]) < 1e-6


def test_training_learns_and_stops(spark):
    r = np.random.default_rng(4)
    # Positive if token 5 is there.
    data = [(str(i), [1, *(int(x) for x in r.integers(6, 30, 8)), *([5] if i % 3 == 0 else [])], int(i % 3 == 0)) for i in range(400)] + [("x", None, 1), ("z", [1, 5], None)]
    df = spark.createDataFrame(data, "key string, input_ids array<int>, y int")
    start = Mo.Encoder.random(30, 16, 2, 1, max_len=12)
    model, history = Mo.train_encoder(df.where("key < '5'"), df.where("key >= '5'"), start, epochs=12, rate=5e-3, patience=2)
    assert history[-1]["train_loss"] < history[0]["train_loss"] and max(h["val_auroc"] for h in history) > 0.95
    s = {x.key: x.score for x in Mo.predicted(df, model).collect()}
    assert s["z"] > 0.5 and s["x"] is None
    assert Mo.train_encoder(df.limit(0), df, start)[1] == []


def test_whole_sequences_are_encoded(spark, tmp_path):
    d = sequences(spark, tmp_path, (70, 100, 600))
    got = {r.key: r.n for r in QUERIES["path_attributions"](spark, d).collect()}
    assert got == {"0|h0": 69, "1|h1": 99, "2|h2": 512}  # one token is rare; the longest exceeds the encoder
    assert QUERIES["token_gradients"](spark, d).agg(F.sum("n")).first()[0] == 69 + 99 + 512
    c = Context(spark, d)
    e, _ = _encoded(c)
    p = spark.createDataFrame([("p", "0|h0", [2, 3, 69]), ("p", "2|h2", [0, 5, 599])], "pattern_id string, key string, positions array<int>")
    assert {r.key: r.positions for r in _placed(p, e).collect()} == {"0|h0": [2, 68], "2|h2": [0, 511]}
    assert QUERIES["encoder_scores"](spark, d).where("score is not null").count() == 3


def test_attention_flow_takes_the_first_pairs(spark):
    r = np.random.default_rng(3)
    e = Mo.Encoder.random(20, 8, 2, 1)
    ids, pos = [int(x) for x in r.integers(1, 20, 60)], [4, 9, 50]
    a = e.run(e.embed(np.array([ids])), np.zeros((1, 60), bool))[1][0]
    rest = [x for x in range(60) if x not in pos]
    pairs = [(abs(x - y), a[x, y]) for x in rest for y in rest if x != y]
    want = np.mean([np.mean([v for far, v in pairs if abs(far - abs(p - q)) <= 5][:20]) for p in pos for q in pos if p != q])
    df = spark.createDataFrame([("k", ids)], "key string, input_ids array<int>")
    at = spark.createDataFrame([("p", "k", pos)], "pattern_id string, key string, positions array<int>")
    got = Mo.attention_flow(df, at, e).first()
    assert abs(got.mean_baseline - want) < 1e-9 and abs(got.mean_cross - np.mean([a[p, q] for p in pos for q in pos if p != q])) < 1e-9


def test_kernel_takes_the_largest_positions(spark, tmp_path):
    d = sequences(spark, tmp_path, (70, 10, 100))
    got = {}
    for r in QUERIES["kernel_attributions"](spark, d).collect():
        got.setdefault(r.key, set()).add(r.pos)
    e, m = _encoded(Context(spark, d))
    for r in e.collect():
        a = np.abs(m.integrated(np.asarray(r.input_ids)))
        events = [i for i, x in enumerate(r.input_ids) if x > 2]
        assert got[r.key] == set(sorted(events, key=lambda i: (-a[i], i))[:15])
    assert max(got["2|h2"]) >= 12
