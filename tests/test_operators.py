import itertools
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronoweave.functions import text as X
from chronoweave.operators import attribution as At
from chronoweave.operators import clustering as Cl
from chronoweave.operators import cohort as Co
from chronoweave.operators import matching as Ma
from chronoweave.operators import metrics as Me
from chronoweave.operators import mining as Mi
from chronoweave.operators import models as Mo
from chronoweave.operators import perturb as Pe
from chronoweave.operators import relational as Re
from chronoweave.operators import risk as Ri
from chronoweave.operators.graph import components
from tests.conftest import rows

VISITS = "entity string, visit string, start timestamp, end timestamp, kind string"


def visits(spark, data):
    d = lambda x: None if x is None else datetime(2020, 1, 1) + timedelta(days=x)
    return spark.createDataFrame([(e, v, d(a), d(b), k) for e, v, a, b, k in data], VISITS)


def test_labels_and_index_visit(spark):
    v = visits(spark, [("1", "a", 0, 1, None), ("1", "b", 31, 32, "ELECTIVE"), ("1", "c", 100, 101, None), ("2", "d", 0, None, None), ("3", "e", 0, 2, "X"), ("3", "f", 0, 2, "X")])
    lab = {r.visit: r.label for r in Co.followup_labels(v).collect()}
    assert lab == {"a": 1, "b": 0, "c": 0, "d": 0, "e": 1, "f": 0}
    planned = Co.followup_labels(v, planned=("ELECTIVE",))
    assert {r.visit: r.label for r in planned.collect()}["a"] == 0
    assert rows(Co.index_visits(planned)) == [("1", "b", 0, 2), ("2", "d", 0, 1), ("3", "e", 1, 1)]
    h = Co.history(v, Co.index_visits(planned), 1)
    assert rows(h.select("entity", "visit", "visit_idx")) == [("1", "b", 0), ("2", "d", 0), ("3", "e", 0)]


def test_latest_delivery_and_upsert(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, None)], "k string, at int, v string")
    assert rows(Co.latest(df, ["k"], "at", [])) == [("a", 2, "y"), ("b", None, None)]
    assert rows(Re.upserted(df, spark.createDataFrame([("b", 0, "n")], df.schema), ["k"])) == [("a", 2, "y"), ("b", 0, "n")]


def test_token_filters(spark):
    t = spark.createDataFrame([("e", "C:10_A", 0, 1), ("e", "C:10_A", 1, 2), ("e", "C:10_A", 2, 1), ("e", "C:10_B", 1, 5), ("e", "D:RX_1", 0, None), ("e", "D:RX_1", 1, None)], "entity string, token string, visit_idx int, first_rank int")
    assert Co.first_occurrences(t).count() == 3 and Co.first_occurrences(t, "D").count() == 5
    assert rows(Co.chronic_filtered(t, ("A",)).where("token = 'C:10_A'").select("visit_idx")) == [(0,), (2,)]
    f = Co.framed(t, 6, 7).first().tokens
    assert f == ["[CLS]", "C:10_B", "D:RX_1", "[VISIT]", "C:10_A"][:0] + f and len(f) == 7 and f[0] == "[CLS]" and f[-1] == "[PAD]"


def test_split_is_by_entity_and_about_right(spark):
    e = spark.range(5000).select(F.col("id").cast("string").alias("entity"))
    n = {r.split: r["count"] for r in Co.entity_split(e, "entity").groupBy("split").count().collect()}
    assert abs(n["train"] / 5000 - 0.7) < 0.03 and abs(n["val"] / 5000 - 0.1) < 0.02
    assert Co.subsample(e.unionByName(e), "entity", 7).distinct().count() == 7


def attributions(spark, values):
    return spark.createDataFrame([("k", 1, 1, i, 0, f"C:10_{i}", float(v)) for i, v in enumerate(values)], "key string, y int, n_visits int, pos int, visit_idx int, token string, attr double")


def test_mass_selection(spark):
    kept = lambda v, **kw: sorted(r.pos for r in At.mass_selected(attributions(spark, v), **kw).where("is_salient").collect())
    assert kept([5, 3, 1, 1]) == [0, 1, 2]  # exactly on the mass keeps one more
    assert kept([6, -3, 1]) == [0, 1] and kept([1, 1, 1, 1], mass=0.5) == [0, 1, 2] and kept([5, 4, 3], max_tokens=1) == [0]
    assert At.reselected(attributions(spark, [0, 0]), 0.8).where("is_salient").count() == 0
    assert At.reselected(attributions(spark, [5, 3, 1, 1]), 0.8).where("is_salient").count() == 3


def test_blocks_take_members_by_token(spark):
    a = spark.createDataFrame([("k", 1, 2, 0, 0, "C:10_A", 9.0), ("k", 1, 2, 1, 1, "C:10_A", 0.0), ("k", 1, 2, 2, 1, "C:10_B", 0.1), ("k", 1, 2, 3, -1, "C:10_A", 0.0)], "key string, y int, n_visits int, pos int, visit_idx int, token string, attr double")
    m = At.mass_selected(a)
    assert rows(m.where("is_salient").select("pos")) == [(0,)]
    b = At.salient_blocks(m)
    assert rows(b.select("block_idx", "visit_idx", "items")) == [(0, 0, ["C:10_A"]), (1, 1, ["C:10_A"])]
    assert rows(At.block_token_sums(m, b).select("block_idx", "attr_sum")) == [(0, 9.0)]


def random_sequences(seed, n=8):
    r = random.Random(seed)
    return [(str(i), r.randrange(2), [sorted(r.sample("abcd", r.randrange(1, 3))) for _ in range(r.randrange(0, 4))]) for i in range(n)]


def brute_episodes(seqs, least, max_items):
    def matches(p, s):
        j = 0
        for items in p:
            while j < len(s) and not set(items) <= set(s[j]):
                j += 1
            if j == len(s):
                return False
            j += 1
        return True

    sets = [c for n in range(1, max_items + 1) for c in itertools.combinations("abcd", n)]
    out = {}
    for k in range(1, max_items + 1):
        for p in itertools.product(sets, repeat=k):
            if sum(map(len, p)) <= max_items:
                n = sum(matches(p, s) for *_, s in seqs)
                if n >= least:
                    out[" -> ".join("{" + ", ".join(i) + "}" if len(i) > 1 else i[0] for i in p)] = n
    return out


def test_episode_mining_matches_enumeration(spark):
    for seed in range(2):
        seqs = random_sequences(seed)
        df = spark.createDataFrame(seqs, "key string, y int, blocks array<array<string>>")
        mined = {r[0]: r[1] for r in Mi.mine_episodes(df, 0.25, 3).select(X.rendered("pattern"), "support").collect()}
        assert mined == brute_episodes(seqs, 2, 3)
        table = Mi.pattern_table(Mi.mine_episodes(df, 0.25, 3))
        carried = {r.pattern_id: r["count"] for r in Mi.carriers(table, df).groupBy("pattern_id").count().collect()}
        assert carried == mined
        blocks = df.select("key", F.posexplode("blocks").alias("block_idx", "items"))
        pairs = {r[0]: r[1] for r in Mi.pair_episodes(blocks, 2).select(X.rendered("pattern"), "support").collect()}
        assert pairs == {p: n for p, n in mined.items() if p in brute_episodes(seqs, 2, 2)}


def test_scoring_counts_tests_after_the_floor(spark):
    edges = spark.createDataFrame([(p, str(k)) for p, n in (("a", 10), ("b", 6), ("c", 6), ("d", 2), ("e", 1)) for k in range(n)], "pattern_id string, key string")
    labels = spark.createDataFrame([(str(k), int(k < 8)) for k in range(40)] + [("x", None)], "key string, y int")
    s = Mi.scored(edges, labels, 6)
    assert s.count() == 3
    for r in s.collect():
        assert abs(r.p_bonferroni - min(1, 3 * r.p)) < 1e-12 and r.n_total_pos == 8 and r.n_total_neg == 32
    assert Mi.support_floor(-1, 0.02, 101) == 3 and Mi.support_floor(0, 0.02, 101) == 1 and Mi.support_floor(0.1, 0.02, 101) == 11
    for m in ("episode", "prefix", "ngram"):
        seq = spark.createDataFrame([(str(i), i % 2, [["C:9_a"], ["C:9_b"]], ["[CLS]", "[VISIT]", "C:9_a", "[VISIT]", "C:9_b"]) for i in range(6)], "key string, y int, blocks array<array<string>>, tokens array<string>")
        assert "C:9_a -> C:9_b" in {r.pattern_id for r in Mi.mine_and_score(seq, 0.5, method=m, max_items=2).collect()}


def test_occurrence_takes_the_first_position_and_mask_takes_all(spark):
    a = spark.createDataFrame([("k", 0, 0, "A", 1.0), ("k", 1, 0, "A", 5.0), ("k", 2, 1, "B", 2.0), ("k", 3, 1, "B", 7.0), ("k", 4, -1, "A", 9.0)], "key string, pos int, visit_idx int, token string, attr double")
    p = Mi.pattern_table(spark.createDataFrame([([["A"], ["B"]],)], "pattern array<array<string>>"))
    assert rows(Ma.occurrences(p, a)) == [("A -> B", "k", 3.0, 2)]
    assert rows(Ma.matched_positions(p, a)) == [("A -> B", "k", [0, 1, 2, 3])]


def test_flat_and_ordered_positions(spark):
    s = spark.createDataFrame([("k", ["[CLS]", "[VISIT]", "C:9_a", "C:9_x", "[VISIT]", "C:9_b", "C:9_a", "C:9_b"])], "key string, tokens array<string>")
    assert rows(Ma.flat_occurrence(s, ["C:9_a", "C:9_b"], True)) == [("k", [6, 7])]
    assert rows(Ma.flat_occurrence(s, ["C:9_a", "C:9_b"], False)) == [("k", [2, 5])]
    assert rows(Ma.ordered_positions(s, [["C:9_x", "C:9_b"], ["C:9_a"]])) == [("k", [3, 5, 6])]
    assert rows(Ma.ordered_positions(s, [["C:9_b"], ["C:9_x"]])) == []


def test_leader_clusters_equal_the_sequential_rule(spark):
    r = random.Random(5)
    n = 24
    sim = {(i, j): r.random() for i in range(n) for j in range(i + 1, n) if r.random() < 0.25}
    pairs = spark.createDataFrame([(f"{i:02d}", f"{j:02d}", s) for (i, j), s in sim.items()], "a string, b string, similarity double")
    order = list(range(n))
    r.shuffle(order)
    ranked = spark.createDataFrame([(f"{p:02d}", k + 1) for k, p in enumerate(order)], "pattern_id string, rank int")
    got = {x.pattern_id: x.leader for x in Cl.leader_clusters(pairs, ranked, 0.5).collect()}
    leader = {}
    for p in order:
        if p not in leader:
            leader[p] = p
            for q in order:
                if q not in leader and sim.get((min(p, q), max(p, q)), 0) >= 0.5:
                    leader[q] = p
    assert got == {f"{p:02d}": f"{q:02d}" for p, q in leader.items()}


def test_merged_clusters_grow(spark):
    e = spark.createDataFrame([(p, k) for p, ks in {"a": "123", "b": "124", "c": "34", "d": "9"}.items() for k in ks], "pattern_id string, key string")
    order = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("z", 5)], "pattern_id string, rank int")
    assert rows(Cl.merged_clusters(e, order, 0.5)) == [("a", "a", 4), ("b", "a", 4), ("c", "a", 4), ("d", "d", 1), ("z", "z", 0)]


def test_components(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "y"), ("x", "x"), (None, "q")] + [("hub", f"s{i}") for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u string, v string")).collect()}
    assert len({got[f"{i:03d}"] for i in range(61)}) == 1 and len({got["hub"], *(got[f"s{i}"] for i in range(50))}) == 1 and got["x"] == got["y"] and len(set(got.values())) == 3


def test_metrics(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert Me.auroc(df, F.col("s"), F.col("y")).first()[0] == 0.75
    assert abs(Me.average_precision(df, F.col("s"), F.col("y")).first()[0] - 0.8333333) < 1e-6
    ties = spark.createDataFrame([(0.5, 0), (0.5, 1), (None, 1), (0.2, None)], "s double, y int")
    assert Me.auroc(ties, F.col("s"), F.col("y")).first()[0] == 0.5
    single = spark.createDataFrame([(0.5, 1)], "s double, y int")
    assert Me.auroc(single, F.col("s"), F.col("y")).first()[0] == 0.5 and Me.average_precision(single, F.col("s"), F.col("y")).first()[0] == 0.0
    assert Me.auroc(single.limit(0), F.col("s"), F.col("y")).first()[0] == 0.5
    big = spark.range(400).select((F.col("id") % 97 / 97).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.col("id"))
    b = {(r.model, r.metric): r for r in Me.bootstrap(big, "y", ["s", "id"], 60).collect()}
    x = b[("s", "auroc")]
    assert x.lo <= x.estimate <= x.hi and abs(x.estimate - Me.auroc(big, F.col("s"), F.col("y")).first()[0]) < 1e-9 and ("id - s", "auroc") in b


def test_risk_points_and_lookback(spark):
    days = [0.5, 1, 1.5, 2, 3, 6, 6.5, 13, 14, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in map(lambda v: None if v is None else float(v), days)], "d double").select(Ri.stay_points(F.col("d"))).collect()]
    assert got == [0, 1, 4, 2, 3, 4, 5, 5, 6, 6]
    v = visits(spark, [("1", "a", 0, 1, "URGENT"), ("1", "b", 183, 184, None), ("1", "c", 184, 185, None)])
    r = {x.visit: x for x in Ri.risk_index(v, spark.createDataFrame([("a", "I50.9", 10, 1), ("a", "i21", 10, 2), ("b", "428", 9, 1)], "hadm_id string, icd_code string, icd_version int, seq_num int")).collect()}
    assert r["b"].n_recent == 1 and r["c"].n_recent == 0 and r["a"].n_recent == 0 and r["a"]["index"] == 2 and r["b"]["index"] == 1 and r["c"]["index"] == 0 and r["a"].a == 3


def test_shuffles_keep_tokens(spark):
    t = Pe.draws(spark.createDataFrame([("k", 3, p, p // 3, f"C:9_{p}") for p in range(9)], "key string, n_visits int, pos int, visit_idx int, token string"), 4)
    w = Pe.shuffled_within_visits(t)
    assert rows(w.groupBy("draw", "visit_idx").agg(F.array_sort(F.collect_list("token")).alias("t"))) == rows(t.groupBy("draw", "visit_idx").agg(F.array_sort(F.collect_list("token")).alias("t")))
    assert w.select("draw", "pos").distinct().count() == 36
    s = Pe.shuffled_visits(t)
    assert s.select("draw", "token").distinct().count() == 36 and s.groupBy("draw", "visit_idx").count().where("count = 3").count() == 12


def test_encoder(spark):
    import numpy as np

    e = Mo.Encoder.random(20, 8, 2, 1, seed=1)
    ids = np.array([1, 5, 7, 9])
    base = np.zeros(4, int)
    a = e.integrated(ids, 64)
    gap = e.run(e.embed(ids[None]), (ids == 0)[None])[0][0] - e.run(e.embed(base[None]), (ids == 0)[None])[0][0]
    assert abs(a.sum() - gap) < 0.15 * max(1, abs(gap))  # attributions add up to the change of the score
    padded = np.array([[1, 5, 7, 9, 0, 0]])
    assert abs(e.logits(padded)[0] - e.logits(ids[None])[0]) < 1e-9
    s = e.shapley_kernel(ids, [1, 2], 50)
    masked = ids.copy()
    masked[[1, 2]] = 0
    assert abs(s.sum() - (e.logits(ids[None])[0] - e.logits(masked[None])[0])) < 1e-2
    df = spark.createDataFrame([("k", [1, 5, 7]), ("n", [])], "key string, input_ids array<int>")
    assert {r.key: r.score is None for r in Mo.predicted(df, e).collect()} == {"k": False, "n": True}
    assert Mo.path_attributions(df, e, 4).count() == 3 and Mo.global_gradients(df, e, [[1, 2, 3]]).count() == 3


def test_relational(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", float("inf")), ("d", None)], "k string, x double")
    assert rows(Re.finite(df, ["x"]).select("k")) == [("a",)]
    left = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "k string, g boolean")
    right = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    assert rows(Re.imputed_join(left, right, "k", ["v"], F.col("g")).select("k", "v")) == [("a", 1.0), ("b", 3.0), ("c", 2.0), ("d", 0.0)]
    assert Re.same_keys(left, right, "k").first().same is False
