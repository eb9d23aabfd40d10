import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.llm.related_splits import min_cost_flow, quotas, related_splits, split_sizes
from chronoweave.llm.similar_sets import BITS, _bits, _minima, calibrate, expanded, links_per_set, similar_sets
from fractions import Fraction
from tests.conftest import rows

SMP = "patient_id string, hadm string, y int, split string"


def assign(spark, data, **kw):
    return related_splits(spark.createDataFrame(data, SMP), {"patient_id": F.col("patient_id"), "hadm": F.col("hadm")}, F.col("y"), **kw)


def test_groups_and_splits(spark):
    data = [("1", "a", 0, ""), ("2", "a", 1, ""), ("2", "b", 0, ""), ("3", "b", 0, ""), ("4", "c", 0, ""), ("4", "c", 1, ""), ("5", None, 0, ""), (None, "c", 0, ""), (None, None, 0, "")]
    got = {(r.patient_id, r.hadm): (r.group_id, r.group_records) for r in assign(spark, data).collect()}
    assert got == {("1", "a"): ("1", 4), ("2", "a"): ("1", 4), ("2", "b"): ("1", 4), ("3", "b"): ("1", 4), ("4", "c"): ("4", 2), (None, "c"): ("4", 2), ("5", None): ("5", 1)}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 14), st.integers(0, 1)), max_size=40))
def test_no_group_is_divided(spark, data):
    a = assign(spark, [(str(p), str(h), y, "") for p, h, y in data])
    assert a.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert a.count() == len({(p, h) for p, h, _ in data})
    for k in ("patient_id", "hadm"):
        assert a.groupBy(k).agg(F.countDistinct("group_id").alias("n")).where("n > 1").count() == 0


def test_sizes_are_reached_and_a_giant_group_fits(spark):
    data = [(str(i), f"h{i}", i % 3 == 0, "") for i in range(700)] + [("g", f"x{i}", 0, "") for i in range(300)]
    s = {r.split: r for r in split_sizes(assign(spark, [(p, h, int(y), z) for p, h, y, z in data])).collect()}
    assert abs(s["train"].record_share - 0.7) < 0.01 and abs(s["test"].record_share - 0.2) < 0.01 and abs(s["train"].n_positive + s["test"].n_positive + s["validation"].n_positive - 234) == 0
    assert assign(spark, []).count() == 0


def test_many_bundles_are_joined(spark):
    data = [(str(i), f"{i}-{j}", 0, "") for i in range(12) for j in range(i + 1)]
    assert assign(spark, data, max_bundles=3).count() == len(data)


def test_flow():
    # Two units from 0 to 3: the cheaper path first, then the other.
    arcs = [(0, 1, 1, 1), (0, 2, 1, 5), (1, 3, 1, 0), (2, 3, 1, -2)]
    assert min_cost_flow(4, arcs, 0, 3) == [1, 1, 1, 1]
    q = quotas([(1, 0, 10), (7, 2, 1), (3, 1, 2)], [Fraction(7, 10), Fraction(1, 10), Fraction(2, 10)])
    assert [sum(x) for x in q] == [10, 1, 2]


def test_similar_sets_equal_brute_force(spark):
    r = random.Random(4)
    sets = {}
    for i in range(60):
        base = set(r.sample(range(500), r.randrange(3, 30)))
        sets[i] = base
        for j in range(r.randrange(3)):
            sets[100 + 3 * i + j] = {x for x in base if r.random() > 0.12} | ({r.randrange(500)} if r.random() < 0.5 else set())
    data = [(k, [str(x) for x in list(v)[: len(v) // 2]], 0) for k, v in sets.items()] + [(k, [str(x) for x in v] + [None], 1) for k, v in sets.items()]
    data += [(900, None, 0), (901, [], 0), (None, ["1", "2", "3"], 0), (902, ["1", "2"], 0), (903, ["1", "2"], 0)]
    df = spark.createDataFrame(data, "pattern_id bigint, items array<string>, n int")
    data += [(k, ["7001", "7002", "7003"], 0) for k in range(950, 960)]
    sets |= {k: {7001, 7002, 7003} for k in range(950, 960)}
    df = spark.createDataFrame(data, df.schema)
    big = {k: v for k, v in sets.items() if len(v) >= 3}
    want = {(a, b) for a in big for b in big if a < b and 10 * len(big[a] & big[b]) >= 7 * len(big[a] | big[b])}
    for chunk, heavy in ((50_000, 1000), (8, 1)):
        pairs, members = similar_sets(df, F.col("pattern_id"), F.col("items"), chunk=chunk, heavy=heavy)
        assert {tuple(x) for x in rows(expanded(pairs, members))} == want == {tuple(x) for x in rows(expanded(pairs, members, block=1))}
    links = links_per_set(pairs, members)
    assert links.count() == len(big)
    assert sum(1 for x in links.collect() if x.class_size > 1) == len({x for p in want for x in p if big[p[0]] == big[p[1]]})
    empty = similar_sets(df.limit(0), F.col("pattern_id"), F.col("items"))
    assert expanded(*empty).count() == 0


def test_calibration_keeps_its_promise():
    assert calibrate(0.7, 1e-12) < 90 and calibrate(0.7, 0.5) <= 39
    # Measured on sets at just the threshold: none of 3,000 pairs lies beyond a radius that one in a thousand may exceed.. but for a few.
    r = np.random.default_rng(1)
    values, starts, at = [], [], 0
    for _ in range(3000):
        both, a, b = (r.integers(0, 2**62, k) for k in (14, 3, 3))
        for own in (a, b):
            values += [both, own]
            starts.append(at)
            at += 17
    bits = _bits(_minima(np.concatenate(values), np.array(starts), BITS, 11))
    apart = (bits[::2] != bits[1::2]).sum(axis=1)
    assert (apart > calibrate(0.7, 1e-12)).sum() == 0 and (apart > calibrate(0.7, 1e-2)).mean() < 0.02


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10**6))
def test_no_pair_at_the_threshold_is_lost(spark, seed):
    # Sets drawn from few items, so that segments are heavy; every size has pairs at exactly 0.7.
    r = random.Random(seed)
    sets = {i: set(r.sample(range(24), r.randrange(3, 20))) for i in range(150)}
    for i in range(50):
        base = set(r.sample(range(40), 17))
        sets[200 + 2 * i], sets[201 + 2 * i] = base, set(list(base)[:14]) | {100 + i, 200 + i, 300 + i}
    df = spark.createDataFrame([(k, [str(x) for x in v]) for k, v in sets.items()], "id bigint, items array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    for heavy in (1000, 2):
        assert {tuple(x) for x in rows(expanded(*similar_sets(df, F.col("id"), F.col("items"), heavy=heavy)))} == want
    low = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert {tuple(x) for x in rows(expanded(*similar_sets(df, F.col("id"), F.col("items"), 0.3, 1, heavy=2)))} == low


def test_many_bundles_keep_their_sizes(spark):
    # One group of 150 of about 500 records, which would count as 128.
    data = [("g", f"g-{j}", j % 2, "") for j in range(150)] + [(str(i), f"{i}-{j}", int(j < i % 5), "") for i in range(90) for j in range(1 + i % 7)]
    few, many = (sorted((r.patient_id, r.hadm, r.split) for r in assign(spark, data, max_bundles=n).collect()) for n in (20_000, 3))
    assert few == many
    share = {r.split: r.record_share for r in split_sizes(assign(spark, data, max_bundles=3)).collect()}
    assert abs(share["train"] - 0.7) < 0.02 and abs(share["test"] - 0.2) < 0.02


def test_a_size_in_parts():
    bundles = [(300, p, 1 + p % 3) for p in range(300)]
    got = quotas(bundles, [Fraction(7, 10), Fraction(1, 10), Fraction(2, 10)])
    assert [sum(x) for x in got] == [m for *_, m in bundles]
    n = sum(m for *_, m in bundles)
    assert all(abs(sum(x[s] for x in got) - p * n) <= 1 for s, p in enumerate((0.7, 0.1, 0.2)))


def test_labels_are_balanced():
    r = random.Random(5)
    shares = [Fraction(7, 10), Fraction(1, 10), Fraction(2, 10)]
    cases = [
        [(z, y, 1) for z in range(1, 40) for y in (0, z)],  # single components, half all positive, half all negative
        [(1, 0, 1000), (1, 1, 300), (1500, 100, 1)],
        [(1, 0, 1000), (1, 1, 300), (2, 0, 100), (2, 1, 50), (500, 400, 1)],
        [(z, r.randrange(z + 1), r.randrange(1, 4)) for z in range(1, 400)],
    ]
    for bundles in cases:
        got = quotas(bundles, shares)
        assert [sum(x) for x in got] == [m for *_, m in bundles]
        n, pos = (sum(b[k] * b[2] for b in bundles) for k in (0, 1))
        for s, p in enumerate(shares):
            size, own = (sum(b[k] * x[s] for b, x in zip(bundles, got)) for k in (0, 1))
            assert abs(size / n - p) < 0.02 and abs(own / size - pos / n) < 0.02
    assert quotas([], shares) == []
