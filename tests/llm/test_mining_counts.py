import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.llm.cooccurrence import cooccurrence, visit_blocks
from chronoweave.llm.frequent_sequences import frequent_sequences
from chronoweave.llm.value_counts import banded, value_counts
from tests.conftest import rows

SEQ = "patient_id string, combined_full array<string>, support int"


def brute_sequences(data, least):
    own = {}
    for p, t, _ in data:
        if p is None or t is None:
            continue
        blocks = [[]]
        for x in t:
            if x == "[VISIT]":
                blocks.append([])
            elif x and x[:2] in ("C:", "P:", "D:"):
                blocks[-1].append(x)
        found = own.setdefault(p.strip().removesuffix(".0"), set())
        for n in (2, 3, 4):
            for c in itertools.combinations(blocks, n):
                found |= {" -> ".join(x) for x in itertools.product(*c)}
    count = {}
    for f in own.values():
        for x in f:
            count[x] = count.get(x, 0) + 1
    return {k: n for k, n in count.items() if n >= least}, len(own)


def test_frequent_sequences_equal_enumeration(spark):
    r = random.Random(2)
    data = [(str(r.randrange(9)), ["[CLS]"] + [x for _ in range(r.randrange(0, 6)) for x in ["[VISIT]", *(f"C:9_{r.choice('abc')}" for _ in range(r.randrange(0, 3)))]] + ["[PAD]"], 1) for _ in range(14)]
    data += [data[0], (" 3.0", data[1][1], 1), ("8", None, 1), (None, data[2][1], 1), ("7", ["C:9_a", None, "[VISIT]", "C:9_a"], 1), ("5", [], 1)]
    want, total = brute_sequences(data, 3)
    for tree in (250_000, 2):
        got = frequent_sequences(spark.createDataFrame(data, SEQ), min_frac=0.0, min_abs=3, tree_size=tree)
        assert {x.pattern: x.n_entities for x in got.collect()} == want
        assert got.first().n_total == total


def test_many_frequent_tokens_need_few_passes(spark):
    # 3,000 frequent tokens have nine million ordered pairs; only those that occur are counted.
    data = [(str(i), [x for j in range(1500) for x in ("[VISIT]", f"C:9_{j if i % 2 else j + 1500}")][: 2 * 1500 - 2 * (i % 4)], 1) for i in range(8)]
    df = spark.createDataFrame(data, SEQ)
    got = frequent_sequences(df, min_frac=0.0, min_abs=4, max_len=2)
    # Four entities each share their first 1,498 and 1,497 tokens.
    assert got.agg(F.count("*"), F.min("n_entities"), F.max("n_entities")).first()[:] == (1498 * 1497 // 2 + 1497 * 1496 // 2, 4, 4)


def test_frequent_sequences_of_nothing(spark):
    assert frequent_sequences(spark.createDataFrame([], SEQ)).count() == 0
    assert frequent_sequences(spark.createDataFrame([("1", ["C:9_a"] * 3, 1)], SEQ)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None, ""]), st.sampled_from(["1", "2", "3", None]), st.integers(0, 2)), max_size=60))
def test_value_counts(spark, data):
    df = spark.createDataFrame(data, "value string, record string, rows int")  # clashes with the operator's own names
    got = {r.value: (r.n_rows, r.n_records, r.total_records) for r in value_counts(df, F.nullif("value", F.lit("")), F.col("record"), heavy_share=0.25).collect()}
    u = set(data)
    total = len({r for _, r, _ in u} - {None})
    assert got == {v: (len([x for x in u if x[0] == v]), len({r for w, r, _ in u if w == v} - {None}), total) for v in {x[0] for x in u} - {None, ""}}


def test_a_hot_pair_and_shifted_nulls(spark):
    # One record and value hold most rows; rows that differ only in which column is null are two.
    data = [("a", "1", i, None) for i in range(500)] + [("a", "1", 7, None)] * 3 + [("a", "1", None, 7), ("b", "1", 7, None), ("b", "1", None, 7), ("a", None, 1, 1), ("a", "2", 1, 1)]
    df = spark.createDataFrame(data, "v string, r string, x int, y int")
    got = {r.value: (r.n_rows, r.n_records, r.total_records) for r in value_counts(df, F.col("v"), F.col("r")).collect()}
    assert got == {"a": (503, 2, 2), "b": (2, 1, 2)}
    assert value_counts(df.limit(0), F.col("v"), F.col("r")).count() == 0


def test_bands(spark):
    df = spark.createDataFrame([("a", str(i)) for i in range(11)] + [("b", str(i)) for i in range(10)] + [("c", "1"), ("d", None)] + [("x", str(i)) for i in range(100)], "v string, r string")
    got = {r.value: r.band for r in banded(value_counts(df, F.col("v"), F.col("r")), 2, 0.1).collect()}
    assert got == {"a": "common", "b": "normal", "c": "rare", "d": "rare", "x": "common"}


def test_cooccurrence_is_the_same_in_blocks(spark):
    r = random.Random(1)
    data = [(str(r.randrange(12)), r.choice("abcdefgh"), 0) for _ in range(90)] + [("big", x, 0) for x in "abcdefgh"] + [(None, "a", 0), ("1", None, 0)]
    df = spark.createDataFrame(data, "basket string, item string, chunk int")
    baskets = {}
    for b, i, _ in data:
        if b and i:
            baskets.setdefault(b, set()).add(i)
    n = len(baskets)
    single = {x: sum(x in s for s in baskets.values()) for x in "abcdefgh"}
    want = {}
    for x, y in itertools.combinations("abcdefgh", 2):
        k = sum(x in s and y in s for s in baskets.values())
        if k >= 2 and k * n >= 1.1 * single[x] * single[y]:
            want[x, y] = (k, single[x], single[y], n)
    for block in (256, 2):
        got = cooccurrence(df, F.col("basket"), F.col("item"), None, 2, None, 1.1, block)
        assert {(g.item_a, g.item_b): (g.n_ab, g.n_a, g.n_b, g.n_baskets) for g in got.collect()} == want
    assert cooccurrence(df.limit(0), F.col("basket"), F.col("item")).count() == 0


def test_visit_blocks(spark):
    df = spark.createDataFrame([("1", "v", ["[CLS]", "[VISIT]", "C:a", None, "D:b", "[VISIT]", "[VISIT]", "C:c", "[PAD]"]), ("1", "v", None), ("2", None, ["C:z", "[VISIT]"])], "p string, h string, t array<string>")
    got = rows(visit_blocks(df, F.col("p"), F.col("h"), "t"))
    assert sorted((b[-1:], i or "") for b, i in got) == [("0", "C:z"), ("1", ""), ("1", "C:a"), ("1", "D:b"), ("2", ""), ("3", "C:c")] and len({b for b, _ in got}) == 5
