import random
from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.operators.intervals import merged_and_gaps, periods_and_gaps
from tests.conftest import rows

SCHEMA = "subject_id string, hadm_id string, a timestamp, b timestamp, members int, e string"
T0 = datetime(2020, 1, 1, tzinfo=timezone.utc)


def frame(spark, data):
    at = lambda x: None if x is None else T0 + timedelta(seconds=x)
    return spark.createDataFrame([(s, h, at(a), at(b), 1, "x") for s, h, a, b in data], SCHEMA)


def run(spark, data, **kw):
    df = frame(spark, data)
    base = int(T0.timestamp())
    return {(s, k, a - base, b - base) for s, k, a, b in rows(merged_and_gaps(df, F.col("subject_id"), F.col("a"), F.col("b"), F.col("hadm_id"), **kw))}


def brute(data):
    out = set()
    for s in {d[0] for d in data if d[0] is not None}:
        iv = sorted((a, b, h) for x, h, a, b in data if x == s and a is not None and b is not None and b >= a)
        periods = []
        for a, b, h in iv:
            if periods and a <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], b)
                periods[-1][2].add(h)
            else:
                periods.append([a, b, {h}])
        for a, b, hs in periods:
            if len(hs - {None}) >= 2:
                out.add((s, "merged", a, b))
        for p, q in zip(periods, periods[1:]):
            out.add((s, "gap", p[1], q[0]))
    return out


def test_cases(spark):
    data = [("1", "a", 0, 10), ("1", "b", 10, 20), ("1", "b", 10, 20), ("1", "c", 30, 30), ("1", None, 30, 35), ("1", "d", 50, 40), ("1", "e", None, 5), (None, "f", 0, 1), ("2", "g", 0, 100), ("2", "h", 5, 6)]
    assert run(spark, data) == brute(data) == {("1", "merged", 0, 20), ("1", "gap", 20, 30), ("2", "merged", 0, 100)}


def test_empty(spark):
    assert run(spark, []) == set()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["1", "2", None]), st.sampled_from(["a", "b", "c", None]), st.integers(0, 30), st.integers(0, 30)), max_size=30))
def test_random(spark, data):
    assert run(spark, data) == brute(data)


def test_hot_entity_is_swept_in_slices(spark):
    r = random.Random(3)
    data = [("1", str(i), a := r.randrange(3000), a + r.randrange(6)) for i in range(600)] + [("2", "x", 1, 2), ("2", "y", 2, 9)]
    assert run(spark, data, bucket_rows=20) == run(spark, data) == brute(data)


def test_periods_count_intervals(spark):
    p = rows(periods_and_gaps(frame(spark, [("1", "a", 0, 1), ("1", "a", 1, 2)]), F.col("subject_id"), F.col("a"), F.col("b"), F.col("hadm_id")))
    assert len(p) == 1 and p[0][3] == 2 and p[0][4] == 1 and p[0][5] is None


def test_a_far_off_date_leaves_no_slice_with_all_the_rest(spark):
    r = random.Random(4)
    data = [("1", str(i), a := r.randrange(3000), a + r.randrange(6)) for i in range(600)] + [("1", "far", 200_000_000, 200_000_001), ("2", "x", 1, 2), ("2", "y", 2, 9)]
    assert run(spark, data, bucket_rows=20) == brute(data)
