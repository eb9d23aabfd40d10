import math

from pyspark.sql import functions as F

from chronoweave.common import clean_code, clean_id, running_total
from chronoweave.functions import arrays as A
from chronoweave.functions import stats as S
from chronoweave.functions import text as X
from tests.conftest import rows


def one(spark, *exprs):
    return spark.range(1).select(*exprs).first()


def nest(sets):
    return F.array(*[F.array(*[F.lit(x) for x in s]) for s in sets]) if sets else F.array().cast("array<array<string>>")


def test_identifiers(spark):
    df = spark.createDataFrame([(" 12.0",), ("1 2",), ("",), (None,), ("10",)], "x string")
    assert [r[0] for r in df.select(clean_id("x")).collect()] == ["12", "12", None, None, "10"]
    assert one(spark, clean_code(F.lit(" i50.9 ")), clean_code(F.lit(" . ")))[:] == ("I509", None)


def test_alignment(spark):
    seqs = [[["a", "b"], ["c"]], [["a"], ["c", "d"]], [["a", "b"], ["a", "c"], ["d"]], []]
    support = lambda p: sum(one(spark, A.contains_ordered(nest(p), nest(s)))[0] for s in seqs)
    assert support([["a", "b"]]) == 2 and support([["a"], ["c"]]) == 3 and support([["a"], ["d"]]) == 2 and support([["b"], ["c"]]) == 2 and support([["a", "b"], ["c"]]) == 2
    assert support([["c"], ["a"]]) == 0 and support([]) == 4
    assert one(spark, A.alignment(nest([["a"], ["c"]]), nest(seqs[2])))[0] == [0, 1]
    assert one(spark, A.alignment(nest([["a"], ["a"]]), nest([["a"]])))[0] is None


def test_flat_matching(spark):
    t = F.array(*[F.lit(x) for x in "abcab"])
    p = lambda s: F.array(*[F.lit(x) for x in s])
    assert one(spark, A.subsequence(p("acb"), t), A.subsequence(p("cc"), t), A.contiguous_at(p("ab"), t), A.contiguous_at(p("ac"), t))[:] == (True, False, 0, None)
    assert one(spark, A.ngrams(t, 2))[0] == [["a", "b"], ["b", "c"], ["c", "a"], ["a", "b"]] and one(spark, A.ngrams(t, 9))[0] == []


def test_array_edits(spark):
    ids = F.array(*[F.lit(i) for i in range(6)])
    assert one(spark, A.tail_truncated(ids, 3))[0] == [0, 4, 5] and one(spark, A.padded(ids, 8, F.lit(9)))[0] == [0, 1, 2, 3, 4, 5, 9, 9]
    assert one(spark, A.masked(ids, F.array(F.lit(1), F.lit(3)), F.lit(-1)))[0] == [0, -1, 2, -1, 4, 5]
    e = F.array().cast("array<string>")
    assert one(spark, A.jaccard(e, e), A.jaccard(F.array(F.lit("a")), e))[:] == (1.0, 0.0)
    assert one(spark, A.capped_union(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("d")), 3))[0] == ["a", "b", "c"]


def test_statistics(spark):
    r = one(spark, S.odds_ratio(*map(F.lit, (10, 10, 5, 25))), S.chi2_yates(*map(F.lit, (20, 0, 30, 0))), S.chi2_yates(*map(F.lit, (10, 10, 5, 25))), S.sigmoid(F.lit(0.0)))
    assert round(r[0], 3) == 4.636 and r[1] == 0 and abs(r[2] - 4.8611111) < 1e-6 and r[3] == 0.5
    p = [x[0] for x in spark.createDataFrame([(3.841458820694124,), (0.0,), (None,)], "x double").select(S.chi2_p("x")).collect()]
    assert abs(p[0] - 0.05) < 1e-9 and p[1] == 1 and (p[2] is None or math.isnan(p[2]))


def test_text(spark):
    k = nest([["B", "A"], ["C"]])
    r = one(spark, X.rendered(X.canonical(k)), X.parsed(F.lit("{A, B} -> C")), X.stream(F.lit("P:9_1")), X.stream(F.lit("[CLS]")), X.bare_code(F.lit("D:RX_77")), X.code_version(F.lit("C:10_I5")), X.shortened(F.lit("abcdef"), 4))
    assert r[:] == ("{A, B} -> C", [["A", "B"], ["C"]], "P", "?", "77", 10, "abc…")
    assert one(spark, X.ndc11(F.lit("1234-5678-90")), X.ndc11(F.lit("12345-678-90")), X.ndc11(F.lit("123.0")), X.ndc11(F.lit(" ")), X.ndc11(F.lit("12345-6789-1")))[:] == ("01234567890", "12345067890", "00000000123", None, "12345678901")
    assert one(spark, X.abbreviated(F.lit("Chronic  heart disease"), {}, [("heart", "cardiac"), ("Chronic", "x")], [("disease", "dis.")]), X.canonical_label(F.lit(" A-b  c!")))[:] == ("Chronic cardiac dis.", "a b c")


def test_running_total_over_buckets(spark):
    df = spark.range(100).select(F.lit("k").alias("g"), "id", (F.col("id") / 7).cast("int").alias("b"))
    got = rows(running_total(df, ["g"], "b", ["id"], F.col("id"), "before").select("id", "before"))
    assert sorted(got) == [(i, sum(range(i))) for i in range(100)]
