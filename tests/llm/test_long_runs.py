"""Long runs without ASCII are judged whole."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.llm.encoding_repair import READ_AS, _misread, repair_encoding, runs, unread


def test_a_long_misread_run_is_not_cut_inside_a_character():
    true = "語彙表" * 20
    bad = _misread(true, READ_AS[0], "utf-8")
    assert not any(c.isascii() for c in bad) and len(bad) > 64
    got = list(runs(f"a {bad} b"))
    assert len(got) == 1 and true in [t for _, t in unread(got[0][3])]
    assert len(list(runs("é" * 100))) == 2  # no UTF-8 chain: in pieces


def test_misread_stretches_inside_a_long_run_stay_whole():
    true = "語彙表記録" * 300
    bad = _misread(true, READ_AS[0], "utf-8")
    run = "…“" * 40 + bad + "”…" * 50
    got = [r[3] for r in runs(run)]
    assert "".join(got) == run and bad in got
    assert [true] == [t for _, t in unread(bad)]


@pytest.mark.parametrize("n", [22, 64, 500, 5000])
def test_long_runs_are_restored(spark, n):
    r = random.Random(n)
    clean = ["患者は咳と発熱を訴えて来院した。", "検査の結果、異常は認められなかった。", "薬を一日三回服用すること。", "語彙表の記録を確認した。"]
    text = lambda k: "".join(clean[(k + i) % 4] for i in range(2 + n // 14))[:n]
    once = lambda t: _misread(t, "latin-1", "utf-8")
    docs = [(i, text(r.randrange(4))) for i in range(60)] + [(100, once(text(1))), (101, once(once(text(2)))), (102, "… " + once(text(3)) + "”" * 70)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x.doc_id: x for x in repair_encoding(df, F.col("doc_id"), F.col("text")).collect()}
    assert {k for k, x in got.items() if x.misread} == {100, 101, 102}
    assert got[100].restored == text(1) and got[101].restored == text(2) and text(3) in got[102].restored
