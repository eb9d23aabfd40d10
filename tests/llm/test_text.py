import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import encoding_repair as Er
from chronoweave.llm.eval_leaks import aligned, eval_leaks, words
from chronoweave.llm.name_mapping import map_names
from chronoweave.llm.source_mixing import GOLDEN, POINTS, VOCABULARY, golden_point, mixed, planned, schedule_of
from tests.conftest import rows

DOC = "doc_id bigint, text string, item_id int"
ITEM = "item_id bigint, passage string, text string"


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], DOC)
    e = spark.createDataFrame([(i, p, "x") for i, p in items], ITEM)
    return set(map(tuple, rows(eval_leaks(d, F.col("doc_id"), F.col("text"), e, F.col("item_id"), F.col("passage"), **kw))))


def sellers(item, doc, run, edits):
    """Best edit distance of every window of `run` item words to any stretch of doc."""
    for i in range(len(item) - run + 1):
        row = list(range(run + 1))
        if row[run] <= edits:
            return True
        for w in doc:
            new = [0]
            for k in range(1, run + 1):
                new.append(min(row[k - 1] + (item[i + k - 1] != w), row[k] + 1, new[k - 1] + 1))
            row = new
            if row[run] <= edits:
                return True
    return False


def test_alignment_equals_edit_distance():
    r = random.Random(9)
    for _ in range(150):
        item = [r.choice("abcdef") for _ in range(r.randrange(4, 12))]
        doc = [r.choice("abcdef") for _ in range(r.randrange(0, 12))]
        assert aligned(item, doc, 5, 1) == sellers(item, doc, 5, 1)


def test_leaks_against_brute_force(spark):
    r = random.Random(6)
    vocab = ["w" + "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 11))) for _ in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(20, 70)))) for i in range(12)]
    docs = []
    for k in range(160):
        ws = words(items[r.randrange(12)][1])
        n = r.choice([10, 14, 17, 18, 19, 25, 40])
        at = r.randrange(max(1, len(ws) - n))
        part = ws[at : at + n]
        for _ in range(r.randrange(4)):
            j = r.randrange(len(part))
            part[j : j + 1] = r.choice([[], ["x" * r.randrange(1, 60)], [part[j], "added"]])
        filler = [r.choice(vocab) for _ in range(r.randrange(30))]
        docs.append((k, " ".join([*filler, *part, *filler]).replace(" w", ",\n“W", r.randrange(4))))
    docs += [(500, ""), (501, None), (502, "word " * 200_000 + items[3][1].upper()), (503, items[2][1])]
    items += [(90, None), (91, "too short"), (92, "")]
    want = {(d, i) for d, t in docs for i, p in items if d < 500 or d == 503 if sellers(words(p), words(t), 18, 2) and len(words(p)) >= 18} | {(502, 3)}
    assert leaks(spark, docs, items) == want
    assert leaks(spark, docs, items, block_chars=900) == want
    assert leaks(spark, docs[:3], []) == set() and leaks(spark, [], items) == set()


def test_leaks_in_wide_scripts(spark):
    r = random.Random(8)
    cyrillic = ["".join(r.choice("абвгдежзиклмнопрст") for _ in range(r.choice([3, 6, 24, 30]))) for _ in range(200)]
    items = [(i, " ".join(r.choice(cyrillic) for _ in range(40))) for i in range(6)] + [(i, "".join(r.choice("語彙表文書記録患者診断薬品検査結果") for _ in range(60))) for i in range(6, 10)]
    docs = []
    for k in range(120):
        item = r.randrange(10)
        ws = words(items[item][1])
        n = r.choice([15, 17, 18, 22, 30])
        at = r.randrange(len(ws) - n)
        part = ws[at : at + n]
        for _ in range(r.randrange(4)):  # two long words added, or changed
            j = r.randrange(len(part))
            part[j : j + 1] = r.choice([[part[j], r.choice(cyrillic)], [part[j], "я" * 24], ["語"]])
        filler = [r.choice(cyrillic) for _ in range(20)]
        docs.append((k, " ".join(filler) + " " + ("" if item >= 6 else " ").join(part) + " " + " ".join(filler)))
    want = {(d, i) for d, t in docs for i, p in items if sellers(words(p), words(t), 18, 2)}
    assert len(want) > 40 and leaks(spark, docs, items) == want


def test_shared_grams_are_expanded_in_slices():
    from chronoweave.llm import eval_leaks as El

    r = random.Random(3)
    common = " ".join(f"please answer question {i} with one letter" for i in range(6))
    items = [(i, common + " " + " ".join(f"w{r.randrange(400)}" for _ in range(30))) for i in range(30)]
    index = El._Index(items, 18, 2)
    stream = np.frombuffer(El._stream(words(common + " " + items[4][1])), np.uint8)
    at, i = index.shared(stream)
    whole = index.slices(i, 10**9)
    parts = index.slices(i, 2000)
    assert whole == [(0, 30)] and len(parts) > 5
    got = [np.concatenate(x) for x in zip(*(index.hits(at, i, lo, hi) for lo, hi in parts))]
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(*(x.tolist() for x in index.hits(at, i, *whole[0]))))


def test_names(spark):
    refs = spark.createDataFrame([("1", "tanioneazole", ["maexyyl"], 0), ("2", "drebiostatin", [], 0), ("3", "bobiazole", None, 0), ("4", None, None, 0), ("5", "drebiosartan", [], 0)], "rx string, ingredient string, brands array<string>, v int")
    cases = {
        1: ("Tanioneazole 250mg/5ml", "1"), 2: ("MAEXYYL tab", "1"), 3: ("tani oneazole", "1"), 4: ("tan1oneazo1e PO", "1"), 5: ("atnioneazloe", "1"), 6: ("drebiostatn (home med)", "2"), 7: ("bobi-azole", "3"),
        8: ("bobia...", "3"), 9: ("drebios...", "NONE"), 10: ("see list", "NONE"), 11: ("???", "NONE"), 12: ("water 10mg", "NONE"), 13: ("x" * 5000, "NONE"),
    }
    data = [(k, n, "v") for k, (n, _) in cases.items()] + [(1, cases[1][0], "v"), (20, None, "v"), (21, "  ", "v"), (None, "bobiazole", "v")]
    df = spark.createDataFrame(data, "key bigint, name string, v string")
    run = lambda d, r: {x.key: x.ref_id for x in map_names(d, F.col("key"), F.col("name"), r, F.col("rx"), F.col("ingredient"), F.col("brands")).collect()}
    assert run(df, refs) == {k: want for k, (_, want) in cases.items()}
    assert set(run(df, refs.limit(0)).values()) == {"NONE"} and run(df.limit(0), refs) == {}


def test_names_of_any_length_script_and_number_of_words(spark):
    long = "abcdefghij" * 12
    entries = ["crème fraîche", "парацетамол", "vitamin b12 complex forte", "q10", "5fu", "ab", long, "pneumoultra microscopic"]
    refs = spark.createDataFrame([(str(i), s, []) for i, s in enumerate(entries)], "rx string, ingredient string, brands array<string>")
    cases = {**{i: (s.upper() if i % 2 else s, str(i)) for i, s in enumerate(entries)}, 20: ("take vitamin b12 complx forte daily", "2"), 21: ("Парацетмол 500 мг", "1"), 22: ("pneumo ultra microscopic", "7"), 23: (long[:60] + "x" + long[60:], "6"), 24: (long[:70], "6"), 25: ("микстура", "NONE")}
    df = spark.createDataFrame([(k, n) for k, (n, _) in cases.items()], "key bigint, name string")
    got = {x.key: x.ref_id for x in map_names(df, F.col("key"), F.col("name"), refs, F.col("rx"), F.col("ingredient"), F.col("brands")).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}


def test_plan(spark):
    have = spark.createDataFrame([("a", 100), ("b", 10)], "source string, available_tokens bigint")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 3), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    assert {r.source: r.planned_tokens for r in planned(have, goal, 100)[0].collect()} == {"a": 50, "b": 20, "c": 0}


def test_schedule_of_many_sources(spark):
    n = 12_000
    slots = spark.range(n).select(F.format_string("s%05d", "id").alias("source"), (1 + F.col("id") % 3).alias("slots"))
    got = schedule_of(slots).groupBy("source").agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    assert got.join(slots, "source").where("n = slots and lo = 0 and hi = slots - 1").count() == n
    g = [(i * GOLDEN) % POINTS for i in range(0, 5_000_000, 9_973)]
    assert [r[0] for r in spark.range(0, 5_000_000, 9_973).select(golden_point(F.col("id"))).collect()] == g


@pytest.mark.skipif(not __import__("os").path.exists(VOCABULARY), reason="no vocabulary file")
def test_mixture(spark):
    docs = [(i, "progress of the patient is good today. " * (1 + i % 7), "a" if i < 600 else "b" if i < 660 else "z", 0) for i in range(700)] + [(900, None, "a", 0), (901, "", "a", 0), (None, "x", "a", 0), (902, "x y", None, 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, slot int")
    t = spark.createDataFrame([("a", 0.7, 1), ("b", 0.2, 4), ("c", 0.1, 2)], "source string, target_share double, max_repeats int")
    draws, report = mixed(d, t, total_tokens=12_000, block_tokens=100)
    r = {x.source: x for x in report.collect()}
    assert [r[k].drawn_tokens for k in "abc"] == [r[k].planned_tokens for k in "abc"] == [8400, 2400, 0] and r["c"].actual_share == 0
    used = draws.groupBy("source", "doc_id").agg(F.countDistinct("repeat_no").alias("count")).groupBy("source").agg(F.max("count").alias("m")).collect()
    assert {x.source: x.m for x in used}["a"] == 1 and {x.source: x.m for x in used}["b"] <= 4
    # Every block is equal but each source's last; no token of a repeat is drawn twice.
    blocks = draws.groupBy("source", "slot", "block").agg(F.sum("n_tokens").alias("n")).collect()
    assert all(x.n == 100 for x in blocks) and len(blocks) == 108 and len({x.slot for x in blocks}) == 108
    spans = sorted((x.source, x.doc_id, x.repeat_no, x.first_token, x.first_token + x.n_tokens) for x in draws.collect())
    assert all(a[:3] != b[:3] or a[4] <= b[3] for a, b in zip(spans, spans[1:]))
    early = draws.where("slot < 40").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()
    share = {x.source: x.t for x in early}
    assert abs(share["a"] / sum(share.values()) - 7 / 9) < 0.08
    none, empty = mixed(d.limit(0), t)
    assert none.count() == 0 and [x.actual_share for x in empty.collect()] == [None] * 3


CLEAN = ["Le patient décrit une fièvre légère à 38 °C. État général préservé.", "Température 37.2 °C, créatinine stabilisée après réévaluation.", "Пациент отмечает одышку в течение дня.", "При осмотре: рана чистая, живот мягкий.", "Weight 52 kg ± 1 kg, platelets ≥ 4.2 and 5 µg given."]


def test_repair_round_trip(spark):
    docs = [(i, CLEAN[i % 5]) for i in range(400)]
    broken = {
        1000: CLEAN[0].encode().decode("cp1252"), 1001: CLEAN[4].encode().decode("latin-1"), 1002: CLEAN[1].encode().decode("mac_roman"), 1003: CLEAN[2].encode("cp1251").decode("koi8-r"),
        1004: CLEAN[0].encode().decode("latin-1").encode().decode("latin-1"), 1005: CLEAN[1].encode("cp1252").decode("cp437"),
    }
    docs += list(broken.items()) + [(2000, "fi�vre"), (2001, ""), (2002, None), (None, "x"), (2003, "plain ascii"), (2004, CLEAN[1] * 2000), (2005, CLEAN[3] + " " + CLEAN[4].encode().decode("cp1252"))]
    df = spark.createDataFrame([(a, b, "s") for a, b in docs], "doc_id bigint, text string, chains string")
    got = {r.doc_id: r for r in Er.repair_encoding(df, F.col("doc_id"), F.col("text")).collect()}
    assert {k for k, r in got.items() if r.misread} == {*broken, 2000, 2005}
    want = {1000: CLEAN[0], 1001: CLEAN[4], 1002: CLEAN[1], 1003: CLEAN[2], 1004: CLEAN[0], 1005: CLEAN[1], 2004: CLEAN[1] * 2000, 2005: CLEAN[3] + " " + CLEAN[4]}
    assert {k: got[k].restored for k in want} == want
    assert set(got) == {i for i, t in docs if i is not None and t is not None}
    assert Er.repair_encoding(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0
