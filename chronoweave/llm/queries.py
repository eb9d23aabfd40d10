"""Queries of the training-data operators: (spark, data directory) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.common import checkpointed, clean_code, clean_id, table
from chronoweave.llm.cooccurrence import cooccurrence, visit_blocks
from chronoweave.llm.encoding_repair import repair_encoding
from chronoweave.llm.eval_leaks import eval_leaks
from chronoweave.llm.frequent_sequences import frequent_sequences
from chronoweave.llm.name_mapping import map_names
from chronoweave.llm.related_splits import related_splits, split_sizes
from chronoweave.llm.similar_sets import expanded, links_per_set, similar_sets
from chronoweave.llm.source_mixing import mixed
from chronoweave.llm.value_counts import banded, value_counts


def p1_support(spark: SparkSession, d: str) -> DataFrame:
    return frequent_sequences(table(spark, d, "sequences"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_support(spark, d).select("pattern")


def _assigned(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """All records of samples; `whole`: only those with both ids."""
    keys = {"patient_id": clean_id("patient_id"), "index_hadm_id": clean_id("index_hadm_id")}
    rows = table(spark, d, "samples")
    return related_splits(rows.where(keys["patient_id"].isNotNull() & keys["index_hadm_id"].isNotNull()) if whole else rows, keys, F.col("readmit_30d"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d, True).where("group_records > 1").select("patient_id", "index_hadm_id", "group_id")


def p2_assigned(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    return split_sizes(_assigned(spark, d))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p2_assigned: one row of counts, of groups and keys that are divided (none), and whether every split's records and positives come within two points of its share, or within one record where that is more."""
    a = checkpointed(_assigned(spark, d))
    divided = lambda k: F.count_if(F.col(k) > 1)
    per = lambda k: a.where(F.col(k).isNotNull()).groupBy(k).agg(F.countDistinct("split").alias("n")).agg(divided("n").alias(f"divided_{k}"))
    shares = spark.createDataFrame([("train", 0.7), ("validation", 0.1), ("test", 0.2)], "split string, share double")
    whole = a.agg(F.count("*").alias("n_records"), F.sum("positive").alias("n_positive"))
    near = split_sizes(a).withColumnsRenamed({"n_records": "n", "n_positive": "y"}).select("split", "n", "y").join(shares, "split").join(F.broadcast(whole))
    off = lambda x, want, of: F.abs(F.col(x) - want) <= F.greatest(F.lit(1.0), 0.02 * F.col(of))
    fair = off("n", F.col("share") * F.col("n_records"), "n_records") & off("y", F.col("n_positive") * F.col("n") / F.col("n_records"), "n")
    close = near.agg(F.min(fair).alias("as_planned"))
    return whole.join(per("group_id")).join(per("patient_id")).join(per("index_hadm_id")).join(close)


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    codes = banded(value_counts(table(spark, d, "diagnoses"), clean_code("icd_code"), clean_id("hadm_id")), 5, 1 / 10)
    rx = banded(value_counts(table(spark, d, "ndc_to_ingredient"), clean_id("ingredient_rxcui"), F.col("map_id")), 3, 1 / 40)
    return codes.withColumn("field", F.lit("icd_code")).unionByName(rx.withColumn("field", F.lit("ingredient_rxcui"))).select("field", "value", "n_rows", "n_records", "band")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_counts(spark, d).where("band != 'normal'").select("field", "value", "band")


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return similar_sets(table(spark, d, "mined_patterns_train"), F.col("pattern_id"), F.col("_carrier_keys"), 0.7, 3)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return expanded(*_similar(spark, d)).select(F.col("a").alias("pattern_id_a"), F.col("b").alias("pattern_id_b"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return links_per_set(*_similar(spark, d))


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    codes = cooccurrence(table(spark, d, "diagnoses"), clean_id("hadm_id"), clean_code("icd_code"), None, 5, 1 / 1000, 5.0)
    blocks = visit_blocks(table(spark, d, "sequences"), clean_id("patient_id"), clean_id("index_hadm_id"), "combined_full")
    n = blocks.select("basket").distinct().count()
    tokens = cooccurrence(blocks, F.col("basket"), F.col("item"), n, 5, 1 / 1000, 5.0)
    out = codes.withColumn("basis", F.lit("diagnoses")).unionByName(tokens.withColumn("basis", F.lit("sequences")))
    return out.withColumns({c: F.round(c, 6) for c in ("lift", "pmi", "npmi")})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_scores(spark, d).select("basis", "item_a", "item_b")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ndc_to_ingredient").where(clean_id("ingredient_rxcui").isNull())
    out = map_names(rows, F.col("map_id"), F.col("drug_name"), table(spark, d, "ref_ingredients"), F.col("ingredient_rxcui"), F.col("ingredient_name"), F.col("brand_names"))
    return out.select(F.col("key").alias("map_id"), F.col("ref_id").alias("ingredient_rxcui"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return eval_leaks(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), table(spark, d, "eval_items"), F.col("item_id"), F.col("passage"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    leaks = p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return table(spark, d, "eval_items").select("item_id", "task").join(leaks, "item_id", "left").select("item_id", "task", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.col("n_documents").isNotNull().alias("leaked"))


def p8_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Those of p8_found whose document holds 18 unchanged words of the passage."""
    said = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['’‘ʼ`´′]", ""), r"[^\p{L}\p{N}]+", " "))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit(" "), said("text"), F.lit(" ")).alias("t"))
    items = table(spark, d, "eval_items").select("item_id", F.split(said("passage"), " ").alias("w"))
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - 17), lambda i: F.concat(F.lit(" "), F.array_join(F.slice("w", i, 18), " "), F.lit(" ")))
    rows = p8_found(spark, d).join(items.where("size(w) >= 18"), "item_id").join(docs, "doc_id")
    return rows.where(F.exists(windows, lambda x: F.contains("t", x))).select("doc_id", "item_id")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p9_mix, per source: as many tokens as planned, no document more often than allowed, no token of a repeat twice."""
    draws, report = mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    pieces = draws.groupBy("source", "doc_id", "repeat_no").agg(F.sum("n_tokens").alias("t"), F.max(F.col("first_token") + F.col("n_tokens")).alias("upto"), F.min("first_token").alias("lo"))
    used = pieces.groupBy("source").agg(F.max("repeat_no").alias("most"), F.min(F.col("t") == F.col("upto") - F.col("lo")).alias("whole"))
    r = report.join(used, "source", "left")
    most = F.col("available_tokens") * F.col("max_repeats")
    given = (F.col("drawn_tokens") == F.col("planned_tokens")) & (F.col("planned_tokens") <= most)
    return r.select("source", given.alias("as_planned"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), F.coalesce("whole", F.lit(True)).alias("no_token_twice"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return repair_encoding(table(spark, d, "documents"), F.col("doc_id"), F.col("text")).where("misread").select("doc_id", "restored", "gain", "chains")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repair_encoding(table(spark, d, "documents"), F.col("doc_id"), F.col("text")).where("misread").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_support, p2_found, p2_assigned, p2_sizes, p2_checks, p3_found, p3_counts, p5_found, p5_links, p6_found, p6_scores, p7_found, p8_found, p8_items, p8_verbatim, p9_mix, p9_shares, p9_checks, p10_found, p10_restored)}
