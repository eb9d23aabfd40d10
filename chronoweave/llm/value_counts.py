"""Exact frequency of every distinct value, heavy values apart from light ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _local_arrays(heavy):
    """One partition's rows (value, has_record, rows) into counter arrays over the heavy values."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(heavy.value, pa.string())
        n, records = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        for b in batches:
            i = pc.index_in(b.column("value").cast(pa.string()), value_set=values).to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(n, i, b.column("rows").to_numpy())
            np.add.at(records, i, b.column("has_record").to_numpy())
        yield pa.RecordBatch.from_arrays([values, pa.array(n), pa.array(records)], names=["value", "n_rows", "n_records"])

    return count


def value_counts(df: DataFrame, value: Column, record: Column, heavy_share: float = 0.001) -> DataFrame:
    """Count, per distinct value, the distinct rows it occurs in and the distinct records.

    One pass with mergeable top-k sketches over the raw rows finds the values with
    more than `heavy_share` of them, of which at most 1 / heavy_share exist, and
    likewise the heavy (record, value) pairs. A sketch decides the route alone;
    all routes are exact.

    Rows of heavy values are shuffled once, by (record, value), where their repeats
    meet, and counted into local arrays over the heavy values; one row per task
    and value goes on. A heavy pair's rows are spread further by their digest and
    its record is counted apart. Only the other values' rows are shuffled by
    value. What is shuffled of a row is its value, its record and a 64-bit digest
    that tells rows of the same value and record apart.

    Output: value, n_rows, n_records, total_records (all distinct non-null
    records of the table, with a value or not).
    Null values are no values; rows without a record count in n_rows only;
    repeated rows count once; an empty table gives no rows. Columns of any name
    or type that can be hashed are allowed, since only expressions are kept.
    """
    spark = df.sparkSession
    cols = [F.col(f"`{c}`") for c in df.columns]
    empty = F.concat(*[c.isNull().cast("int").cast("string") for c in cols])  # hashing passes over nulls
    named = df.select(value.cast("string").alias("value"), record.cast("string").alias("record"), F.xxhash64(empty, *cols).alias("digest"))
    total = named.where("record is not null").select("record").distinct().count()
    rows = named.where("value is not null").withColumn("pair", F.xxhash64(F.coalesce("record", F.lit("")), "value"))
    k = int(1 / heavy_share)
    top = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(value, {k}, {10 * k})").alias("values"), F.expr(f"approx_top_k(pair, {k}, {10 * k})").alias("pairs")).first()
    often = lambda found: sorted(x["item"] for x in found or [] if x["count"] >= max(2, heavy_share * top["n"]))
    heavy, hot = often(top["values"]), often(top["pairs"])
    plain = lambda r: r.select("value", "record", "salt", "digest").distinct().groupBy("value", "record", "salt").agg(F.count("*").alias("rows"))
    if heavy:
        # Both lists are of at most 1 / heavy_share entries.
        known = F.broadcast(spark.createDataFrame([(v,) for v in heavy], "value string"))
        pairs = F.broadcast(spark.createDataFrame([(p, 1) for p in hot], "pair bigint, hot int"))
        local = spark.sparkContext.broadcast(heavy)
        mine = rows.join(known, "value", "left_semi").join(pairs, "pair", "left")
        salted = mine.select("value", "record", "digest", F.when(F.col("hot").isNotNull(), F.pmod("digest", F.lit(k))).otherwise(-1).alias("salt"))
        counted = plain(salted.repartition("value", "record", "salt")).select("value", ((F.col("salt") < 0) & F.col("record").isNotNull()).cast("int").alias("has_record"), "rows")
        arrays = counted.mapInArrow(_local_arrays(local), "value string, n_rows bigint, n_records bigint")
        if hot:
            once = salted.where("salt >= 0 and record is not null").select("value", "record").distinct().groupBy("value").agg(F.count("*").alias("n_records"))
            arrays = arrays.unionByName(once.select("value", F.lit(0).cast("bigint").alias("n_rows"), "n_records"))
        arrays = arrays.groupBy("value").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))
        rows = rows.join(known, "value", "left_anti")
    light = plain(rows.select("value", "record", "digest", F.lit(0).alias("salt")).repartition("value"))
    counts = light.groupBy("value").agg(F.sum("rows").alias("n_rows"), F.count("record").alias("n_records"))
    if heavy:
        counts = counts.unionByName(arrays)
    return counts.withColumn("total_records", F.lit(total).cast("bigint"))


def banded(counts: DataFrame, min_records: int, max_share: float) -> DataFrame:
    """Add band: `rare` below min_records, `common` above max_share of all records, else `normal`."""
    # The share is compared in whole numbers: n * 1/share > total.
    inverse = round(1 / max_share)
    exact = abs(inverse * max_share - 1) < 1e-12
    common = F.col("n_records") * inverse > F.col("total_records") if exact else F.col("n_records") > max_share * F.col("total_records")
    return counts.withColumn("band", F.when(F.col("n_records") < min_records, "rare").when(common, "common").otherwise("normal"))
