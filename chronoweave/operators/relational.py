"""Small relational operators: upsert, done-keys, imputed joins, rankings, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and new rows, the new one winning per key; the largest row wins among equals of one side."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("__src", *rest)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not done yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row `same`: whether two tables hold the same set of keys."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    return x.join(y, key, "full").agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("same"))


def imputed_join(left: DataFrame, right: DataFrame, on: str, values: list[str], group: Column) -> DataFrame:
    """Left join whose missing values become the median of the row's group, else 0."""
    rows = left.join(right.select(on, *values), on, "left").withColumn("__g", group)
    med = rows.groupBy("__g").agg(*[F.median(v).alias(f"__{v}") for v in values])
    out = rows.join(med.withColumnRenamed("__g", "__h"), F.col("__g").eqNullSafe(F.col("__h")), "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(v, f"__{v}", F.lit(0.0)))
    return out.drop("__g", "__h", *[f"__{v}" for v in values])


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all numbers, neither null, NaN nor infinite."""
    ok = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(ok)


def rounded_rank(df: DataFrame, value: str, blocks: str, tie: str) -> DataFrame:
    """Adds rank: absolute value rounded half-even to two digits, then more blocks, then the exact absolute value, then the tie column."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.bround(F.abs(value), 2)), F.desc(blocks), F.desc(F.abs(value)), tie)))


def odds_top(df: DataFrame, k: int, value: str = "odds_ratio", tie: str = "pattern_id") -> DataFrame:
    """The k largest above one and the k smallest below one; exactly one is on neither side. A top-k report."""
    up = df.where(F.col(value) > 1).orderBy(F.desc(value), tie).limit(k).withColumn("side", F.lit("above"))
    return up.unionByName(df.where(F.col(value) < 1).orderBy(F.asc(value), tie).limit(k).withColumn("side", F.lit("below")))


def tagged_top(a: DataFrame, b: DataFrame, kinds: tuple[str, str], value: str, name: str, n: int) -> DataFrame:
    """Two importance tables in one ranking by absolute value: (kind, name, value, rank), top n."""
    both = a.select(F.lit(kinds[0]).alias("kind"), F.col(name).alias("name"), F.col(value).alias("value")).unionByName(b.select(F.lit(kinds[1]).alias("kind"), F.col(name).alias("name"), F.col(value).alias("value")))
    top = both.orderBy(F.desc(F.abs("value")), "kind", "name").limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.abs("value")), "kind", "name")))


def scaled_by_max(df: DataFrame, value: str, by: str) -> DataFrame:
    """Adds `scaled`: the value over the group's largest absolute value."""
    return df.withColumn("scaled", F.col(value) / (F.max(F.abs(value)).over(W.partitionBy(by)) + 1e-12))
