"""Helpers shared by all operators: session, tables, identifiers, distributed ranks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows that one window group may hold where a group could otherwise be hot.
ROWS_PER_BUCKET = 100_000


def session(app: str = "chronoweave", master: str | None = None, shared: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; an existing session is returned unchanged.

    shared: the folder for checkpoints, which all executors must reach.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | ({"spark.checkpoint.dir": shared} if shared else {})
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` on reliable shared storage and cut its lineage.

    The folder is the session's spark.checkpoint.dir. Where none is set, a
    temporary folder is used if the session runs on this machine alone (tests,
    notebooks); on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not _one_machine(sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="chronoweave-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Up to so many rows and characters a lookup table is broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 8_000_000


def lookup(df: DataFrame, text: str) -> DataFrame:
    """`df`, materialised, with the hint for a join against a large table: broadcast within a bound that is counted here, else sort-merge.

    Spark's estimates ignore that an explode multiplies rows, so without a hint
    the exploded table may be the side that goes through the driver. text: a
    string column, whose characters are counted too.
    """
    kept = checkpointed(df)
    n, chars = kept.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    return F.broadcast(kept) if n <= BROADCAST_ROWS and chars <= BROADCAST_CHARS else kept.hint("merge")


#: White space that regular expressions call \s; taken out by position, which costs less than an expression.
_BLANKS = " \t\n\x0b\f\r"


def clean_id(c: Column | str) -> Column:
    """An identifier's digits: no blanks, no trailing `.0`; empty is null."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.translate(c.cast("string"), _BLANKS, "")
    s = F.when(F.endswith(s, F.lit(".0")), F.left(s, F.length(s) - 2)).otherwise(s)
    return F.when(s != "", s)


def clean_code(c: Column | str) -> Column:
    """A diagnosis code without dots and blanks, in upper case; empty is null."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.upper(F.translate(c.cast("string"), _BLANKS + ".", ""))
    return F.when(s != "", s)


def hash_bucket(h: Column, n_buckets: int) -> Column:
    """Range bucket 0..n-1 of a 64-bit hash; buckets follow the order of the hash."""
    return F.least(F.lit(n_buckets - 1), F.floor((h.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * n_buckets)).cast("int")


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Exclusive running total of `value` per key in the order (bucket, order).

    `bucket` must be a coarse prefix of the order that splits every key into
    groups of bounded size. Only bucket totals are ever gathered per key, so a
    key that holds most rows is still spread over many tasks. The join reuses
    the partitioning of the in-bucket window.
    """
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    v, o = f"__{name}_v", f"__{name}_o"
    rows = df.withColumn(v, value)
    offsets = rows.groupBy(*keys, bucket).agg(F.sum(v).alias(v)).select(*keys, bucket, F.coalesce(F.sum(v).over(before), F.lit(0)).alias(o))
    return (
        rows.withColumn(name, F.coalesce(F.sum(v).over(inside), F.lit(0)))
        .join(offsets, [*keys, bucket])
        .withColumn(name, F.col(name) + F.col(o))
        .drop(v, o)
    )
