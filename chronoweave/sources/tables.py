"""Readers and writers: typed CSV, dictionaries, artefacts, bundles, run registry, resumable loads."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.common import clean_code, clean_id
from chronoweave.functions import text as X
from chronoweave.operators.relational import pending


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, folder: str, name: str, schema: T.StructType | str, columns: list[str] | None = None) -> DataFrame:
    """A typed CSV with a header, plain or gzipped, whichever exists; the scan reads the wanted columns only.

    Raises FileNotFoundError if neither exists. Values that don't fit their type are null.
    """
    for ext in (".csv.gz", ".csv"):
        path = os.path.join(folder, name + ext)
        if _exists(spark, path):
            df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="PERMISSIVE", multiLine=False)
            return df.select(*columns) if columns else df
    raise FileNotFoundError(os.path.join(folder, name + ".csv[.gz]"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; columns that start with `_` are private and left out, nested ones become JSON."""
    keep = [c for c in df.columns if not c.startswith("_")]
    nested = (T.ArrayType, T.MapType, T.StructType)
    cols = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, nested) else F.col(c) for c in keep]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """An artefact with nested types, as parquet."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def titles(dictionary: DataFrame, stream: str = "D", width: int = 60) -> DataFrame:
    """(stream, code, title): one trimmed title of at most `width` characters per clean code, the smallest on ties."""
    rows = dictionary.select(clean_code("icd_code").alias("code"), F.left(F.trim("long_title"), F.lit(width)).alias("title")).where("code is not null and title is not null and title != ''")
    return rows.groupBy("code").agg(F.min("title").alias("title")).select(F.lit(stream).alias("stream"), "code", "title")


def drug_names(drug_map: DataFrame) -> DataFrame:
    """(rxcui, name): the first ingredient name per id in row order of map_id, in title case."""
    rows = drug_map.select(clean_id("ingredient_rxcui").alias("rxcui"), F.initcap(F.trim("ingredient_name")).alias("name"), "map_id").where("rxcui is not null and name != ''")
    return rows.groupBy("rxcui").agg(F.min_by("name", F.struct("map_id", "name")).alias("name"))


def title_map(spark: SparkSession, path: str) -> DataFrame:
    """(token, title) of a JSON object file that maps tokens to titles."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("token", "title"))


def risk_scores(spark: SparkSession, path: str) -> DataFrame:
    """Precomputed visit-risk rows with clean ids."""
    df = load(spark, path)
    return df.withColumn("entity", clean_id("entity")).withColumn("visit", clean_id("visit"))


def token_titles(token_rows: DataFrame, title_rows: DataFrame, names: DataFrame) -> DataFrame:
    """(token, stream, code, title) of distinct tokens by dictionary; unmatched titles are null."""
    t = token_rows.select("token").distinct().select("token", X.stream("token").alias("stream"), X.bare_code("token").alias("code"))
    lookup = title_rows.select(F.when(F.col("stream") == "D", "C").otherwise("P").alias("stream"), "code", "title").unionByName(names.select(F.lit("D").alias("stream"), F.col("rxcui").alias("code"), F.col("name").alias("title")))
    return t.join(lookup, ["stream", "code"], "left").select("token", "stream", "code", "title")


def save_bundle(folder: str, config: dict, metrics: dict, frames: dict[str, DataFrame]) -> None:
    """A model directory on the cluster's file system: config and metrics as JSON rows, tables as parquet."""
    spark = next(iter(frames.values())).sparkSession if frames else SparkSession.getActiveSession()
    meta = spark.createDataFrame([("config", json.dumps(config, sort_keys=True)), ("metrics", json.dumps(metrics, sort_keys=True))], "name string, body string")
    save(meta.coalesce(1), os.path.join(folder, "meta"))
    for name, df in frames.items():
        save(df, os.path.join(folder, name))


def load_bundle(spark: SparkSession, folder: str, frames: list[str]) -> tuple[dict, dict, dict[str, DataFrame]]:
    meta = {r.name: json.loads(r.body) for r in load(spark, os.path.join(folder, "meta")).collect()}  # two rows
    return meta["config"], meta["metrics"], {n: load(spark, os.path.join(folder, n)) for n in frames}


def register_run(spark: SparkSession, path: str, run_id: str, fields: dict) -> None:
    """Append one run to the registry table, creating it if needed."""
    row = spark.createDataFrame([(run_id, json.dumps(fields, sort_keys=True))], "run_id string, fields string")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def resume(wanted: DataFrame, path: str, keys: list[str], work, batches: int = 8) -> None:
    """Process the keys not yet in the table at `path`, appending after each of `batches` parts, so a broken run goes on where it stopped.

    work: DataFrame -> DataFrame with the key columns.
    """
    spark = wanted.sparkSession
    todo = pending(wanted, load(spark, path), keys) if _exists(spark, path) else wanted
    part: Column = F.pmod(F.xxhash64(*keys), F.lit(batches))
    for i in range(batches):
        work(todo.where(part == i)).write.mode("append").parquet(path)


def short_names(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(label, short): a short name for readable token labels like `C:I509 (Heart failure)`.

    names: (long, short). The first that is found counts: the label itself, its
    code, its description, and for cut descriptions one that starts with the same
    15 characters and is about as long. Without any, the description remains, or
    the label without its stream. Labels are distinct; null labels are left out;
    of several names the smallest short one is taken.
    """
    code = lambda c: F.nullif(F.regexp_extract(c, r"^([CPD]:[A-Za-z0-9_.]+)(?: |$)", 1), F.lit(""))
    inner = F.nullif(F.regexp_extract("label", r"^[CPD]:[A-Za-z0-9_.]+ \((.+?)\)*$", 1), F.lit(""))
    rows = labels.select(F.trim("label").alias("label")).where("label is not null").distinct().withColumn("said", F.coalesce(inner, "label")).withColumn("code", code(F.col("label")))
    n = names.select(F.trim("long").alias("long"), F.trim("short").alias("short")).where("long is not null and short is not null")
    start = F.when(F.length("said") > 15, F.left("said", F.lit(15)))
    ways = lambda *by: F.array(*[F.struct(F.lit(i).alias("way"), c.alias("k")) for i, c in enumerate(by)])
    keys = ways(F.col("label"), F.col("code"), F.col("said"), start)
    known = ways(F.col("long"), code(F.col("long")), F.col("long"), F.left("long", F.lit(15)))
    a = rows.select("label", "said", F.inline(keys)).where("k is not null")
    b = n.select("long", "short", F.inline(known)).where("k is not null")
    met = a.join(b, ["way", "k"]).where((F.col("way") < 3) | (F.abs(F.length("long") - F.length("said")) < 10))
    best = met.groupBy("label").agg(F.min(F.struct("way", "short")).alias("m")).select("label", F.col("m.short").alias("short"))
    return rows.join(best, "label", "left").select("label", F.coalesce("short", F.when(F.col("said") != F.col("label"), F.col("said")), F.regexp_replace("label", "^[CPD]:", "")).alias("short"))
