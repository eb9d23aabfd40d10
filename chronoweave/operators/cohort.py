"""Visits, outcome labels, index visits, tokens, vocabulary, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.common import clean_code, clean_id
from chronoweave.functions import arrays as A
from chronoweave.functions import text as X


def latest(df: DataFrame, keys: list[str], newest: str, ties: list[str]) -> DataFrame:
    """One row per key: the newest, ties broken by the other columns (largest first). Combined before the shuffle, so no group is gathered."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.col(newest), *[F.col(c) for c in ties], *[F.col(c) for c in rest if c != newest and c not in ties])).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def visits(admissions: DataFrame) -> DataFrame:
    """(entity, visit, start, end, kind): one row per visit, the last delivered.

    Rows without entity, visit or a start are left out; an end before the start
    is null; kind is upper case with single blanks.
    """
    kind = F.trim(F.regexp_replace(F.upper("admission_type"), r"[\s_\-]+", " "))
    rows = admissions.select(clean_id("subject_id").alias("entity"), clean_id("hadm_id").alias("visit"), F.col("admittime").alias("start"), F.when(F.col("dischtime") >= F.col("admittime"), F.col("dischtime")).alias("end"), F.nullif(kind, F.lit("")).alias("kind"), "loaded_at")
    rows = rows.where("entity is not null and visit is not null and start is not null")
    return latest(rows, ["visit"], "loaded_at", ["start", "end"]).select("entity", "visit", "start", "end", "kind")


def followup_labels(v: DataFrame, days: int = 30, planned: tuple[str, ...] = (), anchor: str = "end") -> DataFrame:
    """label 1 if the entity's next visit starts within `days` of the visit's end (or start); a planned next visit does not count.

    A visit without an end, or without a next visit, has label 0.
    """
    w = W.partitionBy("entity").orderBy("start", "visit")
    gap = F.unix_micros(F.lead("start").over(w)) - F.unix_micros(anchor)
    near = (gap <= days * 86_400_000_000) & ~F.coalesce(F.lead("kind").over(w).isin(*planned), F.lit(False))
    return v.withColumn("label", F.coalesce(near, F.lit(False)).cast("int"))


def index_visits(labelled: DataFrame, max_visits: int = 20) -> DataFrame:
    """One visit per entity: the last but one, or the only one (label 0); n_visits counts it and those before, at most max_visits."""
    w = W.partitionBy("entity")
    rows = labelled.withColumn("at", F.row_number().over(w.orderBy("start", "visit")) - 1).withColumn("n", F.count("*").over(w))
    rows = rows.where(F.col("at") == F.greatest(F.col("n") - 2, F.lit(0)))
    return rows.select("entity", "visit", F.when(F.col("n") == 1, 0).otherwise(F.col("label")).alias("label"), F.least(F.col("at") + 1, F.lit(max_visits)).cast("int").alias("n_visits"))


def history(v: DataFrame, index: DataFrame, max_visits: int = 20) -> DataFrame:
    """(entity, index_visit, visit, visit_idx): the index visit and the most recent ones before it, oldest first."""
    at = index.select("entity", F.col("visit").alias("index_visit"))
    rows = v.join(at, "entity")
    w = W.partitionBy("entity").orderBy("start", "visit")
    rows = rows.withColumn("k", F.row_number().over(w))
    ends = rows.where(F.col("visit") == F.col("index_visit")).select("entity", F.col("k").alias("upto"))
    return rows.join(ends, "entity").where((F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - max_visits)).select("entity", "index_visit", "visit", (F.col("k") - F.greatest(F.lit(1), F.col("upto") - max_visits + 1)).cast("int").alias("visit_idx"))


def condition_tokens(diagnoses: DataFrame, exclude_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (visit, token, first_rank) of coded conditions; first_rank is the least seq_num. Excluded prefixes apply to the bare code."""
    rows = diagnoses.select(clean_id("hadm_id").alias("visit"), clean_code("icd_code").alias("code"), F.coalesce("icd_version", F.lit(10)).alias("version"), "seq_num").where("visit is not null and code is not null")
    for p in exclude_prefixes:
        rows = rows.where(~F.col("code").startswith(p))
    return rows.groupBy("visit", X.token("C", F.col("version"), F.col("code")).alias("token")).agg(F.min("seq_num").alias("first_rank"))


def token_union(*streams: DataFrame, types: str = "CPD") -> DataFrame:
    """Union of (visit, token) tables, limited to the given streams."""
    out = streams[0].select("visit", "token")
    for s in streams[1:]:
        out = out.unionByName(s.select("visit", "token"))
    return out.where(X.stream("token").isin(*types)).distinct()


def frequent_excluded(tokens: DataFrame, stream: str, max_share: float) -> DataFrame:
    """Drop a stream's tokens that occur in more than max_share of all visits."""
    total = tokens.agg(F.countDistinct("visit").alias("n_all"))
    often = tokens.where(X.stream("token") == stream).groupBy("token").agg(F.countDistinct("visit").alias("n")).join(F.broadcast(total)).where(F.col("n") > max_share * F.col("n_all"))
    return tokens.join(often.select("token"), "token", "left_anti")


def names_excluded(rows: DataFrame, name: str, substrings: tuple[str, ...]) -> DataFrame:
    """Drop rows whose name contains any of the substrings, whatever the case; null names stay."""
    hit = F.lit(False)
    for s in substrings:
        hit = hit | F.contains(F.lower(name), F.lit(s.lower()))
    return rows.where(~F.coalesce(hit, F.lit(False)))


def tokens_excluded(rows: DataFrame, tokens: list[str]) -> DataFrame:
    """Drop rows with one of the given tokens; null tokens stay."""
    return rows.where(~F.coalesce(F.col("token").isin(*tokens), F.lit(False)))


def first_occurrences(rows: DataFrame, streams: str = "CPD") -> DataFrame:
    """Keep a token (entity, token, visit_idx) only in its earliest visit; streams not listed stay as they are."""
    earliest = F.min("visit_idx").over(W.partitionBy("entity", "token"))
    return rows.withColumn("e", earliest).where((F.col("visit_idx") == F.col("e")) | ~X.stream("token").isin(*streams)).drop("e")


def chronic_filtered(rows: DataFrame, chronic_prefixes: tuple[str, ...]) -> DataFrame:
    """Keep chronic conditions only at first occurrence or as the leading code (first_rank 1)."""
    chronic = F.lit(False)
    for p in chronic_prefixes:
        chronic = chronic | X.bare_code("token").startswith(p)
    earliest = F.min("visit_idx").over(W.partitionBy("entity", "token"))
    return rows.withColumn("e", earliest).where(~chronic | (F.col("visit_idx") == F.col("e")) | (F.col("first_rank") == 1)).drop("e")


def one_to_one(mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct (source, target) pairs whose source has a single target."""
    return mapping.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(source).agg(F.countDistinct(target).alias("n"), F.min(target).alias(target)).where("n = 1").drop("n")


def harmonized(rows: DataFrame, code: str, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Replace codes by their one-to-one target; others stay."""
    m = one_to_one(mapping, source, target).select(F.col(source).alias("__s"), F.col(target).alias("__t"))
    return rows.join(m, F.col(code) == F.col("__s"), "left").withColumn(code, F.coalesce("__t", code)).drop("__s", "__t")


def drug_tokens(rows: DataFrame, visit: str, ndc: str, drug_map: DataFrame) -> DataFrame:
    """(visit, token) of drug rows mapped to ingredients by normalised code."""
    m = drug_map.select(X.ndc11("ndc").alias("k"), clean_id("ingredient_rxcui").alias("rx")).where("k is not null and rx is not null").groupBy("k").agg(F.min("rx").alias("rx"))
    return rows.join(m, X.ndc11(ndc) == F.col("k")).select(clean_id(visit).alias("visit"), X.token("D", None, F.col("rx")).alias("token")).distinct()


def vocabulary(tokens: DataFrame, min_freq: int = 2) -> DataFrame:
    """(token, n, id): specials first, then tokens seen at least min_freq times by (count descending, token).

    Ids come from one ordered window over the distinct tokens, whose number does
    not follow the number of rows.
    """
    spark = tokens.sparkSession
    counts = tokens.where(X.is_event("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_freq)
    ids = counts.withColumn("id", (F.row_number().over(W.orderBy(F.desc("n"), "token")) + len(X.SPECIALS) - 1).cast("int"))
    specials = spark.createDataFrame([(s, None, i) for i, s in enumerate(X.SPECIALS)], "token string, n bigint, id int")
    return specials.unionByName(ids)


def framed(rows: DataFrame, max_len: int | None = None, pad_to: int | None = None) -> DataFrame:
    """(entity, tokens): [CLS], then [VISIT] and the visit's sorted tokens for every visit in order; the tail is kept beyond max_len."""
    per = rows.groupBy("entity", "visit_idx").agg(F.array_sort(F.collect_set("token")).alias("t"))
    all_ = per.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("visit_idx", "t"))).alias("v"))
    t = F.concat(F.array(F.lit("[CLS]")), F.flatten(F.transform("v", lambda x: F.concat(F.array(F.lit("[VISIT]")), x["t"]))))
    if max_len:
        t = A.tail_truncated(t, max_len)
    if pad_to:
        t = A.padded(t, pad_to, F.lit("[PAD]"))
    return all_.select("entity", t.alias("tokens"))


def encoded(framed_rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(entity, input_ids): token ids in order; unknown tokens are left out."""
    rows = framed_rows.select("entity", F.posexplode("tokens").alias("pos", "token")).join(vocab.select("token", "id"), "token")
    return rows.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("input_ids"))


def hash_point(key: Column, seed: int) -> Column:
    """A number in 0..2^32-1 from the key, the same in any engine that has md5."""
    return F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), key)), F.lit(8)), 16, 10).cast("bigint")


def entity_split(entities: DataFrame, key: str, seed: int = 42, shares: tuple[int, int, int] = (70, 10, 20)) -> DataFrame:
    """Split by hash bucket of the entity: train, val, test; every row of an entity falls together."""
    b = F.pmod(hash_point(F.col(key), seed), F.lit(sum(shares)))
    return entities.withColumn("split", F.when(b < shares[0], "train").when(b < shares[0] + shares[1], "val").otherwise("test"))


def stored_split(rows: DataFrame, key: str, train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """Split by stored lists of keys; rows in none are left out."""
    lists = None
    for name, ids in (("train", train), ("val", val), ("test", test)):
        x = ids.select(F.col(key)).distinct().withColumn("split", F.lit(name))
        lists = x if lists is None else lists.unionByName(x)
    return rows.join(lists, key)


def subsample(entities: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n distinct entities without replacement: those with the least hash."""
    return entities.select(key).where(F.col(key).isNotNull()).distinct().orderBy(hash_point(F.col(key), seed), key).limit(n)
