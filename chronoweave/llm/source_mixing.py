"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.common import ROWS_PER_BUCKET, checkpointed, hash_bucket, running_total

#: Split pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Points are fractions of 2^40, and 2^40 / golden ratio is odd: its multiples are the golden-ratio points, each once in 2^40 slots.
POINTS = 1 << 40
GOLDEN = 679535556991
HALF = 1 << 20


def golden_point(slot: Column) -> Column:
    """slot * GOLDEN modulo 2^40, in two halves that stay within 64 bits."""
    high, low = F.floor(slot / HALF), F.pmod(slot, F.lit(HALF))
    return F.pmod(F.pmod(F.pmod(high, F.lit(HALF)) * F.lit(GOLDEN), F.lit(HALF)) * F.lit(HALF) + low * F.lit(GOLDEN), F.lit(POINTS))


def _token_counter(vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        enc = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return count


def token_counts(docs: DataFrame, doc_id: Column, source: Column, text: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of every whole text: (doc_id, source, n_tokens); null and empty texts have none.

    The vocabulary file, of a fixed size of some hundred kB, is read here and sent along.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(doc_id.cast("bigint").alias("doc_id"), source.cast("string").alias("source"), text.cast("string").alias("text"))
    return rows.mapInArrow(_token_counter(sent), "doc_id bigint, source string, n_tokens bigint")


def planned(available: DataFrame, targets: DataFrame, total: int | None) -> tuple[DataFrame, int]:
    """(source, target_share, max_repeats, available_tokens, planned_tokens) and the planned total.

    A source is planned its share of the total, but no more than its tokens times its repeats.
    """
    goals = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).cast("double").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).cast("int").alias("max_repeats"))
    rows = goals.join(available, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    s = rows.agg(F.coalesce(F.round(F.sum("target_share"), 12), F.lit(0.0)).alias("w"), F.coalesce(F.sum("available_tokens"), F.lit(0)).alias("t")).first()
    total = s.t if total is None else total
    want = F.floor(F.lit(total) * F.col("target_share") / F.lit(s.w or 1.0) + 1e-6)
    most = F.col("available_tokens") * F.greatest(F.lit(0), F.col("max_repeats"))
    return rows.withColumn("planned_tokens", F.least(want.cast("long"), most.cast("long"))), total


def schedule_of(slots: DataFrame) -> DataFrame:
    """(slot, source, rank): which source each slot takes, and which of the source's slots it is.

    slots: (source, slots). Sources own intervals of the points, as wide as their
    part of all slots; a slot belongs to the source whose interval its
    golden-ratio point falls into. Both are met by an equality join on cells of the
    points, of which there are a few for each source.
    """
    spark = slots.sparkSession
    n_sources, n = slots.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "slot bigint, source string, rank bigint")
    order = F.xxhash64("source")
    edges = running_total(slots.withColumn("h", order).withColumn("bucket", hash_bucket(F.col("h"), max(1, n_sources // ROWS_PER_BUCKET))), [], "bucket", ["h", "source"], F.col("slots"), "from")
    part = lambda c: F.floor(c.cast("decimal(38,0)") * POINTS / F.lit(n)).cast("long")
    owned = edges.select("source", "slots", part(F.col("from")).alias("lo"), part(F.col("from") + F.col("slots")).alias("hi"))
    width = POINTS >> (4 * n_sources).bit_length()
    cells = owned.where("hi > lo").select("*", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    # Of N golden-ratio points an interval misses at most 2.62 / N, so within 3 N slots every source has all its slots; surplus ranks are cut.
    many = spark.range(0, 3 * n + 64).withColumnRenamed("id", "slot").withColumn("point", golden_point(F.col("slot")))
    taken = many.withColumn("cell", F.floor(F.col("point") / width)).join(cells, "cell").where("point >= lo and point < hi")
    ranked = running_total(taken.select("slot", "source", "slots", F.floor(F.col("slot") / ROWS_PER_BUCKET).alias("range")), ["source"], "range", ["slot"], F.lit(1), "rank")
    return ranked.where("rank < slots").select("slot", "source", F.col("rank").cast("long").alias("rank"))


def mixed(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 2048, seed: int = 3, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Draw documents so that every source gives its target share of the tokens.

    docs: doc_id, source, text. targets: source, target_share, max_repeats (of
    several rows for a source the largest values).

    The documents of a source are shuffled by hash and laid end to end, at running
    totals taken in hash ranges, so a source that holds most documents is no
    single group; repeated as often as the plan needs, they are cut at every
    `block_tokens` tokens and at the last planned token. A document that lies
    across a cut gives a piece to either block, so blocks are equal and a source
    gives exactly the tokens planned. A schedule of slots maps golden-ratio points
    through the cumulative drawn weights to sources; the r-th slot of a source
    takes its r-th block. Ranks are running totals over ranges of slots. Prefixes
    of the schedule therefore follow the target shares too.

    A source that cannot reach its share gives all it may; the others keep their
    share of the planned total (default: all tokens of the listed sources).

    Returns the draws (slot, source, repeat_no, block, doc_id, first_token,
    n_tokens; repeat_no from 1, first_token from 0 within the document) and the
    report (source, target_share, max_repeats, available_tokens, planned_tokens,
    drawn_tokens, drawn_documents, actual_share).
    Null doc ids, null sources, sources without a target and texts without tokens
    are not drawn; repeated rows of a doc_id count once; no documents: a report of
    zeros (actual_share null) and no draws; other columns are ignored.
    """
    counted = token_counts(docs.where("doc_id is not null and source is not null"), F.col("doc_id"), F.col("source"), F.col("text"), vocabulary)
    known = targets.select(F.col("source").cast("string")).where("source is not null").distinct()
    sizes = checkpointed(counted.where("n_tokens > 0").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")).join(known, "source", "left_semi"))
    available = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    goals, _ = planned(available, targets, total_tokens)
    goals = checkpointed(goals)
    drawn = goals.where("planned_tokens > 0").select("source", "available_tokens", "planned_tokens", F.ceil(F.col("planned_tokens") / block_tokens).alias("slots"))

    n_docs = sizes.count()
    shuffled = sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", hash_bucket(F.col("h"), max(1, n_docs // ROWS_PER_BUCKET)))
    at = running_total(shuffled, ["source"], "bucket", ["h", "doc_id"], F.col("n_tokens"), "before").join(drawn, "source")
    # Each repeat of a document is a stretch of its source's token line; the line ends with the plan.
    last = F.floor((F.col("planned_tokens") - 1 - F.col("before")) / F.col("available_tokens"))
    laid = at.where("before < planned_tokens").select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("turn"))
    laid = laid.withColumn("from", F.col("turn") * F.col("available_tokens") + F.col("before")).withColumn("to", F.least(F.col("from") + F.col("n_tokens"), F.col("planned_tokens")))
    pieces = laid.select("*", F.explode(F.sequence(F.floor(F.col("from") / block_tokens), F.floor((F.col("to") - 1) / block_tokens))).alias("rank"))
    lo = F.greatest(F.col("from"), F.col("rank") * block_tokens)
    hi = F.least(F.col("to"), (F.col("rank") + 1) * block_tokens)
    pieces = pieces.select("source", "rank", "doc_id", (F.col("turn") + 1).alias("repeat_no"), (lo - F.col("from")).alias("first_token"), (hi - lo).alias("n_tokens"))
    draws = checkpointed(schedule_of(drawn.select("source", "slots")).join(pieces, ["source", "rank"]).select("slot", "source", "repeat_no", F.col("rank").alias("block"), "doc_id", "first_token", "n_tokens"))
    return draws, shares_of(draws, goals)


def shares_of(draws: DataFrame, goals: DataFrame) -> DataFrame:
    """The report on the draws of a plan."""
    whole = draws.groupBy("source", "doc_id", "repeat_no").agg(F.sum("n_tokens").alias("n_tokens"))
    per = whole.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    everything = per.agg(F.sum("t").alias("all"))
    t = F.coalesce("t", F.lit(0))
    return goals.join(per, "source", "left").join(F.broadcast(everything)).select("source", "target_share", "max_repeats", "available_tokens", "planned_tokens", t.alias("drawn_tokens"), F.coalesce("n", F.lit(0)).alias("drawn_documents"), (t / F.col("all")).alias("actual_share"))
