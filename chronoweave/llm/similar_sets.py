"""All pairs of similar sets: a pigeonhole index over each set's rarest items, one-bit minhash codes as filter, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.common import checkpointed, hash_bucket, running_total

_U = np.uint64


#: Bits of a code, the same at every size.
BITS = 256


def calibrate(threshold: float, miss: float, bits: int = BITS) -> int:
    """The least Hamming radius that codes of two sets at the threshold exceed with probability below `miss`.

    A one-bit minhash of two sets of similarity J agrees with probability (1 + J) / 2,
    and more similar sets differ in fewer bits.
    """
    p = (1 + threshold) / 2
    tail = [math.comb(bits, k) * (1 - p) ** k * p ** (bits - k) for k in range(bits + 1)]
    over, radius = 0.0, bits
    while radius and over + tail[radius] < miss:
        over += tail[radius]
        radius -= 1
    return radius


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _minima(values: np.ndarray, starts: np.ndarray, n_bits: int, seed: int) -> np.ndarray:
    """[sets, n_bits] minhash values; no set may be empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, n_bits, dtype=np.uint64) * _U(2) + _U(1)
    c = rng.integers(0, 2**63, n_bits, dtype=np.uint64)
    x = _mix(values.view(np.uint64))
    out = np.empty((len(starts), n_bits), np.uint64)
    for i in range(n_bits):
        h = (x ^ c[i]) * a[i]
        h ^= h >> _U(32)
        out[:, i] = np.minimum.reduceat(h, starts)
    return out


def _bits(minima: np.ndarray) -> np.ndarray:
    return (_mix(minima) >> _U(63)).astype(np.uint8)


def _coder(seed: int):
    """(id, parts, hashes) to (id, parts, minima, code); minima only for chunks of a larger set."""

    def pack(minima: np.ndarray) -> pa.Array:
        words = np.packbits(_bits(minima), axis=1).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, BITS // 64, dtype=np.int32)), pa.array(words.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                lens = pc.list_value_length(b.column("hashes")).to_numpy(zero_copy_only=False).astype(np.int64)
                values = b.column("hashes").flatten().to_numpy(zero_copy_only=False)
                m = _minima(values, np.concatenate([[0], np.cumsum(lens)])[:-1], BITS, seed)
                part = b.column("parts").to_numpy() > 1
                minima = pa.array([x.tobytes() if p else None for x, p in zip(m, part)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("parts"), minima, pack(m)], names=["id", "parts", "minima", "code"])

    def merge(t):
        """The chunks of one set, each of BITS minima."""
        m = np.minimum.reduce([np.frombuffer(x, np.uint64) for x in t.column("minima").to_pylist()])
        return pa.table({"id": t.column("id")[:1], "code": pack(m[None, :])})

    return run, merge


def set_classes(df: DataFrame, set_id: Column, items: Column, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """The distinct (set_id, item) edges, and each set with its class of equal sets.

    Equal sets have the same size and the same two order-free 64-bit digests.
    Returns edges (id, item) and sets (id, n, rep): rep is the class's smallest id.
    """
    edges = checkpointed(df.select(set_id.alias("id"), F.explode(items.cast("array<string>")).alias("item")).where("id is not null and item is not null").distinct())
    sets = edges.groupBy("id").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(item))").alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(7), "item"), 24)).alias("s"), F.expr("bit_xor(xxhash64(item, 11L))").alias("y")).where(F.col("n") >= min_size)
    reps = sets.groupBy("n", "x", "s", "y").agg(F.min("id").alias("rep"))
    return edges, checkpointed(sets.join(reps, ["n", "x", "s", "y"]).select("id", "n", "rep"))


def _codes(edges: DataFrame, reps: DataFrame, chunk: int, seed: int) -> DataFrame:
    """(id, code): the one-bit minhash code of every representative; large sets are sketched in chunks whose minima are merged."""
    run, merge = _coder(seed)
    parts = F.ceil(F.col("n") / chunk)
    rows = edges.join(reps, "id").select("id", parts.alias("parts"), F.xxhash64("item").alias("h"))
    rows = rows.groupBy("id", "parts", F.pmod("h", "parts").alias("part")).agg(F.collect_list("h").alias("hashes"))
    kind = reps.schema["id"].dataType.simpleString()
    coded = rows.select("id", "parts", "hashes").mapInArrow(run, f"id {kind}, parts bigint, minima binary, code array<bigint>")
    if not reps.where(F.col("n") > chunk).isEmpty():
        coded = checkpointed(coded)
        large = coded.where("parts > 1").groupBy("id").applyInArrow(merge, f"id {kind}, code array<bigint>")
        return coded.where("parts = 1").select("id", "code").unionByName(large)
    return coded.select("id", "code")


def _segments(edges: DataFrame, reps: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """(id, n, item, pos, single): each representative's rarest items, one more than two sets at the threshold must share one of.

    item is a number; pos counts from 0, rarest first. Of a set of n items any
    partner shares at least o = ceil(threshold * n), hence one of the n - o + 1
    rarest (`single`) and two of the n - o + 2 rarest.
    """
    mine = edges.join(reps, "id").select("id", "n", F.xxhash64("item").alias("item"))
    df = mine.groupBy("item").agg(F.count("*").alias("df"))
    ranked = mine.join(df, "item")
    largest = reps.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if largest <= chunk:
        at = ranked.withColumn("pos", F.row_number().over(W.partitionBy("id").orderBy("df", "item")) - 1)
    else:  # ranks over buckets, so that no set is gathered in a task
        at = running_total(ranked.withColumn("bucket", F.struct("df", hash_bucket(F.col("item"), -(-largest // chunk)))), ["id"], "bucket", ["item"], F.lit(1), "pos")
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-9))
    return at.where(F.col("pos") <= F.col("n") - need + 1).select("id", "n", "item", F.col("pos").cast("long").alias("pos"), (F.col("pos") <= F.col("n") - need).alias("single"), (need == 1).alias("one"))


def similar_sets(df: DataFrame, set_id: Column, items: Column, threshold: float = 0.7, min_size: int = 3, miss: float = 1e-12, chunk: int = 50_000, heavy: int = 1000, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Pairs of different sets with intersection / union >= threshold, and the membership of equal sets.

    Equal sets form classes first; one representative each goes on. Every
    representative gets a code of 256 one-bit minhashes, whatever the size of the
    data, and its segments: the rarest of its items, as many as make it certain
    (pigeonhole) that two sets at the threshold agree in one. Sets that agree in
    a segment, whose sizes and positions allow the threshold and whose codes lie
    within a Hamming radius are candidates; they are verified on the original
    sets by counting shared items in an equi-join. The segments lose no pair; the
    radius is calibrated so that a pair at the threshold exceeds it with
    probability below `miss` (`calibrate`).

    A segment that more than `heavy` sets have is split by a second one: two sets
    whose first common item is heavy agree in a later one too, so they meet in
    the pair of items.

    A set of more than `chunk` items is sketched in chunks whose minima are
    merged; verification joins edges, so no set is ever an array in one row
    beyond `chunk` items.

    Returns pairs (a, b, n_a, n_b, n_both, similarity) between representatives,
    a < b, and members (id, n, rep).
    Null ids, null arrays and null items are ignored; repeated items and rows
    count once; the rows of an id add up; sets below min_size are left out; an
    empty table gives no rows.
    """
    edges, members = set_classes(df, set_id, items, min_size)
    reps = members.where("id = rep").select("id", "n")
    radius = calibrate(threshold, miss)
    segments = checkpointed(_segments(edges, reps, threshold, chunk))
    hot = checkpointed(segments.where("single").groupBy("item").agg(F.count("*").alias("k")).where(F.col("k") > heavy).select("item"))
    keys = segments.where("single").select("id", "n", "pos", F.col("item").alias("key"), F.lit(0).cast("long").alias("second"))
    if not hot.isEmpty():
        light = segments.where("single").join(hot, "item", "left_anti")
        first = segments.where("single").join(hot, "item", "left_semi")
        later = segments.select("id", F.col("item").alias("second"), F.col("pos").alias("p2"))
        # Sets that may share but one item with a partner meet in the heavy item itself.
        alone = first.where("one").select("id", "n", "pos", F.col("item").alias("key"), F.lit(1).cast("long").alias("second"))
        pairs_of = first.join(later, "id").where(F.col("p2") > F.col("pos")).select("id", "n", "pos", F.col("item").alias("key"), "second")
        keys = light.select("id", "n", "pos", F.col("item").alias("key"), F.lit(0).cast("long").alias("second")).unionByName(pairs_of).unionByName(alone)
    index = keys.join(_codes(edges, reps, chunk, seed), "id")
    a, b = index.alias("a"), index.alias("b")
    inverse = 1 / threshold
    most = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))  # items the two can share from this one on
    apart = sum((F.bit_count(F.get("a.code", F.lit(i)).bitwiseXOR(F.get("b.code", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    met = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.second") == F.col("b.second"))
        & (F.col("a.id") < F.col("b.id"))
        & (F.col("a.n") <= F.col("b.n") * (inverse + 1e-9))
        & (F.col("b.n") <= F.col("a.n") * (inverse + 1e-9))
        & (most * (1 + threshold) >= threshold * (F.col("a.n") + F.col("b.n")) - 1e-6)
        & (apart <= radius)
    )
    cands = checkpointed(a.join(b, met).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")).distinct())
    left = cands.join(edges.withColumnRenamed("id", "a"), "a")
    both = left.join(edges.withColumnRenamed("id", "b"), ["b", "item"]).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("n_both"))
    pairs = both.withColumn("similarity", F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).where(F.col("similarity") >= threshold)
    return pairs, members


def expanded(pairs: DataFrame, members: DataFrame, block: int = 1000) -> DataFrame:
    """All similar pairs (a, b), a < b, with the members of equal sets expanded.

    The result grows with the square of a class of equal sets by its nature; use
    the pairs and members themselves where that is too much. A class of more than
    `block` members is expanded in blocks, so its pairs come from many tasks.
    """
    sizes = members.groupBy("rep").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rep = members.select("id", "rep").join(sizes.where("blocks > 1"), "rep", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    x = rep.select("rep", F.col("id").alias("a"), own.alias("block"))
    y = rep.select("rep", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    equal = x.join(y, ["rep", "block"]).where("a < b").select("a", "b")
    flat = rep.select("id", "rep")
    p = pairs.select("a", "b").join(flat.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a").join(flat.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b")
    return equal.unionByName(p.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")))


def links_per_set(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per set: id, class_id (representative), class_size, n_links to other classes."""
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("class_size"))
    return members.join(sizes, "rep").join(links, "rep", "left").select("id", F.col("rep").alias("class_id"), "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
