"""Episode mining, carriers, scoring and pattern selection.

An episode is a sequence of item sets, array<array<string>>, items sorted.
carriers(pattern_id, key) is the normalised edge table everything else uses.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import arrays as A
from chronoweave.functions import stats as S
from chronoweave.functions import text as X


def mine_episodes(sequences: DataFrame, min_support: float, max_items: int = 4, min_items: int = 1, top: int | None = None) -> DataFrame:
    """All item-set sequences of at most max_items items in at least ceil(min_support * rows) rows: (pattern, support).

    sequences has a column `blocks`; rows with empty blocks count for the
    threshold. `top` keeps the best supported, ties by the rendered pattern.
    """
    rows = sequences.select(F.filter(F.coalesce("blocks", F.array().cast("array<array<string>>")), lambda b: F.size(b) > 0).alias("sequence"))
    found = PrefixSpan(minSupport=min_support, maxPatternLength=max_items, sequenceCol="sequence").findFrequentSequentialPatterns(rows)
    out = found.select(X.canonical("sequence").alias("pattern"), F.col("freq").alias("support")).where(F.size(F.flatten("pattern")) >= min_items)
    if top:
        out = out.orderBy(F.desc("support"), X.rendered("pattern")).limit(top)
    return out


def mine_flat(sequences: DataFrame, min_support: float, min_len: int = 1, max_len: int = 4, top: int | None = None) -> DataFrame:
    """Frequent gapped subsequences of flat token arrays (`tokens`), events only."""
    single = sequences.select(F.transform(F.filter("tokens", lambda t: X.is_event(t)), lambda t: F.array(t)).alias("blocks"))
    return mine_episodes(single, min_support, max_len, min_len, top)


def ngram_sets(sequences: DataFrame, n_min: int = 1, n_max: int = 3) -> DataFrame:
    """Distinct (key, y, ngram) of contiguous event windows; ngram is tokens joined by ` -> `."""
    events = F.filter("tokens", lambda t: X.is_event(t))
    windows = F.flatten(F.array(*[A.ngrams(F.col("t"), n) for n in range(n_min, n_max + 1)]))
    return sequences.select("key", "y", events.alias("t")).select("key", "y", F.explode(F.array_distinct(F.transform(windows, lambda w: F.array_join(w, X.STEP)))).alias("ngram"))


def frequent_in_a_group(sets: DataFrame, item: str, min_frac: float) -> DataFrame:
    """Items in at least ceil(min_frac * n) keys of the positive or of the negative group."""
    totals = sets.select("key", "y").distinct().groupBy("y").agg(F.count("*").alias("n"))
    per = sets.where("y is not null").groupBy(item, "y").agg(F.countDistinct("key").alias("k"))
    return per.join(F.broadcast(totals), "y").where(F.col("k") >= F.greatest(F.lit(1), F.ceil(F.lit(min_frac) * F.col("n")))).select(item).distinct()


def pattern_table(patterns: DataFrame) -> DataFrame:
    """(pattern_id, pattern, text, n_tokens, n_steps) of distinct patterns; the id is the rendered text."""
    p = patterns.select(X.canonical("pattern").alias("pattern")).distinct()
    return p.select(X.rendered("pattern").alias("pattern_id"), "pattern", F.size(F.flatten("pattern")).alias("n_tokens"), F.size("pattern").alias("n_steps"))


def _tree(patterns: list[tuple[str, list[list[str]]]]) -> list:
    """Patterns as a tree over their steps. A node is [ids that end here, {first item of a step: [(its other items, node), ...]}]."""
    root: list = [[], {}]
    for name, steps in patterns:
        node = root
        for items in steps:
            head, *rest = sorted(set(items))
            children = node[1].setdefault(head, [])
            found = next((c for r, c in children if r == rest), None)
            if found is None:
                children.append((rest, found := [[], {}]))
            node = found
        if node is not root:
            node[0].append(name)
    return root


def _matches(root: list, blocks: list[list[str] | None]) -> Iterator[tuple[str, list[int]]]:
    """(pattern, blocks of its leftmost match) of all patterns in one sequence, each step in a block of its own, in order."""
    sets = [set(b or ()) for b in blocks]
    where: dict[str, list[int]] = {}
    for k, b in enumerate(sets):
        for x in b:
            where.setdefault(x, []).append(k)
    todo: list[tuple[list, list[int]]] = [(root, [])]
    while todo:
        (names, children), hits = todo.pop()
        for n in names:
            yield n, hits
        last = hits[-1] if hits else -1
        for head in children.keys() & where.keys():
            at = where[head]
            after = bisect_right(at, last)
            if after == len(at):
                continue
            for rest, child in children[head]:
                hit = at[after] if not rest else next((k for k in at[after:] if sets[k].issuperset(rest)), None)
                if hit is not None:
                    todo.append((child, [*hits, hit]))


def _matcher(shared, n_rows: int = 256):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = _tree(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, n_rows):
                b = whole.slice(lo, n_rows)
                found = [(p, k, hits) for k, (blocks) in enumerate(b.column("blocks").to_pylist()) for p, hits in _matches(root, blocks or [])]
                keys = b.column("key").take(pa.array([k for _, k, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in found], pa.string()), keys, pa.array([h for _, _, h in found], pa.list_(pa.int32()))], names=["pattern_id", "key", "hits"])

    return match


def carriers(patterns: DataFrame, sequences: DataFrame, tree_size: int = 100_000) -> DataFrame:
    """(pattern_id, key, hits): which sequences contain which patterns, with the matched blocks of the leftmost match.

    Containment join in one pass over the sequences: the patterns go out as a
    broadcast tree over their steps, which every sequence walks as far as it
    matches, so patterns that start alike are matched together and nothing is
    shuffled. A tree holds about `tree_size` patterns; more take further passes.
    A pattern without tokens matches nothing, as does a null or empty sequence;
    keys must not be null.
    """
    spark = sequences.sparkSession
    named = patterns.select("pattern_id", "pattern").where("pattern is not null and size(flatten(pattern)) > 0 and not exists(pattern, s -> size(s) = 0)")
    rows = sequences.select(F.col("key").cast("string").alias("key"), "blocks")
    out = spark.createDataFrame([], "pattern_id string, key string, hits array<int>")
    parts = -(-named.count() // tree_size)
    for k in range(parts):
        shared = spark.sparkContext.broadcast([(r.pattern_id, r.pattern) for r in named.where(F.pmod(F.xxhash64("pattern_id"), F.lit(parts)) == k).collect()])
        part = rows.mapInArrow(_matcher(shared), "pattern_id string, key string, hits array<int>")
        out = part if k == 0 else out.unionByName(part)
    return out


def pair_episodes(blocks: DataFrame, min_support: int) -> DataFrame:
    """Frequent patterns of one or two items by plain self-joins: (pattern, support). Faster than general mining where two items are enough."""
    items = blocks.select("key", "block_idx", F.explode("items").alias("a"))
    often = items.groupBy("a").agg(F.countDistinct("key").alias("n")).where(F.col("n") >= min_support)
    items = items.join(often.select("a"), "a", "left_semi")
    span = items.groupBy("key", "a").agg(F.min("block_idx").alias("first"), F.max("block_idx").alias("last"))
    x, y = span.alias("x"), span.alias("y")
    after = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.first") < F.col("y.last"))).groupBy(F.array(F.array("x.a"), F.array("y.a")).alias("pattern")).agg(F.count("*").alias("support"))
    p, q = items.alias("p"), items.alias("q")
    within = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.block_idx") == F.col("q.block_idx")) & (F.col("p.a") < F.col("q.a"))).groupBy(F.array(F.array("p.a", "q.a")).alias("pattern")).agg(F.countDistinct("p.key").alias("support"))
    ones = often.select(F.array(F.array("a")).alias("pattern"), F.col("n").alias("support"))
    return ones.unionByName(after).unionByName(within).where(F.col("support") >= min_support)


def scored(edges: DataFrame, labels: DataFrame, min_support: int = 1, with_p: bool = True) -> DataFrame:
    """2x2 statistics of every pattern over all labelled keys.

    edges: (pattern_id, key); labels: (key, y). Patterns below min_support are
    dropped before tests are counted, so the correction counts what is left.
    """
    known = labels.where("y is not null").select("key", "y").distinct()
    totals = known.agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    cells = edges.select("pattern_id", "key").distinct().join(known, "key").groupBy("pattern_id").agg(F.count("*").alias("n_present"), F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    rows = cells.where(F.col("n_present") >= min_support).join(F.broadcast(totals))
    a, b, c, d = F.col("a"), F.col("b"), F.col("n1") - F.col("a"), F.col("n0") - F.col("b")
    out = rows.select(
        "pattern_id", "n_present", F.col("a").alias("n_present_pos"), F.col("b").alias("n_present_neg"), F.col("n1").alias("n_total_pos"), F.col("n0").alias("n_total_neg"),
        S.odds_ratio(a, b, c, d).alias("odds_ratio"), F.log(S.odds_ratio(a, b, c, d)).alias("log_or"), S.chi2_yates(a, b, c, d).alias("chi2"),
        (a / F.greatest(F.col("n1"), F.lit(1))).alias("prev_pos"), (b / F.greatest(F.col("n0"), F.lit(1))).alias("prev_neg"),
    ).withColumn("prev_diff", F.col("prev_pos") - F.col("prev_neg"))
    if not with_p:
        return out
    tests = out.agg(F.count("*").alias("n_tests"))
    out = out.withColumn("p", S.chi2_p("chi2")).join(F.broadcast(tests))
    return out.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p") * F.col("n_tests"))).withColumn("significant", F.col("p_bonferroni") < 0.05).drop("n_tests")


def support_floor(fraction: float, min_support_frac: float, n: int) -> int:
    """Scoring floor: negative takes the mining support, zero is one, positive its own share of the cohort."""
    if fraction == 0:
        return 1
    f = min_support_frac if fraction < 0 else fraction
    return max(1, -int(-(f * n) // 1))


def capped(scored_rows: DataFrame, n: int, metric: str = "odds_ratio", by: str = "n_steps") -> DataFrame:
    """Per step count the n/2 largest and n/2 smallest by odds ratio, or by the sign of the difference in prevalence (positive, and not positive)."""
    half = max(1, n // 2)
    if metric == "odds_ratio":
        up = F.row_number().over(W.partitionBy(by).orderBy(F.desc(metric), "pattern_id"))
        down = F.row_number().over(W.partitionBy(by).orderBy(F.asc(metric), "pattern_id"))
        return scored_rows.withColumn("u", up).withColumn("d", down).where((F.col("u") <= half) | (F.col("d") <= half)).drop("u", "d")
    side = F.col(metric) > 0
    rank = F.row_number().over(W.partitionBy(by, side).orderBy(F.desc(F.abs(metric)), "pattern_id"))
    return scored_rows.withColumn("u", rank).where(F.col("u") <= half).drop("u")


def balanced_top(df: DataFrame, value: Column, n: int, tie: str) -> DataFrame:
    """The n/2 largest positive and n/2 most negative rows."""
    half = max(1, n // 2)
    rows = df.withColumn("__v", value).where("__v != 0").withColumn("side", F.signum("__v"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("side").orderBy(F.desc(F.abs("__v")), tie))).where(F.col("rank") <= half).drop("__v")


def pooled_patterns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct patterns of two groups."""
    return a.select("pattern").unionByName(b.select("pattern")).distinct()


def one_sided(a: DataFrame, b: DataFrame) -> DataFrame:
    """Patterns found in one group alone, with the side they were found on: those that need a cross-check."""
    only_a = a.select("pattern").join(b.select("pattern"), "pattern", "left_anti").withColumn("side", F.lit("a"))
    return only_a.unionByName(b.select("pattern").join(a.select("pattern"), "pattern", "left_anti").withColumn("side", F.lit("b")))


def mine_and_score(sequences: DataFrame, min_frac: float, scoring_frac: float = -1.0, max_items: int = 3, method: str = "episode", min_steps: int = 1, cap: int = 0, cap_metric: str = "odds_ratio", with_p: bool = True) -> DataFrame:
    """Mine positives and negatives apart, pool the patterns, find carriers over everyone and score.

    sequences: key, y, blocks, tokens. Methods: `episode` (item sets over
    blocks), `prefix` (flat gapped) and `ngram` (flat contiguous).
    """
    known = sequences.where("y is not null")
    n = known.count()
    floor = support_floor(scoring_frac, min_frac, n)
    if method == "ngram":
        sets = ngram_sets(known, 1, max_items)
        edges = sets.join(frequent_in_a_group(sets, "ngram", min_frac), "ngram", "left_semi").select(F.col("ngram").alias("pattern_id"), "key")
        steps = F.size(F.split("pattern_id", X.STEP))
    else:
        flat = method == "prefix"
        seqs = known.select("key", "y", F.transform(F.filter("tokens", lambda t: X.is_event(t)), lambda t: F.array(t)).alias("blocks")) if flat else known.select("key", "y", "blocks")
        groups = [mine_episodes(seqs.where(F.col("y") == y), min_frac, max_items) for y in (1, 0)]
        edges = carriers(pattern_table(pooled_patterns(*groups)), seqs).select("pattern_id", "key")
        steps = F.size(F.split("pattern_id", X.STEP))
    out = scored(edges, known.select("key", "y"), floor, with_p).withColumn("n_steps", steps).where(F.col("n_steps") >= min_steps)
    return capped(out, cap, cap_metric) if cap else out
