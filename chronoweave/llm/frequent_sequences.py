"""Frequent gapped subsequences, level by level, with a broadcast candidate tree."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.common import checkpointed, clean_id

#: Up to so many children of a node are looked up one by one.
_NARROW = 6
#: Tokens that count as events.
EVENT = r"^[CPD]:"


def _encoder(vocab: list[str], marker: str):
    """Arrow batches of (e, t) to (e, ids, blocks): frequent tokens only, each (token, block) once, sorted."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column("t")
            values, n = t.flatten(), len(t)
            lens = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(pc.index_in(values, value_set=pa.array(vocab, values.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            mark = pc.fill_null(pc.equal(values, pa.scalar(marker, values.type)), False).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), lens)
            seen = np.concatenate([[0], np.cumsum(mark)])
            first = np.concatenate([[0], np.cumsum(lens)])[:-1]
            block = seen[1:] - seen[first][row] if n else seen[1:]
            keep = ids >= 0
            row, ids, block = row[keep], ids[keep], block[keep]
            # One sortable key per (row, token, block).
            span = int(block.max()) + 1 if len(block) else 1
            key = np.unique((row * max(1, len(vocab)) + ids) * span + block)
            rows = key // (span * max(1, len(vocab)))
            offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (key // span % max(1, len(vocab)), key % span)]
            yield pa.RecordBatch.from_arrays([b.column("e"), *lists], names=["e", "ids", "blocks"])

    return encode


def _counter(tree, width: int):
    """Count each candidate's gapped matches, walking the candidate tree over a whole batch of sequences at once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cands: np.ndarray = tree.value
        root: dict = {}
        for i, c in enumerate(cands.tolist()):
            node = root
            for x in c[:-1]:
                node = node.setdefault(x, {})
            node[c[-1]] = i
        depth = cands.shape[1]
        single = np.zeros(len(cands), np.int64)
        out = pa.schema([("cand", pa.int32()), ("e", pa.string()), ("n", pa.int64())])
        for b in batches:
            e, ids, blocks = b.column("e"), b.column("ids"), b.column("blocks")
            lens = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(e)), lens)
            i, k = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, blocks))
            span = int(k.max()) + 2 if len(k) else 2
            keys = (row * width + i) * span + k  # ascending by construction
            alone = pc.is_null(e).to_numpy(zero_copy_only=False)
            several: list[tuple[int, np.ndarray]] = []

            offsets = np.concatenate([[0], np.cumsum(lens)])

            def each(node: dict, rows: np.ndarray, last: np.ndarray) -> Iterator[tuple]:
                """(child, rows that go on to it, block reached) of a node's children."""
                if len(node) <= _NARROW:
                    for token, child in node.items():
                        home = rows * width + token
                        at = np.searchsorted(keys, home * span + last + 1)
                        inside = at < len(keys)
                        hit = np.zeros(len(rows), bool)
                        hit[inside] = keys[at[inside]] // span == home[inside]
                        yield child, rows[hit], keys[at[hit]] % span
                    return
                # Many children: one pass over all that follows in those rows, grouped by token.
                n = lens[rows]
                own = np.repeat(np.arange(len(rows)), n)
                at = np.repeat(offsets[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
                later = k[at] > last[own]
                own, at = own[later], at[later]
                group = own * width + i[at]  # ascending, as rows and the tokens of a row are
                first = np.ones(len(group), bool)
                first[1:] = group[1:] != group[:-1]
                own, at = own[first], at[first]
                order = np.argsort(i[at], kind="stable")
                ends = np.searchsorted(i[at][order], np.arange(width + 1))
                for token, child in node.items():
                    seg = order[ends[token] : ends[token + 1]]
                    yield child, rows[own[seg]], k[at[seg]]

            def walk(node: dict, rows: np.ndarray, last: np.ndarray, level: int) -> None:
                for child, found, reached in each(node, rows, last):
                    if not len(found):
                        continue
                    if level == depth:
                        a = alone[found]
                        single[child] += int(a.sum())
                        if not a.all():
                            several.append((child, found[~a]))
                    else:
                        walk(child, found, reached, level + 1)

            if len(keys):
                walk(root, np.arange(len(e)), np.full(len(e), -1), 1)
            if several:
                cand = np.concatenate([np.full(len(r), c) for c, r in several]).astype(np.int32)
                t = pa.table({"cand": cand, "e": e.take(pa.array(np.concatenate([r for _, r in several]))).cast(pa.string())})
                t = t.group_by(["cand", "e"]).aggregate([])
                yield from pa.table({"cand": t["cand"], "e": t["e"], "n": pa.array(np.ones(t.num_rows, np.int64))}, schema=out).to_batches()
        some = np.flatnonzero(single)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.nulls(len(some), pa.string()), pa.array(single[some])], schema=out)

    return count


def _support(counts: DataFrame, key: str) -> DataFrame:
    """Entities per key. Rows without e are counts of entities with one row each; the others are one entity each, however often."""
    return counts.groupBy(key, "e").agg(F.sum("n").alias("n")).groupBy(key).agg(F.sum(F.when(F.col("e").isNull(), F.col("n")).otherwise(1)).alias("n"))


#: Pairs looked at together, and distinct pairs held before they go out.
_PAIRS_AT_ONCE, _PAIRS_HELD = 4_000_000, 4_000_000


def _pair_counter(width: int):
    """Count, per partition, the sequences that hold token a before token b, all pairs that occur at once; cand is a * width + b."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("cand", pa.int64()), ("e", pa.string()), ("n", pa.int64())])
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, back = np.unique(np.concatenate([np.zeros(0, np.int64), *(c for c, _ in held)]), return_inverse=True)
            return codes, np.bincount(back, weights=np.concatenate([np.zeros(0), *(n for _, n in held)]), minlength=len(codes)).astype(np.int64)

        def alone_rows() -> pa.RecordBatch:
            codes, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.nulls(len(codes), pa.string()), pa.array(n)], schema=out)

        for b in batches:
            e, ids, blocks = b.column("e"), b.column("ids"), b.column("blocks")
            lens = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            i, k = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, blocks))
            if not len(i):
                continue
            row = np.repeat(np.arange(len(e)), lens)
            new = np.ones(len(i), bool)  # a row's tokens are sorted, and each token's blocks
            new[1:] = (row[1:] != row[:-1]) | (i[1:] != i[:-1])
            begin = np.flatnonzero(new)
            row, i, first, last = row[begin], i[begin], k[begin], k[np.append(begin[1:], len(k)) - 1]
            start = np.searchsorted(row, row)
            n = np.searchsorted(row, row, side="right") - start
            alone = pc.is_null(e).to_numpy(zero_copy_only=False)[row]
            upto = np.cumsum(n)
            lo = 0
            while lo < len(row):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PAIRS_AT_ONCE, side="right")))
                m = n[lo:hi]
                x = np.repeat(np.arange(lo, hi), m)
                y = np.repeat(start[lo:hi] - np.cumsum(m) + m, m) + np.arange(m.sum())
                ok = first[x] < last[y]
                x, y = x[ok], y[ok]
                code, one = i[x] * width + i[y], alone[x]
                held.append(tuple(np.unique(code[one], return_counts=True)))
                if not one.all():
                    t = pa.table({"cand": code[~one], "e": e.take(pa.array(row[x[~one]])).cast(pa.string())}).group_by(["cand", "e"]).aggregate([])
                    yield from pa.table({"cand": t["cand"], "e": t["e"], "n": pa.array(np.ones(t.num_rows, np.int64))}, schema=out).to_batches()
                if sum(len(c) for c, _ in held) > _PAIRS_HELD:
                    held[:] = [merged()]
                    if len(held[0][0]) > _PAIRS_HELD // 2:
                        yield alone_rows()
                lo = hi
        yield alone_rows()

    return count


def _patterns_of(tree):
    """(cand, n) of one tree to (p, n)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cands: np.ndarray = tree.value
        depth = cands.shape[1]
        for b in batches:
            p = cands[b.column("cand").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, depth, dtype=np.int32)), pa.array(p.ravel().astype(np.int32))), b.column("n")], names=["p", "n"])

    return name


def _rendered(vocab: list[str]):
    """(p, n) to (pattern, n_tokens, n)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column("p")
            tokens = pa.ListArray.from_arrays(p.offsets, pa.array(vocab, pa.string()).take(p.values))
            yield pa.RecordBatch.from_arrays([pc.binary_join(tokens, " -> "), pc.list_value_length(p).cast(pa.int32()), b.column("n")], names=["pattern", "n_tokens", "n_entities"])

    return name


def candidates(frequent: DataFrame, length: int) -> DataFrame:
    """(p) of the given length: frequent patterns joined that overlap in all but their ends, without those that have an infrequent subpattern."""
    k = length - 1
    x = frequent.select(F.col("p").alias("x"), F.slice("p", 2, k - 1).alias("mid"))
    y = frequent.select(F.element_at("p", -1).alias("tail"), F.slice("p", 1, k - 1).alias("mid"))
    c = x.join(y, "mid").select(F.concat("x", F.array("tail")).alias("p"))
    for i in range(1, length - 1):  # the first and the last are left out by the join itself
        sub = frequent.select(F.col("p").alias("sub"))
        c = c.withColumn("sub", F.concat(F.slice("p", 1, i), F.slice("p", i + 2, length))).join(sub, "sub", "left_semi").drop("sub")
    return c


def frequent_sequences(
    df: DataFrame,
    entity: str = "patient_id",
    tokens: str = "combined_full",
    min_frac: float = 0.03,
    min_abs: int = 10,
    min_len: int = 2,
    max_len: int = 4,
    marker: str = "[VISIT]",
    tree_size: int = 250_000,
) -> DataFrame:
    """Ordered token patterns that many entities share, gaps allowed, with their support.

    A pattern's tokens come from strictly later visit blocks each; repeats are
    allowed. Support is the number of distinct entities with a sequence that
    contains it; a pattern is kept at max(min_abs, ceil(min_frac * entities)).

    Frequent tokens are numbered; their pairs are counted where they occur, added
    up in local arrays. From then on level k+1's candidates join level k's patterns,
    which are a table; those with an infrequent subpattern are pruned by semi-joins;
    the rest goes out in broadcast prefix trees of about `tree_size` candidates, one
    after another, and each task counts a tree over whole Arrow batches, adding up
    in local counter arrays. Only counts are shuffled. Entities with several rows
    (repeats, or several index visits) are told apart first; for them alone
    (candidate, entity) pairs are made distinct, so no entity is ever gathered in
    one place.

    The driver holds the frequent tokens, at most (mean distinct tokens of an
    entity) / min_frac whatever the number of rows, and one tree at a time.

    Output: pattern (` -> ` between tokens), n_tokens, n_entities, n_total.
    Null entity or null token array: no sequence; null tokens, [CLS], [PAD] and
    other non-events are skipped; tokens before the first marker form a block of
    their own; empty table: no rows; other columns are ignored.
    """
    spark = df.sparkSession
    base = df.select(clean_id(entity).alias("e"), F.col(tokens).alias("t")).where("e is not null and t is not null")
    per = base.groupBy("e").agg(F.count("*").alias("rows"))
    total, n_multi = per.agg(F.count("*"), F.count_if(F.col("rows") > 1)).first()
    support = max(min_abs, int(np.ceil(round(min_frac * total, 9))))
    multi = per.where("rows > 1").select("e", F.lit(True).alias("multi"))
    # Up to 200,000 short ids are sent along, so that the sequences stay where they are.
    flagged = base.join(F.broadcast(multi) if n_multi <= 200_000 else multi, "e", "left").select(F.when(F.col("multi"), F.col("e")).alias("e"), "t")

    events = flagged.select("e", F.explode(F.array_distinct(F.filter("t", lambda x: x.rlike(EVENT)))).alias("tok"))
    level1 = sorted((r.tok, r.n) for r in _support(events.withColumn("n", F.lit(1)), "tok").where(F.col("n") >= support).collect())
    vocab = [t for t, _ in level1]
    levels = [spark.createDataFrame([([i], n) for i, (_, n) in enumerate(level1)] if min_len <= 1 else [], "p array<int>, n bigint")]
    if vocab and max_len >= 2:
        coded = checkpointed(flagged.mapInArrow(_encoder(vocab, marker), "e string, ids array<int>, blocks array<int>"))
        width = F.lit(len(vocab))
        pairs = _support(coded.mapInArrow(_pair_counter(len(vocab)), "cand bigint, e string, n bigint"), "cand").where(F.col("n") >= support)
        frequent = checkpointed(pairs.select(F.array(F.floor(F.col("cand") / width), F.col("cand") % width).cast("array<int>").alias("p"), "n"))
        for length in range(2, max_len + 1):
            if length > 2:
                todo = checkpointed(candidates(frequent.select("p"), length))
                parts = -(-todo.count() // tree_size)
                level = spark.createDataFrame([], "p array<int>, n bigint")
                for k in range(parts):
                    chunk = [r.p for r in todo.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == k).collect()]  # about tree_size
                    if not chunk:
                        continue
                    tree = spark.sparkContext.broadcast(np.array(chunk, np.int32))
                    raw = coded.mapInArrow(_counter(tree, len(vocab)), "cand int, e string, n bigint")
                    level = level.unionByName(checkpointed(_support(raw, "cand").where(F.col("n") >= support).mapInArrow(_patterns_of(tree), "p array<int>, n bigint")))
                    tree.destroy()
                frequent = level
            if length >= min_len:
                levels.append(frequent)
            if frequent.isEmpty():
                break
    found = functools.reduce(DataFrame.unionByName, levels)
    return found.mapInArrow(_rendered(vocab), "pattern string, n_tokens int, n_entities bigint").withColumn("n_total", F.lit(total).cast("bigint"))
