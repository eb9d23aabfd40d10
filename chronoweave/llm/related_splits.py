"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.common import ROWS_PER_BUCKET, checkpointed, hash_bucket, running_total
from chronoweave.operators.graph import components


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Integral maximum flow of least cost by successive shortest paths with potentials.

    arcs: (from, to, capacity, cost), with costs of either sign and no negative
    cycle. Returns the flow on each arc.
    """
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for u, v, c, w in arcs:
        for a, b, x, y in ((u, v, c, w), (v, u, 0, -w)):
            graph[a].append(len(to))
            to.append(b)
            cap.append(x)
            cost.append(y)
    height: list = [0] * n
    for _ in range(n):  # Bellman-Ford, for the negative costs
        changed = False
        for u in range(n):
            for e in graph[u]:
                if cap[e] and height[u] + cost[e] < height[to[e]]:
                    height[to[e]] = height[u] + cost[e]
                    changed = True
        if not changed:
            break
    while True:
        dist: dict[int, object] = {source: 0}
        by: dict[int, int] = {}
        heap = [(0, source)]
        done = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for e in graph[u]:
                if cap[e] and to[e] not in done:
                    x = d + cost[e] + height[u] - height[to[e]]
                    if to[e] not in dist or x < dist[to[e]]:
                        dist[to[e]] = x
                        by[to[e]] = e
                        heapq.heappush(heap, (x, to[e]))
        if sink not in dist:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        far = max(dist.values())
        for u in range(n):
            height[u] += dist.get(u, far)
        push, v = None, sink
        while v != source:
            push = cap[by[v]] if push is None else min(push, cap[by[v]])
            v = to[by[v] ^ 1]
        v = sink
        while v != source:
            cap[by[v]] -= push
            cap[by[v] ^ 1] += push
            v = to[by[v] ^ 1]


#: Components that one min-cost flow rounds together.
_AT_ONCE = 16


def quotas(bundles: list[tuple[int, int, int]], shares: list[Fraction]) -> list[list[int]]:
    """Components of each bundle that each split gets.

    bundles: (records per component, positive records per component, components).
    From the largest components down, the fractional optimum gives every bundle
    the splits' shares of the records they still lack, leaning by its positives so
    that the splits' rates of positives become equal; a giant component that
    overfills a share is made up for by the smaller ones. The whole parts of it
    stay. What is left over, at most one component a split and bundle, is rounded
    by min-cost flows over _AT_ONCE components of neighbouring sizes each: from
    components through the rich or the poor side of a split (more or fewer
    positives than usual) to the split and the sink. Units into a split cost the
    growth of its squared deviation in records, units into its rich side the
    growth of its squared deviation in positives, both measured on all that has
    been placed so far, so a flow makes up for what those before it had to leave.
    Components of less than half the size wait for the flow of the larger ones.
    """
    splits = len(shares)
    scale = math.lcm(*(p.denominator for p in shares))
    part = [int(p * scale) for p in shares]  # whole numbers throughout: deviations are kept times `scale`
    total, positives = sum(z * m for z, _, m in bundles), sum(y * m for _, y, m in bundles)
    rate = positives / total if total else 0.0
    placed, labels = [0] * splits, [0.0] * splits  # labels: positives beyond the usual rate
    seen = 0.0
    pending, carry = [0.0] * splits, [0.0] * splits  # records left over by the fractional optimum, and by the flows, of the present size
    got = [[0] * splits for _ in bundles]
    # Largest first; among equal sizes, components rich and poor in positives take turns (golden-ratio order).
    by_label = sorted(range(len(bundles)), key=lambda i: (-bundles[i][0], bundles[i][1]))
    rank = {i: k * 0.6180339887498949 % 1.0 for k, i in enumerate(by_label)}
    order = sorted(by_label, key=lambda i: (-bundles[i][0], rank[i]))
    left: list[tuple[int, int]] = []  # (bundle, components)

    def put(i: int, s: int, n: int) -> None:
        nonlocal seen
        z, y, _ = bundles[i]
        got[i][s] += n
        placed[s] += n * z
        labels[s] += n * (y - rate * z)
        seen += n * (y - rate * z)

    def lacks() -> list[float]:
        lack = [max(0.0, part[s] * total - scale * (placed[s] + pending[s])) for s in range(splits)]
        whole = sum(lack)
        return [x / whole for x in lack] if whole else [p / scale for p in part]

    def due(want: list[float], records: float, extra: float) -> list[float]:
        """Positives beyond the usual rate that each split should get of the next records, for all splits to end at one rate."""
        after = sum(placed) + records
        return [(seen + extra) * (placed[s] + want[s] * records) / after - labels[s] for s in range(splits)]

    def room(share: float, change: float) -> float:
        """By how much a change of a share must be divided to leave it between 0 and 1."""
        free = 1 - share if change > 0 else share
        return abs(change) / free if free > 0 else math.inf if change else 0.0

    def settle() -> None:
        """Place what is left over by one flow."""
        units = sum(n for _, n in left)
        size = sum(bundles[i][0] * n for i, n in left) / units
        # Records: what the fractional optimum gives each split of these components, and what the flow before owes it.
        aim = [p + c for p, c in zip(pending, carry)]
        want = [max(0.0, x) / (size * units) for x in aim]
        extra = [(bundles[i][1] - rate * bundles[i][0]) for i, _ in left]
        middle = sum(e * n for e, (_, n) in zip(extra, left)) / units
        rich = [e > middle for e in extra]
        n_rich = sum(n for r, (_, n) in zip(rich, left) if r)
        high = sum(e * n for e, r, (_, n) in zip(extra, rich, left) if r) / max(1, n_rich)
        low = sum(e * n for e, r, (_, n) in zip(extra, rich, left) if not r) / max(1, units - n_rich)
        gap = high - low
        # Rich components each split should get.
        owed = due(want, size * units, high * n_rich + low * (units - n_rich))
        goal = [(owed[s] - low * want[s] * units) / gap if gap > 1e-9 else 0.0 for s in range(splits)]
        source, sink, node = 0, 1, 2 + len(left)
        arcs: list[tuple[int, int, int, int]] = []
        whole = lambda x: int(round(x * 1024))
        for k, (i, n) in enumerate(left):
            arcs.append((source, 2 + k, n, 0))
            for s in range(splits):
                arcs.append((2 + k, node + s + (splits if rich[k] else 0), n, 0))
        for s in range(splits):
            for k in range(n_rich if gap > 1e-9 else 0):
                arcs.append((node + splits + s, node + s, 1, whole(gap * gap * (2 * (k - goal[s]) + 1))))
            for k in range(units):
                arcs.append((node + s, sink, 1, whole(size * (size * (2 * k + 1) - 2 * aim[s]))))
        flow = min_cost_flow(node + 2 * splits, arcs, source, sink)
        at = 0
        for i, _ in left:
            for s in range(splits):
                if flow[at + 1 + s]:
                    put(i, s, flow[at + 1 + s])
            at += 1 + splits
        for s in range(splits):
            carry[s] = aim[s] - sum(bundles[i][0] * flow[k * (1 + splits) + 1 + s] for k, (i, _) in enumerate(left))
            pending[s] = 0.0
        left.clear()

    same: dict[int, list[int]] = {}
    for i in order:
        same.setdefault(bundles[i][0], []).append(i)
    for own in same.values():
        own.sort(key=lambda b: bundles[b][1])
    spread: dict[int, tuple[float, list[float], list[float]]] = {}
    waiting = 0
    for i in order:
        if left and 2 * bundles[i][0] < bundles[left[0][0]][0]:  # much smaller ones can still make up for these
            settle()
            waiting = 0
        z, y, m = bundles[i]
        if z not in spread:  # the first of its size: how its bundles' shares lean by their positives to make up for the drift
            own = same[z]
            mean = sum(bundles[b][1] * bundles[b][2] for b in own) / sum(bundles[b][2] for b in own)
            moment = sum(bundles[b][2] * (bundles[b][1] - mean) ** 2 for b in own)
            n, want = sum(bundles[b][2] for b in own), lacks()
            carry = [0.0] * splits
            extra = n * (mean - rate * z)
            lean = [(d - w * extra) / moment if moment > 1e-9 else 0.0 for d, w in zip(due(want, n * z, extra), want)]
            # No further than all shares stay between 0 and 1, so that the records remain as they are.
            ends = (bundles[own[0]][1] - mean, bundles[own[-1]][1] - mean)
            least = max(1.0, *(room(w, t * e) for t, w in zip(lean, want) for e in ends))
            spread[z] = (mean, want, [t / least for t in lean])
        mean, want, lean = spread[z]
        want = [min(1.0, max(0.0, w + t * (y - mean))) for w, t in zip(want, lean)]
        whole = [int(w * m) for w in want]
        for s in range(splits):
            put(i, s, whole[s])
        for s in range(splits):
            pending[s] += z * (want[s] * m - whole[s])
        if rest := m - sum(whole):
            left.append((i, rest))
            waiting += rest
        if waiting >= _AT_ONCE:
            settle()
            waiting = 0
    if left:
        settle()
    return got


def related_splits(
    df: DataFrame,
    keys: dict[str, Column],
    label: Column,
    shares: dict[str, float] | None = None,
    seed: int = 0,
    max_bundles: int = 20_000,
) -> DataFrame:
    """Assign records to splits so that records tied by any key share a split.

    Records are the distinct combinations of the key values (at least one not
    null). Two are tied if they share a non-null value of the same key, also
    through further records. Groups are bundled by (records, positive records);
    only the bundle table reaches the driver, where the quotas are solved
    (`quotas`). Members get their split by hash rank within the bundle, ranks
    being taken in hash ranges, so no bundle or group is ever gathered in a task.

    A size of s records has at most s + 1 bundles and sizes add up to the number
    of records n, so there are of the order of n ** (2 / 3) bundles at most; none
    are merged. Beyond `max_bundles` their quotas are joined by shuffle, not sent.

    Output: the key columns, group_id (smallest non-null value of the first key
    in the group, else of the next), group_records, split.
    Null keys tie nothing; records with all keys null are left out; a record
    with several labels is positive if any is; repeated rows count once; an empty
    table gives no rows; other columns are ignored.
    """
    shares = shares or {"train": 0.7, "validation": 0.1, "test": 0.2}
    spark = df.sparkSession
    names = list(keys)
    rows = df.select(*[c.cast("string").alias(k) for k, c in keys.items()], (F.coalesce(label.cast("int"), F.lit(0)) > 0).cast("int").alias("__y"))
    records = rows.where(F.coalesce(*[F.col(k) for k in names]).isNotNull()).groupBy(*names).agg(F.max("__y").alias("__y"))
    # Nodes are key values; a record's home is its first non-null value.
    node = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{names.index(k)}|"), F.col(k)))
    records = checkpointed(records.withColumn("__home", F.coalesce(*[node(k) for k in names])))
    # A value of a later key ties records only if it occurs with two homes.
    edges = None
    for k in names[1:]:
        e = records.where(F.col(k).isNotNull()).select(F.col("__home").alias("u"), node(k).alias("v"))
        shared = e.groupBy("v").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo != hi").select("v")
        e = e.where("u != v").join(shared, "v", "left_semi").select("u", "v")
        edges = e if edges is None else edges.unionByName(e)
    records = records.withColumn("node", F.col("__home"))
    if edges is not None:
        records = records.join(components(edges), "node", "left").withColumn("node", F.coalesce("component", "node")).drop("component")
    records = checkpointed(records)
    groups = records.groupBy("node").agg(F.coalesce(*[F.min(k) for k in names]).alias("group_id"), F.count("*").alias("group_records"), F.sum("__y").alias("positive"))
    groups = checkpointed(groups.withColumn("size_class", F.col("group_records")).withColumn("label_class", F.col("positive")))
    bundles = groups.groupBy("size_class", "label_class").agg(F.count("*").alias("m"))
    table = sorted((r.size_class, r.label_class, r.m) for r in bundles.collect())
    parts = [Fraction(x).limit_denominator(10**6) for x in shares.values()]
    given = quotas(table, [p / sum(parts) for p in parts])
    upto = [(a, b, [sum(q[: s + 1]) for s in range(len(q))]) for (a, b, _), q in zip(table, given)]
    ends = spark.createDataFrame(upto, "size_class bigint, label_class bigint, upto array<bigint>")
    h = F.xxhash64(F.lit(seed), F.col("node"))
    n_buckets = max(1, -(-sum(m for *_, m in table) // ROWS_PER_BUCKET))
    ranked = running_total(groups.withColumn("h", h).withColumn("b", hash_bucket(F.col("h"), n_buckets)), ["size_class", "label_class"], "b", ["h", "node"], F.lit(1), "rank")
    split = F.element_at(F.array(*[F.lit(s) for s in shares]), (F.size(F.filter("upto", lambda x: x <= F.col("rank"))) + 1).cast("int"))
    placed = ranked.join(F.broadcast(ends) if len(upto) <= max_bundles else ends.hint("shuffle_hash"), ["size_class", "label_class"]).select("node", "group_id", "group_records", split.alias("split"))
    return records.join(placed, "node").select(*names, "group_id", "group_records", "split", F.col("__y").alias("positive"))


def split_sizes(assigned: DataFrame) -> DataFrame:
    """Sizes reached: split, n_groups, n_records, n_positive, record_share."""
    per = assigned.groupBy("split").agg(F.countDistinct("group_id").alias("n_groups"), F.count("*").alias("n_records"), F.sum("positive").alias("n_positive"))
    total = assigned.agg(F.count("*").alias("n"))
    return per.join(F.broadcast(total)).select("split", "n_groups", "n_records", "n_positive", (F.col("n_records") / F.col("n")).alias("record_share"))
