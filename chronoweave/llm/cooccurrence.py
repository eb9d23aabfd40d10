"""Items that appear together, with large baskets cut into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.common import checkpointed


def cooccurrence(baskets: DataFrame, basket: Column, item: Column, n_baskets: int | None = None, min_count: int = 5, min_share: float | None = None, min_lift: float = 0.0, block: int = 256) -> DataFrame:
    """Count the baskets in which two items occur together, and how much more often than chance.

    Kept are pairs with n_ab >= max(min_count, ceil(N * min_share)) and
    n_ab * N >= min_lift * n_a * n_b, item_a < item_b. Items that no such pair can
    contain are dropped first: n_ab <= min(n_a, n_b), so n_a must reach the count,
    and n_a * min_lift must not exceed N. This loses nothing.

    A basket of more than `block` items is cut into item chunks; each pair of
    chunks is a cell of its own and goes to its own task, ordinary baskets are a
    single cell. A cell has at most 2 * block items, so no basket makes a large
    task. Pairs are combined before they are shuffled.

    Output: item_a, item_b, n_ab, n_a, n_b, n_baskets, lift, pmi, npmi.
    Null baskets and items are ignored; repeated items count once per basket;
    n_baskets is the number of baskets with an item unless given; no baskets: no
    rows; other columns are ignored.
    """
    edges = checkpointed(baskets.select(basket.alias("basket"), item.cast("string").alias("item")).where("basket is not null and item is not null").distinct())
    n = n_baskets if n_baskets is not None else edges.select("basket").distinct().count()
    least = max(1, min_count, -(-n // round(1 / min_share)) if min_share else 0)
    kept = edges.groupBy("item").agg(F.count("*").alias("n_item")).where((F.col("n_item") >= least) & (F.col("n_item") * min_lift <= n))
    # Numbers stand for the items while pairs are counted; fixed by the checkpoint.
    kept = checkpointed(checkpointed(kept).withColumn("id", F.monotonically_increasing_id()))
    rows = edges.join(kept.select("item", "id"), "item").select("basket", "id")
    huge = rows.groupBy("basket").agg(F.count("*").alias("size")).where(F.col("size") > block).select("basket", F.ceil(F.col("size") / block).cast("int").alias("chunks"))
    rows = rows.join(huge, "basket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    cells = rows.select("basket", "id", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    # A cell is a pair of chunks in one number, and `of` tells which of the two the item is from.
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    cells = cells.select("basket", (F.shiftleft(low.cast("bigint"), 31) + high).alias("cell"), F.when(low == high, -1).otherwise((F.col("chunk") == high).cast("int")).cast("byte").alias("of"), "id")
    a, b = cells.alias("a"), cells.alias("b")
    # In a mixed cell only pairs across its two chunks; those within a chunk have their own cell.
    same = (F.col("a.basket") == F.col("b.basket")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.id") < F.col("b.id")) & ((F.col("a.of") < 0) | (F.col("a.of") != F.col("b.of")))
    pairs = a.join(b, same).groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= least)
    x = kept.select(F.col("id").alias("a"), F.struct(F.col("item").alias("item"), F.col("n_item").alias("n")).alias("x"))
    y = kept.select(F.col("id").alias("b"), F.struct(F.col("item").alias("item"), F.col("n_item").alias("n")).alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumn("lo", F.least("x", "y")).withColumn("hi", F.greatest("x", "y"))
    out = both.select(F.col("lo")["item"].alias("item_a"), F.col("hi")["item"].alias("item_b"), "n_ab", F.col("lo")["n"].alias("n_a"), F.col("hi")["n"].alias("n_b"))
    total = F.lit(n).cast("bigint")
    out = out.where(F.col("n_ab").cast("double") * total >= min_lift * F.col("n_a").cast("double") * F.col("n_b"))
    lift = F.col("n_ab").cast("double") * total / (F.col("n_a").cast("double") * F.col("n_b"))
    p = F.col("n_ab") / total
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", total.alias("n_baskets"), lift.alias("lift"), F.log(lift).alias("pmi"), F.when(p < 1, F.log(lift) / -F.log(p)).otherwise(1.0).alias("npmi"))


def visit_blocks(df: DataFrame, entity: Column, visit: Column, tokens: str, event: str = r"^[CPD]:") -> DataFrame:
    """Blocks of a token sequence: rows (basket, item), item null for a block without events.

    `[VISIT]` opens a block; events before the first one form a block of their
    own if there are any. Repeated rows give the same baskets.
    """
    flat = F.array_join(F.filter(F.col(tokens), lambda x: x.isNotNull()), "\x01")
    pieces = F.split(flat, "(?:^|\x01)\\[VISIT\\](?=\x01|$)")
    rows = df.where(F.col(tokens).isNotNull()).select(F.coalesce(entity, F.lit("\0")).alias("e"), F.coalesce(visit, F.lit("\0")).alias("v"), F.posexplode(pieces).alias("at", "piece"))
    items = F.filter(F.split("piece", "\x01"), lambda x: x.rlike(event))
    rows = rows.withColumn("items", items).where("at > 0 or size(items) > 0")
    return rows.select(F.concat_ws("\x01", "e", "v", F.col("at").cast("string")).alias("basket"), F.explode_outer("items").alias("item"))
