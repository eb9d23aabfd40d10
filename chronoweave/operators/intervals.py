"""Sweep line over intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.common import checkpointed


def periods_and_gaps(df: DataFrame, entity: Column, start: Column, end: Column, member: Column, bucket_rows: int = 50_000) -> DataFrame:
    """Merge closed intervals per entity and list the gaps.

    Every boundary becomes a plus or minus event; events are netted per
    (entity, instant); a prefix sum of the active count gives, at each instant,
    whether a period starts (nothing was active before). The instant just before
    a period's start is the end of the period before it, which gives the gap
    without another pass. Without hot entities the intervals are shuffled once.

    An entity with more than `bucket_rows` boundaries is swept in time slices of
    about equal numbers of instants (ranges of the data, so far-off dates do not
    leave the rest in one slice): only slice totals are carried from slice to
    slice, so no entity is ever gathered into one task.

    Output: entity, start_s, end_s (epoch seconds of the period), n_intervals,
    members (1, or 2 for "at least two distinct non-null members"),
    gap_from_s (end of the period before, null for the first).

    Nulls in entity, start or end and intervals that end before they start are
    left out; a null member counts for the period but is no member; touching
    intervals are continuous; length zero is allowed; repeated rows change
    nothing but n_intervals; an empty table gives no rows; other columns are
    ignored whatever their names.
    """
    x = df.select(entity.alias("e"), F.unix_seconds(start).alias("s"), F.unix_seconds(end).alias("t"), member.cast("string").alias("m")).where("e is not null and s is not null and t >= s")
    # Counting is cheap: counts combine before the shuffle.
    hot = checkpointed(x.groupBy("e").agg(F.count("*").alias("n")).where(2 * F.col("n") > bucket_rows))
    n_hot, hot_rows = hot.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    keys = ["e", "k"] if n_hot else ["e"]

    def boundaries(rows: DataFrame) -> DataFrame:
        both = F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("open"), F.lit(0).alias("close"), "m"), F.struct(F.col("t").alias("at"), F.lit(0).alias("open"), F.lit(1).alias("close"), F.lit(None).cast("string").alias("m")))
        return rows.select("e", F.explode(both).alias("v")).select("e", "v.*")

    def netted(rows: DataFrame) -> DataFrame:
        return boundaries(rows).groupBy("e", "at").agg(F.sum("open").alias("open"), F.sum("close").alias("close"), F.min("m").alias("lo"), F.max("m").alias("hi"))

    if n_hot:
        # At most 2 * rows / bucket_rows entities can be hot; sent along only if they are few. Their instants are netted before the shuffle and cut into ranges.
        few = F.broadcast(hot.select("e")) if n_hot <= 100_000 else hot.select("e")
        ranges = netted(x.join(few, "e", "left_semi")).repartitionByRange(max(2, -(-8 * hot_rows // bucket_rows)), "e", "at")
        sliced = checkpointed(ranges.withColumn("k", F.spark_partition_id().cast("long")))
        net = netted(x.join(few, "e", "left_anti").repartition("e")).withColumn("k", F.lit(0).cast("long")).unionByName(sliced)
    else:
        net = netted(x.repartition("e"))  # the one shuffle: all that follows is by entity

    inside = W.partitionBy(*keys).orderBy("at")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    delta = F.col("open") - F.col("close")
    swept = net.withColumn("active", F.coalesce(F.sum(delta).over(before), F.lit(0))).withColumn("prev", F.lag("at").over(inside))
    if n_hot:
        carry = W.partitionBy("e").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
        totals = net.groupBy(*keys).agg(F.sum(delta).alias("d"), F.max("at").alias("last")).join(hot.select("e"), "e", "left_semi")
        totals = totals.select(*keys, F.coalesce(F.sum("d").over(carry), F.lit(0)).alias("active0"), F.max("last").over(carry).alias("at0"))
        swept = swept.join(totals, keys, "left").withColumn("active", F.col("active") + F.coalesce("active0", F.lit(0))).withColumn("prev", F.coalesce("prev", "at0"))
    swept = swept.withColumn("begin", F.when(F.col("active") == 0, F.col("at")))
    period = F.max("begin").over(inside.rowsBetween(W.unboundedPreceding, 0))
    if not n_hot:
        swept = swept.withColumn("p", period)
    else:
        # The period of an event: the last start at or before it, in its slice or carried into it.
        begun = swept.groupBy(*keys).agg(F.max("begin").alias("begin")).join(hot.select("e"), "e", "left_semi").select(*keys, F.max("begin").over(carry).alias("begin0"))
        swept = swept.withColumn("p", period).join(begun, keys, "left").withColumn("p", F.coalesce("p", "begin0"))
    return (
        swept.groupBy("e", "p")
        .agg(F.max("at").alias("end_s"), F.sum("open").alias("n_intervals"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.when(F.col("begin").isNotNull(), F.col("prev"))).alias("gap_from_s"))
        .select(F.col("e").alias("entity"), F.col("p").alias("start_s"), "end_s", "n_intervals", (F.when(F.col("lo").isNull(), 0).when(F.col("lo") == F.col("hi"), 1).otherwise(2)).alias("members"), "gap_from_s")
    )


def merged_and_gaps(df: DataFrame, entity: Column, start: Column, end: Column, member: Column, bucket_rows: int = 50_000) -> DataFrame:
    """Rows (subject_id, kind, start_s, end_s): periods of at least two members, and all gaps."""
    p = periods_and_gaps(df, entity, start, end, member, bucket_rows)
    rows = F.array(
        F.when(F.col("members") >= 2, F.struct(F.lit("merged").alias("kind"), "start_s", "end_s")),
        F.when(F.col("gap_from_s").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("gap_from_s").alias("start_s"), F.col("start_s").alias("end_s"))),
    )
    return p.select(F.col("entity").alias("subject_id"), F.explode(rows).alias("r")).where("r is not null").select("subject_id", "r.kind", "r.start_s", "r.end_s")
