"""Visits from an event feed: sessions by inactivity, batch or stream, feeding the same batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, gap: str = "6 hours", watermark: str | None = None) -> DataFrame:
    """(user_id, start, end, n_events, tokens): events of a user less than `gap` apart form one session.

    end is the last event plus the gap. With a watermark it runs on a stream and
    late events beyond it are dropped. Events without user or time are left out;
    tokens are the distinct event types, sorted.
    """
    rows = events.where("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    g = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set("event_type")).alias("tokens"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "tokens")


def session_sequences(s: DataFrame) -> DataFrame:
    """(key, blocks): a user's sessions in order as item sets, input of the episode miner."""
    return s.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "tokens"))), lambda x: x["tokens"]).alias("blocks"))


def feed(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "6 hours", watermark: str = "1 day", **trigger) -> StreamingQuery:
    """Run `sessions` on a stream and hand each batch of closed sessions to `sink`."""
    out = sessions(events, gap, watermark)
    return out.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
