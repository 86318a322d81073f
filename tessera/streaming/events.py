"""Structured Streaming counterparts of the batch patterns. Each takes a streaming (or static) frame and returns one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per key and tumbling window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, ts: str, key: str, width: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, step), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("end"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "2 hours", late: str = "2 days") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def once(events: DataFrame, ts: str, key: str, late: str = "2 days") -> DataFrame:
    """Rows with a key seen before within the watermark are dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def cooled_down(alerts: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Alerts of a key at least so long after the last one let through; the key's last time is the state."""
    import pandas as pd

    kind = alerts.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator, state) -> Iterator:
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(t for pdf in batches for t in pdf[ts]):
            now = int(t.timestamp() * 1_000_000)
            if last is None or now - last >= seconds * 1_000_000:
                kept.append((k[0], t))
                last = now
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=[key, ts])

    return alerts.select(key, F.col(ts).cast("timestamp").alias(ts)).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp", "last long", "append", "NoTimeout")


def upsert_days(stream: DataFrame, path: str, day: str, checkpoint: str):
    """Each micro-batch replaces the days it holds, so a batch that is run again changes nothing."""
    from tessera.sources.files import overwrite_days

    return stream.writeStream.foreachBatch(lambda df, _: overwrite_days(df, path, day)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
