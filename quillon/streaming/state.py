"""Streaming forms: the latest claim of each slot, windowed counts with late data, changes of a slot's value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.store import Store


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and key; a window closes when the watermark passes it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("rows")).select(F.col("window.start").alias("start"), key, "rows")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("rows")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "rows")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def latest_claims(claims: DataFrame, slot: str, order: str, value: str) -> DataFrame:
    """The value in force for each slot (complete or update mode)."""
    return claims.groupBy(slot).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def written(stream: DataFrame, store: Store, name: str) -> DataFrame:
    """Run a stream of results over all that is there now; each batch replaces the table, so a batch that is run again does no harm."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(store.path(name))

    run = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", store.path(f"{name}-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return store.table(name) if store.exists(name) else stream.sparkSession.createDataFrame([], stream.schema)
