"""Stream-static resolution: events that name entities, resolved against the static graph as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oriel.operators.lookup import active
from oriel.operators.resolve import bulk
from oriel.sources.graph import EntityGraph


def resolve_codes(g: EntityGraph, events: DataFrame, code: str, system: str, as_of: str | None = None) -> DataFrame:
    """Events joined with the entity of a code; with ``as_of`` (a date column) only while that entity is valid."""
    codes = g.codes.where(F.col("system") == system).select("entity_id", F.col("value_norm").alias("_v"))
    out = events.join(codes, F.lower(F.trim(F.col(code))) == F.col("_v"), "left").drop("_v")
    if as_of is None:
        return out
    dates = g.entities.select("entity_id", "valid_from", "valid_until")
    return out.join(dates, "entity_id", "left").where(active(F.col(as_of)) | F.col("entity_id").isNull()).drop("valid_from", "valid_until")


def windowed_counts(resolved: DataFrame, time: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per entity and window, closed by a watermark."""
    return resolved.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "entity_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "entity_id", "n")


def resolve_batches(g: EntityGraph, events: DataFrame, column: str, path: str, checkpoint: str, **options) -> StreamingQuery:
    """The whole cascade on each micro-batch, distinct texts once; one folder per batch, so a retry replaces it."""

    def batch(df: DataFrame, number: int) -> None:
        bulk(g, df, column, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
