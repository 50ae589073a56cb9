"""Structured Streaming forms of the engine's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crucible.functions.molecules import descriptors


def descriptor_stream(spark: SparkSession, path: str, out: str, checkpoint: str, names: list[str], schema: str = "mol_id long, smiles string", files_a_trigger: int = 8) -> StreamingQuery:
    """Descriptors of the molecules in arriving Parquet files, appended as CSV; stop with query.stop()."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    d = src.select("mol_id", descriptors("smiles", names).alias("d")).select("mol_id", *[F.col(f"d.{n}") for n in names])
    return d.writeStream.format("csv").option("header", True).option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by event-time window and key; works on streams and tables."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
