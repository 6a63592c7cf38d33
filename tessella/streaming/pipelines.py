"""Structured Streaming counterparts of the incremental jobs: new files are picked up once, late rows are bounded, results are upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def files(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def counts(events: DataFrame, ts: str, by: str, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and key; rows later than `late` are dropped."""
    at = F.col(ts).cast("timestamp")
    w = F.window("__ts", window, slide) if slide else F.window("__ts", window)
    return events.withColumn("__ts", at).withWatermark("__ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).groupBy(F.session_window("__ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def first_of(events: DataFrame, ts: str, key: str, late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark([key]).drop("__ts")


def upsert(stream: DataFrame, target: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Every batch is a generation of the target with its rows in place of the old ones of their key; a repeated batch gives the same."""
    from tessella.sources.readers import exists
    from tessella.sources.writers import current, publish, upserted

    def batch(df: DataFrame, number: int) -> None:
        new = df.dropDuplicates(key)
        spark = df.sparkSession
        publish(upserted(current(spark, target), new, key) if exists(spark, f"{target}/current.json") else new, target, f"batch-{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
