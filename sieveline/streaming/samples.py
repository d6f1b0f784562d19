"""Sample records as a stream of files, in place of polling for finished jobs. An extension of the batch path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_samples(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_of_each(samples: DataFrame, at: str = "recorded_at", lateness: str = "30 days") -> DataFrame:
    """Each (image, option) once; repeats are told for as long as the watermark allows, so state stays bounded."""
    rows = samples.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return rows.dropDuplicatesWithinWatermark(["image", "option"])


def progress(samples: DataFrame, at: str = "recorded_at", window: str = "1 day", lateness: str = "30 days") -> DataFrame:
    """Finished and failed records per window of time and option."""
    rows = samples.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return rows.groupBy(F.window(at, window), "option").agg(F.count(F.lit(1)).alias("completed"), F.count("failure").alias("rejected"))


def run_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all records that have arrived to a Parquet table, exactly once, then stop."""
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
