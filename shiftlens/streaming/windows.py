"""Event-time aggregates of request and job-event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Job events that land as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def requests_per_minute(requests: DataFrame, limit: int = 10, late: str = "2 minutes") -> DataFrame:
    """Requests per address and minute; rows older than the watermark are dropped."""
    counted = requests.withWatermark("at", late).groupBy("address", F.window("at", "1 minute")).agg(F.count("*").alias("n"))
    return counted.select("address", F.col("window.start").alias("minute"), "n", (F.col("n") > limit).alias("over"))


def snapshots(stream: DataFrame, folder: str, every: str = "4 seconds") -> StreamingQuery:
    """Append a stream's rows to Parquet at a fixed pace, as a polling reader would see them."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows")
    return writer.trigger(processingTime=every).start()
