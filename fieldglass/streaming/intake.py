"""Load only what is new: files already taken in are skipped.

The batch answer to "has the source changed?" is a fingerprint over its files.
For a folder that keeps growing, the file stream's own log does the same per
file: each call takes in the files that have appeared since the last one, and
an unchanged folder costs a listing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from fieldglass.operators.schema import adapt_names, prepare


def take_in(spark: SparkSession, source: str, schema: T.StructType, target: str, progress: str,
            fmt: str = "parquet", high_rain: float | None = None) -> int:
    """Prepare all new files of ``source`` and append them to the Parquet table ``target``; returns the rows added.

    ``progress`` is the stream's checkpoint folder and belongs to one target.
    The table must name its timestamp column. ``high_rain`` is required when
    indices are estimated from climate, because a batch cannot know the
    quantile of rain to come.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    prepared = prepare(adapt_names(reader.load(source)), high_rain=high_rain)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 1_000_000)  # all batches are counted, not the last hundred
    query = (
        prepared.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
