"""Normalisation of entity files as they arrive.

The workflow itself is batch; its first step is row by row and so also runs as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftlink.sources.tables import ENTITY, normalise_entities


def stream_entities(spark: SparkSession, folder: str, source: str, files_at_once: int = 16) -> DataFrame:
    """Normalised rows of the tab-separated files of a folder, with the standard header."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    rows = lines.where((F.col("value") != "") & ~F.col("value").startswith("\t".join(ENTITY)) & (F.size(fields) <= len(ENTITY)))
    return normalise_entities(rows.select(*(F.coalesce(F.get(fields, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(ENTITY))), source)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table what is there now, exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
