"""Import of fragments as a stream: files that arrive are parsed, joined to cells and counted or appended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.fragments import with_cells
from ..sources.text import parse_fragments


def import_stream(spark: SparkSession, folder: str, cells: DataFrame, out: str, checkpoint: str):
    """Append the fragments of text files in ``folder`` (also those that come later) to ``out``; returns the query."""
    lines = spark.readStream.text(folder)

    def append(batch: DataFrame, number: int) -> None:
        with_cells(parse_fragments(batch), cells).write.mode("append").partitionBy("chrom").parquet(out)

    return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tile_windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by window of event time and kind, of a stream or a table; rows later than ``late`` go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))


def counts_of(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """(cell_idx, n_fragments) by a stateful count over a stream of the files at ``path``, run until they are read."""
    name = f"counts_{uuid.uuid4().hex}"
    folder, _, file = path.rpartition("/")
    # a pattern is taken for files and folders alike, a plain path for folders only
    events = spark.readStream.schema(schema).parquet(f"{folder}/[{file[0]}]{file[1:]}")
    counts = events.groupBy(F.col("user_id").alias("cell_idx")).agg(F.count("*").alias("n_fragments"))
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
