"""An inbox as a stream: an extension, with the same results as batches of the same files.

Texts arrive as files; a name is planned once, and each batch's records are merged by the same operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.config import DEFAULT, RoutingConfig
from quillspark.functions.text import base_name
from quillspark.plans.plan import plan


def inbox(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, name, text, arrived) of text files as they arrive."""
    read = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).load(path)
    named = read.select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.current_timestamp().alias("arrived"))
    return named.withColumn("name", base_name(F.col("path")))


def planned(stream: DataFrame, config: RoutingConfig = DEFAULT, delay: str = "1 day") -> DataFrame:
    """Plans of new names; a name that comes again within ``delay`` is passed over, and its state is dropped after."""
    once = stream.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["name"])
    return plan(once, config)


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every batch to ``write``; batches have numbers, so a writer can tell a repeated one."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
