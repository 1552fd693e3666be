"""Tables in the shared scratch folder, to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset and all runs on one machine (tests), a
    temporary local one.  On a cluster each executor would write to its own disk there, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_LOCAL = threading.local()  # queries of several threads do not see each other's tables


def _written() -> list[str]:
    """Paths that this thread has written and that are still there, oldest first."""
    if not hasattr(_LOCAL, "paths"):
        _LOCAL.paths = []
    return _LOCAL.paths


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written().append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for ``drop_since``: how many scratch tables there are."""
    return len(_written())


def drop_since(spark: SparkSession, mark: int, keep: int = 1) -> None:
    """Delete the scratch tables written since a mark but for the last ``keep``, once nothing reads them any more."""
    drop_range(spark, mark, max(len(_written()) - keep, mark))


def drop_range(spark: SparkSession, first: int, last: int) -> None:
    """Delete the scratch tables written from one mark up to another, once nothing reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _written()
    for path in paths[first:last]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    del paths[first:last]


def ordinals(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, written, with a column ``name``: the number of each row from 0 in ``order``.

    Rows are dealt out in ranges of the order and numbered within them; only the sizes of the ranges, a few numbers,
    meet in one task.  Rows that tie are numbered in any order.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = ranged.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return joined.withColumn(name, (F.col("_before") + nth - 1).cast("long")).drop("_range", "_before")
