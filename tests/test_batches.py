"""Rows on their way to Python are held outside the heap, several copies at once: batches of wide rows stay small."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.shipping import ship


def test_batches_of_wide_rows_are_bounded_by_bytes(spark):
    ship(spark)
    wide = spark.range(0, 600, 1, 1).select("id", F.array_repeat(F.col("id").cast("float"), 18_000).alias("v"))  # 72 KB, as a block of examples

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "rows"])

    found = wide.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in found) == 600
    assert max(r["bytes"] for r in found) < 10_000_000
