"""Readers: file listings, texts, logs, histories, manifests, examples."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import base_name, control_free
from quillspark.operators.feedback import LOG_SCHEMA

MANIFEST_SCHEMA = (
    "filename string, category string, issuer string, owner string, account string, date string, amount string, "
    "ocr_confidence double, routed_to string, timestamp string, status string"
)


def list_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, parent, name, length) of files at any depth; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("parent"), base_name(F.col("path")).alias("name"), "length")


def read_texts(spark: SparkSession, path: str, extract: Callable[[bytes], str], glob: str = "*.pdf") -> DataFrame:
    """(path, name, text, extract_error) by an extractor that runs on the executors, file by file within a batch.

    What an extractor raises becomes ``extract_error`` with a null text, so that errors are no documents.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)

    def run(batches):
        for b in batches:
            texts, errors = [], []
            for content in b["content"]:
                try:
                    texts.append(extract(bytes(content)))
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001  any failure of a file is that file's
                    texts.append(None)
                    errors.append(str(problem) or type(problem).__name__)
            yield pd.DataFrame({"path": b["path"], "text": texts, "extract_error": errors})

    read = found.select("path", "content").mapInPandas(run, "path string, text string, extract_error string")
    return read.select("path", base_name(F.col("path")).alias("name"), control_free(F.col("text")).alias("text"), "extract_error")


def lines_in_order(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, line_no, line) of text files, lines numbered from 0; files are read in parts, never as one value.

    Rows of a part keep their order and parts are ordered by where they start, so that numbers are counted by part.
    """
    read = spark.read.option("pathGlobFilter", glob).text(path)
    read = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    sizes = read.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("file", "part").orderBy("at"))
    numbered = read.withColumn("nth", nth).join(sizes, ["file", "part"])
    return numbered.select("file", (F.col("before") + F.col("nth") - 1).cast("long").alias("line_no"), "line")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log records, JSON lines, with ``seq``: what a record says itself, as those written by ``sinks.append_log`` do,
    else the number of its line, files one after the other by name.  Blank and malformed lines are passed over, a
    missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"seq long, {LOG_SCHEMA}")
    lines = lines_in_order(spark, path).where(F.trim("line") != "")
    parsed = lines.select("file", "line_no", F.from_json("line", f"seq long, {LOG_SCHEMA}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r"))
    fine = parsed.where("r._corrupt_record is null and r is not null")
    own = fine.where("r.seq is null").groupBy("file").agg((F.max("line_no") + 1).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    own = own.select(F.col("file").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    joined = fine.join(own, F.col("file") == F.col("of"), "left")
    seq = F.coalesce("r.seq", F.col("before") + F.col("line_no")).cast("long")
    return joined.select(seq.alias("seq"), F.col("r").dropFields("seq", "_corrupt_record").alias("r")).select("seq", "r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entries; a malformed line is an error."""
    return spark.read.schema(MANIFEST_SCHEMA).option("mode", "FAILFAST").json(path)


def read_history(spark: SparkSession, path: str, glob: str = "*PROCESSED_PDFS*.md") -> DataFrame:
    """(file, line_no, line) of one history file, or of those of a folder whose names fit."""
    return lines_in_order(spark, path, "*" if path.endswith(".md") else glob)


def read_examples(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Stored examples whose vector has the dimension it says; the category filter reaches the scan."""
    stored = spark.read.parquet(path)
    kept = stored if category is None else stored.where(F.col("category") == category)
    return kept.where(F.size("embedding") == F.col("dim"))


#: Names of text files, by their ends, and a script that the marker scan passes over.
TRACKED_SUFFIXES = (".py", ".md", ".yaml", ".yml", ".toml", ".txt", ".gitignore")


def read_tracked(spark: SparkSession, path: str, suffixes: tuple[str, ...] = TRACKED_SUFFIXES, tracked: DataFrame | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) of text files by suffix, each read whole, for the marker scan.

    Only files of these suffixes are opened.  With ``tracked`` (a column ``path``, relative to the folder) only those
    in it; files whose path ends with one of ``skip`` are passed over.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    named = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    for s in skip:
        named = named.where(~F.endswith("path", F.lit(s)))
    if tracked is None:
        return named
    root = path.rstrip("/") + "/"
    below = F.substring_index("path", root, -1)
    return named.join(tracked.select(F.col("path").alias("_tracked")).distinct(), below == F.col("_tracked"), "left_semi")


def review(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """The first ``n`` entries of a manifest, in the order in which they were written."""
    lines = lines_in_order(spark, path).where(F.trim("line") != "").orderBy("file", "line_no").limit(n)
    return lines.select("file", "line_no", F.from_json("line", MANIFEST_SCHEMA, {"mode": "FAILFAST"}).alias("r")).orderBy("file", "line_no").select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
