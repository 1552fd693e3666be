"""Sinks: manifest, log, history, examples, audit; a plan becomes files only here."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import history, vectors
from quillspark.scratch import materialize, ordinals
from quillspark.sources.readers import MANIFEST_SCHEMA, exists, read_log
from quillspark.sources.store import Files

CSV_COLUMNS = ("filename", "category", "issuer", "owner", "account", "date", "amount", "ocr_confidence", "routed_to", "timestamp")


def manifest(planned: DataFrame, status: str = "moved") -> DataFrame:
    """Manifest entries of a plan, all fields."""
    m = F.col("metadata")
    return planned.select(
        F.col("new_name").alias("filename"), "category", *[m[c].alias(c) for c in ("issuer", "owner", "account", "date", "amount")],
        F.col("confidence").alias("ocr_confidence"), F.col("route").alias("routed_to"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(status).alias("status"),
    )


def append_manifest(entries: DataFrame, csv_path: str, json_path: str, columns: tuple[str, ...] = CSV_COLUMNS) -> None:
    """Append to the CSV (one fixed set of columns, so headers and rows agree) and to the JSON lines (all fields)."""
    entries.select(*columns).write.mode("append").option("header", "true").csv(csv_path)
    entries.select(*[c.split()[0] for c in MANIFEST_SCHEMA.split(", ")]).write.mode("append").json(json_path)


def append_log(records: DataFrame, path: str) -> int:
    """Append records as JSON lines, to a folder, with ``seq`` that goes on from the last; returns how many.

    Records are ordered by seq, time and name, as far as they have them.  Numbers are reserved before anything is
    written, by a file in ``_seq`` that only one writer can make, so that writers at once get numbers of their own, and
    what is there is read only where nothing was reserved yet.  An append that is cut short leaves out its numbers."""
    order = [F.col(c) for c in ("seq", "ts", "original_filename") if c in records.columns]
    numbered = materialize(ordinals(records, order, "log_line"), "log-lines")
    n = numbered.count()
    if not n:
        return 0
    files = Files(records.sparkSession, path)
    while True:
        held = sorted(x for x in files.names("_seq") if not x.startswith("."))
        last = int(files.read(f"_seq/{held[-1]}")) if held else read_log(records.sparkSession, path).agg(F.max("seq")).first()[0]
        first = 0 if last is None else last + 1
        if files.publish(f"_seq/{first:020}", str(first + n - 1)):
            break
    numbered.withColumn("seq", F.col("log_line") + F.lit(first)).drop("log_line").write.mode("append").json(path)
    return n


def write_history(entries: DataFrame, path: str, *, title: str = "# Processed PDFs") -> None:
    """Add the entries of a run to one Markdown file: a title if it is new, a heading for a day that has none, and the
    run's section at the end of its day.

    A run is what one person has approved; its sections, one row per day and run, come to the driver.  The file may lie
    on any file system that Spark writes; the new text takes the place of the old at once.  One run at a time is assumed.
    """
    folder, _, name = path.rpartition("/")
    files = Files(entries.sparkSession, folder or ".")
    text = files.read(name) if files.fs.exists(files.path(name)) else f"{title}\n"
    for day, body in history.to_markdown(entries).select("day", "body").orderBy("day").collect():
        text = history.with_section(text, day, body)
    files.replace(name, text)


def merge_examples(rows: DataFrame, path: str) -> None:
    """Merge rows into stored examples: the new version is written beside the old, which is put aside, not deleted,
    until the new one has its place.  A merge that was cut short is made good by the next.

    One writer at a time is assumed."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-old")
    if not fs.exists(place) and fs.exists(aside):
        fs.rename(aside, place)
    merged = vectors.upsert(spark.read.parquet(path), rows) if exists(spark, path) else vectors.upsert(rows.limit(0), rows)
    new = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-{uuid.uuid4().hex}")
    merged.write.parquet(new.toString())
    fs.delete(aside, True)
    if fs.exists(place):
        fs.rename(place, aside)
    fs.rename(new, place)
    fs.delete(aside, True)


def write_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("overwrite").json(path)


def export_log(log: DataFrame, path: str, *, array: bool = False) -> None:
    """The whole log as JSON lines, in order; with ``array`` the parts, one after the other, are one JSON array."""
    if not array:
        log.orderBy("seq").write.mode("overwrite").json(path)
        return
    record = F.to_json(F.struct(*log.columns))
    ends = log.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    if ends.low is None:
        log.sparkSession.range(1).select(F.lit("[]").alias("value")).write.mode("overwrite").text(path)
        return
    first = F.when(F.col("seq") == ends.low, F.lit("[")).otherwise(F.lit(" "))
    last = F.when(F.col("seq") == ends.high, F.lit("]")).otherwise(F.lit(","))
    log.orderBy("seq").select(F.concat(first, record, last).alias("value")).write.mode("overwrite").text(path)


def apply_plan(rows: list[tuple[str, str]], *, archive: str | None = None, rename: bool = False) -> list[tuple[str, str | None, str | None]]:
    """Move or copy files of an approved batch on the driver: (source, target) to (source, where it is now or None,
    error or None).

    A batch is what one person has just approved; a file's failure does not stop the others.  Targets are settled once
    more against what is on disk by now and against each other: a name that is taken gets the next free number."""
    out: list[tuple[str, str | None, str | None]] = []
    taken: set[str] = set()
    for source, target in rows:
        try:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            here = os.path.exists(source) and os.path.exists(target) and os.path.samefile(source, target)
            target = target if here else _free(target, taken)
            if rename:
                os.rename(source, target)
            else:
                shutil.copy2(source, target)
                if archive:
                    os.makedirs(archive, exist_ok=True)
                    shutil.copy2(source, _free(os.path.join(archive, os.path.basename(source)), set()))
                os.unlink(source)
            taken.add(target)
            out.append((source, target, None))
        except OSError as problem:
            out.append((source, None, str(problem)))
    return out


def _free(target: str, taken: set[str]) -> str:
    head, tail = os.path.splitext(target)
    n, candidate = 2, target
    while candidate in taken or os.path.exists(candidate):
        candidate, n = f"{head} - {n}{tail}", n + 1
    return candidate


def spark_session(name: str = "quillspark") -> SparkSession:
    """A session with adaptive execution, and UTC so that dates do not depend on the machine."""
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()
