"""A store of examples in buckets, with a version for every merge.

``data/<merge>/bucket=<n>`` holds rows whose key hashes to n, as one merge wrote them; ``versions/<number>.json`` names the
folder of every bucket.  A merge reads and writes the buckets alone that its rows fall into, then publishes the next
version.  A version is published once: by a link or a rename that fails where there is one.  A writer that comes too late
merges again, into what the other has published.  Readers keep to the version that they have opened, whatever is merged
meanwhile.  A merge that is cut short leaves folders that no version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import vectors

BUCKETS = 64
TRIES = 20


class Files:
    """The few file operations needed, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """A file with all of the text, in the place of one of that name: readers see the old text or the new."""
        beside = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}" if "/" in name else f".{uuid.uuid4().hex}"
        self.fs.mkdirs(self.path(name).getParent())
        stream = self.fs.create(self.path(beside), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        how = SparkSession.active().sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        whole = self.fs.makeQualified
        hadoop.FileContext.getFileContext(whole(self.path("")).toUri(), self.fs.getConf()).rename(whole(self.path(beside)), whole(self.path(name)), how)

    def publish(self, name: str, text: str) -> bool:
        """A new file with all of the text, or nothing and false where there is one of that name."""
        beside = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        self.fs.mkdirs(self.path(name).getParent())
        stream = self.fs.create(self.path(beside), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # a rename would replace there
                java = self.jvm.java.nio.file
                at = lambda n: java.Path.of(self.fs.makeQualified(self.path(n)).toUri())
                try:
                    java.Files.createLink(at(name), at(beside))
                except Exception as problem:  # noqa: BLE001
                    if "FileAlreadyExistsException" not in str(problem):
                        raise
                    return False
                return True
            return not self.fs.exists(self.path(name)) and self.fs.rename(self.path(beside), self.path(name))
        finally:
            self.fs.delete(self.path(beside), False)


def latest_version(spark: SparkSession, root: str) -> int:
    """The number of the latest version; 0 before the first."""
    return max((int(n[: -len(".json")]) for n in Files(spark, root).names("versions") if n.endswith(".json") and not n.startswith(".")), default=0)


def _version(files: Files, number: int) -> dict:
    return json.loads(files.read(f"versions/{number:012}.json")) if number else {"n_buckets": BUCKETS, "buckets": {}}


def _bucket(n: int, key: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _read(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root.rstrip('/')}/{f}" for f in folders])


def read_store(spark: SparkSession, root: str, version: int | None = None, category: str | None = None) -> DataFrame:
    """The rows of a version, the latest if none is named; a category's alone if given."""
    number = latest_version(spark, root) if version is None else version
    if not number:
        raise FileNotFoundError(f"no store in {root}")
    kept = _read(spark, root, sorted(_version(Files(spark, root), number)["buckets"].values()))
    return kept if category is None else kept.where(F.col("category") == category)


def merged_batch(spark: SparkSession, root: str, stream: str) -> int:
    """The number of the last batch of a stream that the store has; -1 before the first."""
    return _version(Files(spark, root), latest_version(spark, root)).get("batches", {}).get(stream, -1)


def merge_store(rows: DataFrame, root: str, *, key: tuple[str, ...] = vectors.KEY, n_buckets: int = BUCKETS, batch: tuple[str, int] | None = None, before_publishing=None) -> int:
    """Add rows, or put them in the place of those with the same key; gives the number of the version that has them.

    ``n_buckets`` counts for the first merge.  ``batch``, a stream and the number of its batch, is published with the
    rows; a batch that is there already is not merged again.  ``before_publishing`` is called with the number that is tried (tests)."""
    spark = rows.sparkSession
    files = Files(spark, root)
    for _ in range(TRIES):
        number = latest_version(spark, root)
        held = _version(files, number)
        if batch and held.get("batches", {}).get(batch[0], -1) >= batch[1]:
            return number
        bucketed = rows.withColumn("_bucket", _bucket(held["n_buckets"] if number else n_buckets, key))
        touched = [str(r["_bucket"]) for r in bucketed.select("_bucket").distinct().collect()]  # as many as buckets at most
        if not touched:
            return number
        old = [held["buckets"][b] for b in touched if b in held["buckets"]]
        merged = vectors.upsert(_read(spark, root, old) if old else rows.limit(0), rows, key)
        folder = f"data/{uuid.uuid4().hex}"
        n = held["n_buckets"] if number else n_buckets
        # a bucket is a file: it is written by one task, and no larger than its share of the store
        merged.withColumn("bucket", _bucket(n, key)).repartition("bucket").write.partitionBy("bucket").parquet(f"{files.root}/{folder}")
        buckets = held["buckets"] | {b: f"{folder}/bucket={b}" for b in touched}
        if before_publishing:
            before_publishing(number + 1)
        if files.publish(f"versions/{number + 1:012}.json", json.dumps({"n_buckets": n, "buckets": buckets, "batches": held.get("batches", {}) | dict([batch] if batch else [])})):
            return number + 1
        files.fs.delete(files.path(folder), True)
    raise RuntimeError(f"others have published {TRIES} versions meanwhile")


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Forget all versions but the last ``keep``, and delete what none of these names; for times without writers."""
    files = Files(spark, root)
    numbers = sorted(int(n[: -len(".json")]) for n in files.names("versions") if n.endswith(".json") and not n.startswith("."))
    kept = numbers[-keep:]
    used = {f.split("/")[1] for n in kept for f in _version(files, n)["buckets"].values()}
    for n in numbers[:-keep]:
        files.fs.delete(files.path(f"versions/{n:012}.json"), False)
    for folder in files.names("data"):
        if folder not in used:
            files.fs.delete(files.path(f"data/{folder}"), True)
