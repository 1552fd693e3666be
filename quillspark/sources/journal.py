"""Approved moves carried out on executors, by a write-ahead journal on shared storage.

The moves are written down before the first is made.  Each is then made in steps that can be made again: a claim of the
name in the journal, the file under that name, its copy in the archive, and the removal of the source.  A name is taken by
a link that fails where there is one, so that no file is ever replaced; where another has taken it meanwhile, the next
free number is claimed.  After a crash at any point, or when an executor is lost, the same call goes on: what a claim and
the files show as done is not done again, and each file is there once in the end.

Files lie on a file system that all executors mount; the journal may be anywhere that Spark writes, its claims beside
the files' targets.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.readers import exists

DONE = "id string, source string, target string, error string"
_CHUNK = 1 << 20


def _digest(path: str) -> str:
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(_CHUNK):
            found.update(part)
    return found.hexdigest()


def _same(a: str, b: str) -> bool:
    return os.path.samefile(a, b) or (os.path.getsize(a) == os.path.getsize(b) and _digest(a) == _digest(b))


def _write_claim(path: str, claim: dict) -> None:
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(claim, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def _read_claim(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {}


def _place(source: str, wanted: str, claims: str, key: str, link: bool, step: Callable[[str], None]) -> str:
    """The source's content under a name of its own: ``wanted``, or with the next free number."""
    os.makedirs(os.path.dirname(wanted) or ".", exist_ok=True)
    head, tail = os.path.splitext(wanted)
    claim = _read_claim(claims)
    target, n = claim.get(key, wanted), claim.get(f"{key}_n", 2)
    while True:
        if key in claim and claim[key] == target and os.path.exists(target) and _same(source, target):
            return target  # made before a crash
        if not os.path.exists(target):
            claim |= {key: target, f"{key}_n": n}
            _write_claim(claims, claim)
            step(f"{key} claimed")
            beside = source
            if not link:
                beside = f"{target}.{uuid.uuid4().hex}.part"
                shutil.copy2(source, beside)
                step(f"{key} copied")
            try:
                os.link(beside, target)
                step(f"{key} linked")
                return target
            except FileExistsError:
                pass  # taken meanwhile
            finally:
                if not link and os.path.exists(beside):
                    os.unlink(beside)
        target, n = f"{head} - {n}{tail}", n + 1


def move(key: str, source: str, target: str, claims: str, *, archive: str | None = None, rename: bool = False, step: Callable[[str], None] = lambda done: None) -> str:
    """Make one move, or what is left of it; gives the name that the file has."""
    os.makedirs(claims, exist_ok=True)
    own = os.path.join(claims, key)
    claim = _read_claim(own)
    if not os.path.exists(source):
        if "target" in claim and os.path.exists(claim["target"]):
            return claim["target"]  # all was done but told
        raise FileNotFoundError(f"no file {source}")
    if os.path.exists(target) and os.path.samefile(source, target) and "target" not in claim:
        return target  # it is where it should be
    made = _place(source, target, own, "target", rename, step)
    if archive and not rename:
        _place(source, os.path.join(archive, os.path.basename(source)), own, "archive", False, step)
    os.unlink(source)
    step("removed")
    return made


def apply_journal(spark: SparkSession, journal: str, claims: str, plan: DataFrame | None = None, *, archive: str | None = None, rename: bool = False) -> DataFrame:
    """(id, source, target, error) of a journal's moves, each made once.

    ``plan``: (source, target), written down by the first call; later ones go on with what that holds, and take none.
    ``claims``: a folder on the files' file system.  Moves that failed are tried again by the next call."""
    intents, done = f"{journal.rstrip('/')}/intents", f"{journal.rstrip('/')}/done"
    if plan is not None and not exists(spark, f"{intents}/_SUCCESS"):
        key = F.sha2(F.concat_ws("\x00", "source", "target"), 256)
        plan.select(key.alias("id"), "source", "target").dropDuplicates(["source"]).write.mode("overwrite").parquet(intents)
    todo = spark.read.parquet(intents)
    if exists(spark, done):
        told = spark.read.schema(DONE).parquet(done).where("error is null")
        todo = todo.join(told.select("id"), "id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made, errors = [], []
            for key, source, target in zip(b["id"], b["source"], b["target"], strict=True):
                try:
                    made.append(move(key, source, target, claims, archive=archive, rename=rename))
                    errors.append(None)
                except OSError as problem:
                    made.append(None)
                    errors.append(str(problem))
            yield pd.DataFrame({"id": b["id"], "source": b["source"], "target": made, "error": errors})

    todo.repartition("id").mapInPandas(run, DONE).write.mode("append").parquet(done)
    every = spark.read.schema(DONE).parquet(done)
    last = every.groupBy("id").agg(F.min_by(F.struct("source", "target", "error"), F.col("error").isNotNull()).alias("r"))
    return last.select("id", "r.source", "r.target", "r.error")
