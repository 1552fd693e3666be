"""Protocols of outside services, and their null and stub forms; real ones run inside ``mapInPandas``."""

from __future__ import annotations

import ast
import hashlib
import json
import math
import re
import threading
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SecondOpinion(Protocol):
    label: str

    def chat(self, system: str, user: str) -> str:
        """A JSON answer."""


class Recognizer(Protocol):
    def recognize(self, content: bytes) -> bytes | None:
        """The document with a text layer, or nothing."""


class NullOpinion:
    label = "null"

    def chat(self, system: str, user: str) -> str:
        raise RuntimeError("no model")


class EchoOpinion:
    """Answers as the nearest example in the prompt was decided; for tests and dry runs."""

    label = "echo"

    def chat(self, system: str, user: str) -> str:
        one = r"""('(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|None)"""
        found = re.search(rf"^  → category={one}, issuer={one}$", user, re.MULTILINE)
        if not found:
            raise RuntimeError("no example")
        category, issuer = map(ast.literal_eval, found.groups())
        return json.dumps({"category": str(category), "issuer": issuer, "confidence": 0.9, "reasons": ["as before"]})


class NullRecognizer:
    def recognize(self, content: bytes) -> bytes | None:
        return None


@dataclass(frozen=True)
class Calls:
    """How a task asks a service: so many calls at once, attempts with growing pauses, and a deadline for each row.

    After ``breaker`` failed rows in a row the service counts as down: rows fail at once, and every ``cool_s`` one is
    tried.  The bound holds for a task; a service sees that many calls from each task that runs."""

    in_flight: int = 8
    attempts: int = 3
    pause_s: float = 0.5
    deadline_s: float = 120.0
    breaker: int = 10
    cool_s: float = 30.0


class _Caller:
    """A task's calls: results in the order of the rows, errors by row."""

    def __init__(self, call, calls: Calls) -> None:
        self.call, self.calls, self.lock = call, calls, threading.Lock()
        self.failed, self.open_until = 0, 0.0

    def _may(self) -> bool:
        with self.lock:
            if self.failed < self.calls.breaker:
                return True
            now = time.monotonic()
            if now < self.open_until:
                return False
            self.open_until = now + self.calls.cool_s  # one row tries
            return True

    def _settle(self, ok: bool) -> None:
        with self.lock:
            self.failed = 0 if ok else self.failed + 1
            if self.failed == self.calls.breaker:
                self.open_until = time.monotonic() + self.calls.cool_s

    def one(self, text: str) -> tuple[str | None, str | None, int]:
        began = time.monotonic()
        spent = lambda: time.monotonic() - began
        if not self._may():
            return None, "service down", 0
        error = None
        for attempt in range(max(self.calls.attempts, 1)):
            try:
                answer = self.call(text)
                self._settle(True)
                return answer, None, int(1000 * spent())
            except Exception as problem:  # noqa: BLE001
                error = str(problem) or type(problem).__name__
            pause = self.calls.pause_s * 2**attempt
            if attempt + 1 < self.calls.attempts and spent() + pause < self.calls.deadline_s:
                time.sleep(pause)
            else:
                break
        self._settle(False)
        return None, error, int(1000 * spent())

    def all(self, texts) -> Iterator[tuple[str | None, str | None, int]]:
        pool = ThreadPoolExecutor(max(self.calls.in_flight, 1))
        try:
            for found in [pool.submit(self.one, text) for text in texts]:
                try:
                    yield found.result(timeout=2 * self.calls.deadline_s)
                except FutureTimeout:
                    found.cancel()
                    self._settle(False)
                    yield None, "no answer in time", int(2000 * self.calls.deadline_s)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)


def ask(prompts: DataFrame, backend: SecondOpinion, system: str, *, user: str = "user", calls: Calls = Calls()) -> DataFrame:
    """``prompts`` with answer, error and duration_ms; a failure is that row's.  The null backend asks nobody."""
    if isinstance(backend, NullOpinion):
        none = F.lit(None).cast("string")
        return prompts.withColumn("answer", none).withColumn("error", F.lit("no model")).withColumn("duration_ms", F.lit(0).cast("long"))
    schema = prompts.schema.simpleString()

    def run(batches):
        caller = _Caller(lambda text: backend.chat(system, text), calls)
        for b in batches:
            rows = list(caller.all(b[user]))
            yield b.assign(**dict(zip(("answer", "error", "duration_ms"), map(list, zip(*rows, strict=True)) if rows else ([], [], []), strict=True)))

    fields = schema[len("struct<") : -1]
    return prompts.mapInPandas(run, f"{fields}, answer string, error string, duration_ms bigint".replace(":", " "))


def recognize(files: DataFrame, engine: Recognizer, content: str = "content") -> DataFrame:
    """(path, content, issues): recognised documents; where that fails, nothing and an issue."""
    failed = F.array(F.lit("OCR/compression failed"))
    if isinstance(engine, NullRecognizer):
        return files.select("path", F.lit(None).cast("binary").alias("content"), failed.alias("issues"))

    def run(batches):
        for b in batches:
            out = []
            for c in b[content]:
                try:
                    out.append(engine.recognize(bytes(c)))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pd.DataFrame({"path": b["path"], "content": out})

    done = files.select("path", content).mapInPandas(run, "path string, content binary")
    return done.withColumn("issues", F.when(F.col("content").isNull(), failed).otherwise(F.array().cast("array<string>")))


def stub_embedding(dimension: int = 16):
    """A column function that gives a text a fixed unit vector, for tests and dry runs."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str) -> list[float]:
            raw = hashlib.sha256(text.encode()).digest()
            values = [b / 127.5 - 1.0 for b in (raw * (dimension // 32 + 1))[:dimension]]
            length = math.sqrt(sum(v * v for v in values)) or 1.0
            return [v / length for v in values]

        return texts.fillna("").map(one)

    def apply(text: Column) -> Column:
        return embed(text)

    return apply
