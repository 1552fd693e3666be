"""Outside services: a chat model and an embedder behind HTTP, text of PDF files, recognition of scans.

They run on the executors, inside ``backends.ask``, ``backends.recognize`` and ``readers.read_texts``; what they need
must be installed there.  All are optional: without them the null forms of ``backends`` are used.
"""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import urllib.request
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import RoutingConfig
from quillspark.operators import backends, vectors


def _post(url: str, body: dict, timeout_s: float) -> dict:
    asked = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(asked, timeout=timeout_s) as answer:
        return json.load(answer)


@dataclass(frozen=True)
class HttpOpinion:
    """A model server's chat: one JSON object as the answer, no randomness."""

    model: str = "llama3.2:3b"
    host: str = "http://127.0.0.1:11434"
    timeout_s: float = 30
    context: int = 4096

    @property
    def label(self) -> str:
        return f"http:{self.model}"

    def chat(self, system: str, user: str) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        options = {"temperature": 0, "num_ctx": self.context}
        found = _post(f"{self.host}/api/chat", {"model": self.model, "messages": messages, "format": "json", "stream": False, "options": options}, self.timeout_s)
        answer = (found.get("message") or {}).get("content")
        if not answer:
            raise RuntimeError("the model gave no answer")
        return answer


def http_embedding(model: str = "nomic-embed-text", host: str = "http://127.0.0.1:11434", timeout_s: float = 30):
    """A column function from text to a vector by a model server; a text that fails has none."""

    def one(text: str) -> list[float] | None:
        try:
            return _post(f"{host}/api/embeddings", {"model": model, "prompt": text}, timeout_s).get("embedding") or None
        except (OSError, ValueError):
            return None

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) if t else None for t in texts], dtype=object)

    def apply(text: Column) -> Column:
        return embed(text)

    return apply


def pdf_text(content: bytes) -> str:
    """The texts of a PDF's pages, one after the other; an extractor for ``readers.read_texts``."""
    import io

    import pypdf  # optional

    return "".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages)


@dataclass(frozen=True)
class CommandRecognizer:
    """Recognition by a command that reads one file and writes another; nothing where it fails or takes too long."""

    command: tuple[str, ...] = ("ocrmypdf", "--language", "eng+spa", "--deskew", "--skip-text", "--optimize", "3")
    timeout_s: float = 120

    def recognize(self, content: bytes) -> bytes | None:
        with tempfile.TemporaryDirectory() as folder:  # of this task, on the machine it runs on
            source, target = os.path.join(folder, "in.pdf"), os.path.join(folder, "out.pdf")
            with open(source, "wb") as f:
                f.write(content)
            try:
                subprocess.run([*self.command, source, target], check=True, capture_output=True, timeout=self.timeout_s)
                with open(target, "rb") as f:
                    return f.read()
            except (OSError, subprocess.SubprocessError):
                return None


def doctor(spark: SparkSession, config: RoutingConfig, opinion: backends.SecondOpinion, embed, store: DataFrame | None = None) -> DataFrame:
    """(component, status, detail) of what a second opinion needs: its switch, the model, the embedder and the store.

    Model and embedder are asked once each, by a task, as they are in a batch."""
    options = config.second_opinion
    one = spark.range(1).select(F.lit("doctor").alias("user"))
    label = getattr(opinion, "label", type(opinion).__name__)
    switch = spark.range(1).select(F.lit("config").alias("component"), F.lit("on" if options.enabled else "off").alias("status"), F.lit("llm.enabled").alias("detail"))
    failure = F.coalesce("error", F.when(F.col("answer").isNull(), F.lit("no answer")))
    asked = backends.ask(one, opinion, "Answer with a JSON object.")
    chat = asked.select(F.lit("model"), F.when(failure.isNull(), F.lit("ok")).otherwise(F.lit("down")), F.concat_ws(" - ", F.lit(label), failure))
    vector = one.select(embed(F.col("user")).alias("v"))
    has = F.coalesce(F.size("v") > 0, F.lit(False))
    size = F.when(has, F.concat(F.lit("dim="), F.size("v").cast("string")))
    embedder = vector.select(F.lit("embedder"), F.when(has, F.lit("ok")).otherwise(F.lit("down")), F.concat_ws(" - ", F.lit(options.embed_model), size))
    if store is None:
        kept = spark.range(1).select(F.lit("store"), F.lit("missing"), F.lit(""))
    else:
        info = vectors.store_info(store)
        detail = F.concat(F.col("total").cast("string"), F.lit(" records, dim="), F.coalesce(F.col("dim").cast("string"), F.lit("none")))
        kept = info.select(F.lit("store"), F.when(F.col("total") > 0, F.lit("ok")).otherwise(F.lit("empty")), detail)
    return switch.union(chat).union(embedder).union(kept)
