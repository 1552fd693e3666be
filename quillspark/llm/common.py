"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.scratch import materialize  # noqa: F401  for the operators

#: The word and size patterns of the operators' contracts.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text: lower-cased A-Z, digits, and every character above ASCII; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text (null reads as empty)."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("key_a"), F.xxhash64(F.lit("second"), t, F.length(t)).alias("key_b")]


def numbered(docs: DataFrame, *results: str) -> tuple[DataFrame, list[str], list[tuple[str, str]]]:
    """``docs`` with its columns called c0, c1, ..., these names, and (name, old name) of those to keep: a column that
    is called like one of ``results`` gives way to it."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    taken = {r.lower() for r in results}
    return docs.toDF(*names), names, [(n, c) for n, c in zip(names, docs.columns, strict=True) if c.lower() not in taken]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
