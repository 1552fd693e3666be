"""Near-duplicate join on the Jaccard similarity of word shingles, with Bayesian pruning of candidates.

Texts with equal shingle sets form a class; classes are joined, not copies.  A class has a MinHash signature, cut
into bands; classes that share a band are candidates.  A pair is judged in its first common band only.  There its
signatures are compared a part at a time, and the pair is dropped as soon as the posterior probability (uniform
prior) that its similarity reaches the threshold falls below ``TOLERANCE``.  The pairs left are verified on their
whole shingle sets.  With 24 bands of 4 values a pair at the threshold of 0.8 shares no band with a probability of
3e-6, and less above.

A band that very many classes share is cut into blocks of at most ``BLOCK``, and pairs of blocks are judged by
different tasks; pairs are kept as places within a block, never as rows.  Links become stars per block and then
connected components.

Defined cases: null texts and texts without words are similar to nothing; texts of fewer words than a shingle are
one shingle; rows that repeat count as documents of their own; a group's id is the least id among its documents
(null ids only if there is no other); texts may be of any length; columns of ``docs`` pass through ``keep_one`` whatever
their names; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import shingles
from quillspark.llm.common import materialize, text_key
from quillspark.llm.components import components

VALUES = 96
BANDS = 24
PART = 16
TOLERANCE = 1e-6
BLOCK = 512
PAIRS_AT_ONCE = 100_000
DENSE_CELLS = 16_000_000
BROADCAST_ROWS = 300_000  # of a few numbers


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By values compared, the fewest matches that keep a pair.

    With m of n values equal and a uniform prior, the similarity has a Beta(m + 1, n - m + 1) posterior; it exceeds
    the threshold with the probability that a binomial variable of n + 1 draws is at most m.
    """
    out = {}
    for n in range(PART, VALUES + 1, PART):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _class_rows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row per document: id, text keys, class (two numbers; null without words), signature and bands."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            sets = [shingles.shingle_set(t, width) for t in b.column(3).to_pylist()]
            signed = shingles.signatures(sets, VALUES)
            keys = shingles.band_keys(signed, BANDS)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            a = [int.from_bytes(d[:8], "big", signed=True) if d else None for d in digests]
            c = [int.from_bytes(d[8:], "big", signed=True) if d else None for d in digests]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    b.column(2),
                    pa.array(a, pa.int64()),
                    pa.array(c, pa.int64()),
                    pa.array([s.tobytes() for s in signed], pa.binary()),
                    pa.array(list(keys), pa.list_(pa.int64())),
                ],
                names=["id", "key_a", "key_b", "a", "b", "signature", "bands"],
            )

    read = docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), F.col(text_col).alias("text"))
    return read.mapInArrow(batches, f"id {id_type}, key_a long, key_b long, a long, b long, signature binary, bands array<long>")


def _runs(source: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted batches: a table and the places where its groups start (and its end)."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(len(table) - 1, 0), bool)
        for k in keys:
            values = table.column(k).to_numpy()
            change |= values[1:] != values[:-1]
        return np.concatenate([[0], np.nonzero(change)[0] + 1])

    for batch in source:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        starts = cut(table)
        if starts[-1] > 0:
            yield table.slice(0, starts[-1]), starts
        held = table.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.array([0, len(table)])


def _candidates(tasks: DataFrame, threshold: float) -> DataFrame:
    """Per block of a band: the classes in pairs that were not dropped, and the pairs as places among them."""
    least = least_matches(threshold)
    per_band = VALUES // BANDS

    def judged(signed: np.ndarray, bands: np.ndarray, i: np.ndarray, j: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Which pairs meet here for the first time and are not dropped."""
        alive = np.arange(len(i))
        common = bands[i] == bands[j]
        alive = alive[np.argmax(common, axis=1) == mine]
        matches = np.zeros(len(i), np.int32)
        for at in range(0, VALUES, PART):
            x, y = i[alive], j[alive]
            matches[alive] += (signed[x, at : at + PART] == signed[y, at : at + PART]).sum(axis=1, dtype=np.int32)
            alive = alive[matches[alive] >= least[at + PART]]
        return alive

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _runs(source, ["key", "low", "high"]):
            raw = b"".join(table.column("signature").to_pylist())
            signed = np.frombuffer(raw, np.uint32).reshape(len(table), VALUES)
            bands = shingles.band_keys(signed, BANDS)
            key = table.column("key").to_numpy()
            side = table.column("side").to_numpy()
            low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
            mine = np.argmax(bands == key[:, None], axis=1)
            kept: dict[int, list[np.ndarray]] = {}
            todo: list[tuple[np.ndarray, np.ndarray]] = []
            waiting = 0

            def settle() -> None:
                nonlocal waiting
                if todo:
                    i, j = (np.concatenate(x) for x in zip(*todo, strict=True))
                    for at in range(0, len(i), PAIRS_AT_ONCE):
                        x, y = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
                        alive = judged(signed, bands, x, y, mine[x])
                        group = np.searchsorted(starts, x[alive], side="right") - 1
                        for g in np.unique(group):
                            kept.setdefault(int(g), []).append(np.stack([x[alive][group == g], y[alive][group == g]]))
                    todo.clear()
                waiting = 0

            for first, last in zip(starts[:-1], starts[1:], strict=True):
                rows = np.arange(first, last)
                if low[first] == high[first]:
                    i, j = np.triu_indices(len(rows), 1)
                    todo.append((rows[i], rows[j]))
                else:
                    x, y = rows[side[rows] == low[first]], rows[side[rows] == high[first]]
                    todo.append((np.repeat(x, len(y)), np.tile(y, len(x))))
                waiting += len(todo[-1][0])
                if waiting >= PAIRS_AT_ONCE:
                    settle()
            settle()
            out: dict[str, list] = {n: [] for n in ("key", "low", "high", "members", "pairs")}
            a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
            for g, found in kept.items():
                pairs = np.concatenate(found, axis=1)
                rows, places = np.unique(pairs, return_inverse=True)
                out["key"].append(key[rows[0]])
                out["low"].append(low[rows[0]])
                out["high"].append(high[rows[0]])
                out["members"].append([{"a": int(a[r]), "b": int(b[r])} for r in rows])
                out["pairs"].append(places.reshape(2, -1).astype(np.uint16).tobytes())
            types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    assert per_band * BANDS == VALUES
    return tasks.mapInArrow(batches, "key long, low int, high int, members array<struct<a: long, b: long>>, pairs binary")


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least ``threshold``, exactly."""
    part = Fraction(threshold).limit_denominator(1_000_000)
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = np.zeros(len(i), np.int64)
    dense = len(i) > 8 * len(sets)
    if dense:
        values, where = np.unique(np.concatenate(sets), return_inverse=True)
        dense = len(values) * len(sets) <= DENSE_CELLS
    if dense:
        held = np.zeros((len(sets), len(values)), np.float32)
        held[np.repeat(np.arange(len(sets)), sizes), where] = 1.0
        shared = (held @ held.T).astype(np.int64)[i, j]  # counts below 2 ** 24 are exact
    else:
        for n, (x, y) in enumerate(zip(i, j, strict=True)):
            s, t = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
            at = np.searchsorted(t, s)
            shared[n] = (t[np.minimum(at, len(t) - 1)] == s).sum()
    union = sizes[i] + sizes[j] - shared
    return shared * part.denominator >= union * part.numerator


def _links(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links, root_a, root_b) per class and block: documents linked to it, least class of its star."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _runs(source, ["key", "low", "high"]):
            a, b, weight = (table.column(c).to_numpy() for c in ("a", "b", "n"))
            out: dict[str, list] = {n: [] for n in ("a", "b", "links", "root_a", "root_b")}
            for first, last in zip(starts[:-1], starts[1:], strict=True):
                own = table.slice(first, last - first)
                order = np.argsort(own.column("place").to_numpy()) + first
                pairs = next(p for p in own.column("pairs").to_pylist() if p is not None)
                i, j = np.frombuffer(pairs, np.uint16).reshape(2, -1).astype(np.int64)
                raw = table.column("set").take(pa.array(order)).to_pylist()
                sets = [np.frombuffer(s, np.uint64) for s in raw]
                true = verified(sets, i, j, threshold)
                i, j = i[true], j[true]
                if not len(i):
                    continue
                n = len(order)
                links = np.bincount(i, weight[order][j], n) + np.bincount(j, weight[order][i], n)
                names = list(zip(a[order].tolist(), b[order].tolist(), strict=True))
                root = _local_roots(n, i, j, names)
                for k in np.nonzero(links)[0]:
                    out["a"].append(names[k][0])
                    out["b"].append(names[k][1])
                    out["links"].append(int(links[k]))
                    out["root_a"].append(names[root[k]][0])
                    out["root_b"].append(names[root[k]][1])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return rows.mapInArrow(batches, "a long, b long, links long, root_a long, root_b long")


def _local_roots(n: int, i: np.ndarray, j: np.ndarray, names: list[tuple[int, int]]) -> list[int]:
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            small, large = (x, y) if names[x] < names[y] else (y, x)
            up[large] = small
    return [find(x) for x in range(n)]


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5
) -> DataFrame:
    """(id, key_a, key_b, root, class_id, n_links) per document: its group and how many documents are similar to it.

    ``root`` is the group's least class, null for a text without words.
    """
    rows = materialize(_class_rows(docs, id_col, text_col, width), "signatures")
    with_words = rows.where("a is not null")
    classes = with_words.groupBy("a", "b").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min(F.struct("key_a", "key_b", "id")).alias("text"),
        F.first("signature").alias("signature"), F.first("bands").alias("bands"),
    )
    classes = materialize(classes, "classes")

    banded = classes.select("a", "b", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    tasks = banded.join(shared, "key").withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int"))
    side = F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int")
    tasks = tasks.select("a", "b", "key", side.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("a", "b", "key", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    tasks = tasks.join(classes.select("a", "b", "signature"), ["a", "b"])
    group = ["key", "low", "high"]
    tasks = tasks.repartition(*group).sortWithinPartitions(*group)
    found = materialize(_candidates(tasks, threshold), "candidates")

    members = found.select(*group, "pairs", F.posexplode("members").alias("place", "c"))
    members = members.select(
        *group, "place", "c.a", "c.b", F.when(F.col("place") == 0, F.col("pairs")).alias("pairs")
    )
    needed = materialize(members.select("a", "b").distinct().join(classes.select("a", "b", "text", "n"), ["a", "b"]), "needed")
    sets = _sets(docs, needed, id_col, text_col, width)
    to_verify = members.join(sets, ["a", "b"]).repartition(*group).sortWithinPartitions(*group)
    links = materialize(_links(to_verify, threshold), "links")

    edges = links.select(F.struct("a", "b").alias("u"), F.struct(F.col("root_a").alias("a"), F.col("root_b").alias("b")).alias("v"))
    roots = components(edges)
    counts = links.groupBy("a", "b").agg(F.sum("links").alias("links"))
    joined = classes.select("a", "b", "rep", "n").join(counts, ["a", "b"], "left")
    joined = joined.join(roots, (F.col("node.a") == F.col("a")) & (F.col("node.b") == F.col("b")), "left")
    joined = joined.select("a", "b", "rep", "n", "links", F.coalesce("root", F.struct("a", "b")).alias("root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = joined.join(least, "root").select(
        F.col("a").alias("class_a"), F.col("b").alias("class_b"), "root", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    # a table of its own, so that the documents of a class with very many of them are split
    named = materialize(named, "named")
    out = rows.select("id", "key_a", "key_b", "a", "b").join(named, (F.col("a") == F.col("class_a")) & (F.col("b") == F.col("class_b")), "left")
    return out.select(
        "id",
        "key_a",
        "key_b",
        "root",
        F.when(F.col("a").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(a, b, n, set) of the classes in ``needed``, from the document that stands for each; its copies are not moved."""
    wanted = needed.select("a", "b", "n", *[F.col(f"text.{c}").alias(f"want_{c}") for c in ("key_a", "key_b", "id")])
    if needed.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    key_a, key_b = text_key(F.col(text_col))
    texts = docs.select(key_a, key_b, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    same = [F.col("key_a") == F.col("want_key_a"), F.col("key_b") == F.col("want_key_b"), F.col("id").eqNullSafe(F.col("want_id"))]
    texts = texts.join(wanted, same)
    texts = texts.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("text").alias("text"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            sets = pa.array([shingles.shingle_set(t, width).tobytes() for t in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sets], names=["a", "b", "n", "set"])

    return texts.mapInArrow(batches, "a long, b long, n long, set binary")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group, the one with the least id; columns are kept as they are.

    Texts without words are in no group and stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    first = F.row_number().over(Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), "key_a", "key_b"))
    grouped = found.where("root is not null").select("id", "key_a", "key_b", first.alias("nth")).where("nth = 1").drop("nth")
    wordless = found.where("root is null").select("id", "key_a", "key_b").distinct()
    stay = grouped.withColumn("single", F.lit(True)).unionByName(wordless.withColumn("single", F.lit(False)))
    stay = stay.select(F.col("id").alias("stay_id"), F.col("key_a").alias("stay_a"), F.col("key_b").alias("stay_b"), "single")
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_name, text_name = (names[docs.columns.index(c)] for c in (id_col, text_col))
    read = docs.toDF(*names).select(*names, *text_key(F.col(text_name)))
    same = F.col(id_name).eqNullSafe(F.col("stay_id")) & (F.col("key_a") == F.col("stay_a")) & (F.col("key_b") == F.col("stay_b"))
    # rows that repeat both id and text are copies of each other
    once = F.row_number().over(Window.partitionBy("stay_id", "stay_a", "stay_b").orderBy(F.lit(1)))
    kept = read.join(stay, same).withColumn("once", once).where("once = 1 or not single")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
