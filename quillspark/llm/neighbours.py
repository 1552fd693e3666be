"""Approximate nearest neighbours: hierarchical k-means tree, searched best bin first.

The tree is learned on the driver from at most ``SAMPLE_ROWS`` vectors; every row is then assigned to a leaf on the
executors.  Leaves that got more than ``LEAF_ROWS`` rows are split again, each by a tree grown on an executor from at
most ``SPLIT_SAMPLE`` of its rows, and so on, until leaves are small or the tree has ``MAX_LEAVES``, which bounds what
the driver and every task hold of it; beyond some ``LEAF_ROWS * MAX_LEAVES`` rows leaves grow.  A query walks the tree through a priority queue ordered by the
distance to the centres, and visits leaves in that order.  How many leaves are visited is calibrated: for at most
``CALIBRATION_QUERIES`` queries the true neighbours are found among all rows, and the visits are widened until the
share of true neighbours within reach is at least ``recall``.  Visits go on past that number while the leaves
visited hold too few rows.

Copies of a vector share one entry, which keeps its smallest ``k + 1`` ids: no other id can be among the results.
Neighbouring leaves are packed into groups of at most ``BLOCK_ROWS`` rows, so that a query's vector goes once to a
group with the leaves that it visits there; larger leaves, and the queries of a group, are cut into blocks of bounded
size before they meet.

Defined cases: vectors that are null, empty or zero, or that hold null or non-finite components, take no part, nor do
rows without an id or of another than the most frequent dimension; vectors are scaled by a power of two before they
are squared, so that no length overflows; rows that repeat both id and vector count once; ties go to the smaller id; a
query has fewer than ``k`` results only if there are fewer candidates; no valid rows give no results; other columns
are not looked at.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.common import materialize

SAMPLE_ROWS = 16_384
LEAF_SAMPLE = 24  # sampled vectors to a leaf
LEAF_ROWS = 2_048
SPLIT_SAMPLE = 8_192
MAX_LEAVES = 65_536
BRANCHES = 8
CALIBRATION_QUERIES = 200
BLOCK_ROWS = 4_096
QUERIES_AT_ONCE = 256
SLACK = 1e-9  # of matrix products against the scores that are returned


@dataclass
class Tree:
    """Node 0 is the root; a node has child centres and child nodes, or a leaf number."""

    centres: list[np.ndarray | None]
    children: list[list[int]]
    leaf: list[int]
    n_leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            nearest = np.argmax(x[rows] @ self.centres[node].T, axis=1)
            todo += [(child, rows[nearest == i]) for i, child in enumerate(self.children[node])]
        return out

    def graft(self, node: int, part: Tree) -> None:
        """Put a tree in the place of a leaf, whose number is given up."""
        shift = len(self.leaf) - 1  # the part's root takes the node's place
        self.centres[node], self.children[node], self.leaf[node] = part.centres[0], [c + shift for c in part.children[0]], -1
        self.centres += part.centres[1:]
        self.children += [[c + shift for c in children] for children in part.children[1:]]
        self.leaf += [n if n < 0 else n + self.n_leaves for n in part.leaf[1:]]
        self.n_leaves += part.n_leaves

    def in_order(self) -> list[int]:
        """Leaves, those of a subtree next to each other."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            todo += reversed(self.children[node])
            out += [self.leaf[node]] * (self.leaf[node] >= 0)
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        heap: list[tuple[float, int]] = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            else:
                for away, child in zip((1.0 - self.centres[node] @ q).tolist(), self.children[node], strict=True):
                    heapq.heappush(heap, (away, child))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine and keeps squares in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres, np.argmax(x @ centres.T, axis=1)


def grow(x: np.ndarray, seed: int = 1) -> Tree:
    """Split unit vectors by k-means, then each part again, until parts are small."""
    rng = np.random.default_rng(seed)
    tree = Tree([None], [[]], [-1], 0)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        parts: list[np.ndarray] = []
        if len(rows) > LEAF_SAMPLE:
            k = min(BRANCHES, max(2, len(rows) // LEAF_SAMPLE))
            centres, own = _k_means(x[rows], k, rng)
            kept = [i for i in range(k) if (own == i).any()]
            parts = [rows[own == i] for i in kept]
        if len(parts) < 2:
            tree.leaf[node] = tree.n_leaves
            tree.n_leaves += 1
            continue
        tree.centres[node] = centres[kept]
        for part in parts:
            tree.children[node].append(len(tree.leaf))
            todo.append((len(tree.leaf), part))
            tree.centres.append(None)
            tree.children.append([])
            tree.leaf.append(-1)
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    rows = rows.where("id is not null and v is not null and size(v) > 0").where(F.coalesce(fine, F.lit(False)))
    rows = rows.where(F.exists("v", lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (top[0].n if top else 0))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    recall: float = 0.97,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row of ``queries`` (same columns)."""
    rows = valid_vectors(vectors, id_col, vector_col).distinct()
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = rows.select("id", "v", first.alias("n")).where(F.col("n") <= k + 1)
    entries = materialize(entries.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")  # k + 1 ids at most

    asked = valid_vectors(queries, id_col, vector_col).distinct()
    asked = asked.join(entries.select(F.size("v").alias("d")).limit(1), F.size("v") == F.col("d"), "left_semi")
    asked = materialize(asked.select("id", F.xxhash64("v").alias("q"), "v"), "asked")
    distinct = asked.groupBy("q").agg(F.first("v").alias("v"))

    sample = entries.orderBy(F.xxhash64("v")).limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    if not len(sample):
        return _empty(asked)
    tree = grow(unit(np.array(sample.tolist(), np.float64)))

    types = dict(entries.dtypes)
    while True:
        indexed = _assigned(entries, tree)
        filled = indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("m")).collect()  # a row per leaf
        size = {r.leaf: r.n for r in filled}
        held = {r.leaf: r.m for r in filled}
        if not _deepened(tree, indexed, size):
            break

    test = asked.groupBy("q").agg(F.first("v").alias("v"), F.min("id").alias("own")).orderBy(F.xxhash64("q")).limit(CALIBRATION_QUERIES).toPandas()
    width = _calibrate(indexed, test, tree, size, k, recall)

    group = _packed([leaf for leaf in tree.in_order() if leaf in size], size)

    def reached(q: np.ndarray) -> dict[int, list[int]]:
        """The leaves to visit, by group."""
        out: dict[int, list[int]] = {}
        leaves = ids = 0
        for leaf in tree.visits(q):
            if leaf in size:
                if leaves >= width and ids > k:
                    break
                out.setdefault(group[leaf], []).append(leaf)
                leaves += 1
                ids += held[leaf]
        return out

    def visited(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            found = [reached(x) for x in unit(_matrix(b.column("v")))]
            take = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            columns = [pa.array([g for x in found for g in x], pa.int32()), b.column("q").take(take), pa.array([y for x in found for y in x.values()], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "q", "leaves"])

    spark = entries.sparkSession
    spread = distinct.repartition(2 * spark.sparkContext.defaultParallelism, "q")
    visits = materialize(spread.mapInArrow(visited, "g int, q long, leaves array<int>"), "visits")
    asks = {r.g: r.n for r in visits.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per group
    rows_of: dict[int, int] = {}
    for leaf, n in size.items():
        rows_of[group[leaf]] = rows_of.get(group[leaf], 0) + n
    blocks = [(leaf, g, -(-rows_of[g] // BLOCK_ROWS), -(-asks[g] // BLOCK_ROWS)) for leaf, g in group.items() if g in asks]
    cut = spark.createDataFrame(blocks, "leaf int, g int, rb int, qb int")  # a row per leaf
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(F.broadcast(cut), "leaf").withColumn("r", F.pmod(F.xxhash64("v"), F.col("rb")).cast("int"))
    left = left.select("g", "r", every("qb").alias("a"), "leaf", "ids", "v")
    right = visits.join(F.broadcast(cut.drop("leaf").distinct()), "g").withColumn("a", F.pmod(F.col("q"), F.col("qb")).cast("int"))
    right = right.select("g", "a", every("rb").alias("r"), "q", "leaves").join(distinct, "q")

    def met(these: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"q": [], "ids": [], "score": []}
        if len(these) and len(those):
            x, y = scaled(np.array(these["v"].tolist(), np.float64)), scaled(np.array(those["v"].tolist(), np.float64))
            ids, (leaves, leaf) = these["ids"].tolist(), np.unique(these["leaf"].to_numpy(), return_inverse=True)
            lengths = np.linalg.norm(x, axis=1)
            unit_x, asked, wanted = unit(x), those["q"].tolist(), those["leaves"].tolist()
            for at in range(0, len(y), QUERIES_AT_ONCE):
                some = y[at : at + QUERIES_AT_ONCE]
                inside = np.stack([np.isin(leaves, wanted[at + i])[leaf] for i in range(len(some))])
                for i, products in enumerate(np.where(inside, unit(some) @ unit_x.T, -np.inf)):
                    for score, row in _best(some[i], x, lengths, products, ids, k + 1):
                        out["q"].append(asked[at + i])
                        out["ids"].append(ids[row])
                        out["score"].append(score)
        return pd.DataFrame(out)

    keys = ["g", "a", "r"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(met, f"q long, ids {types['ids']}, score double")
    found = found.select("q", "score", F.explode("ids").alias("id"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    found = found.select("*", best.alias("n")).where(F.col("n") <= k + 1)
    pairs = asked.select(F.col("id").alias("query_id"), "q").join(found, "q").where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "id"))
    out = pairs.select("query_id", rank.alias("rank"), F.col("id").alias("vec_id"), "score")
    return out.where(F.col("rank") <= k)


def _assigned(entries: DataFrame, tree: Tree) -> DataFrame:
    """(leaf, ids, v) of every entry."""
    types = dict(entries.dtypes)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            leaf = tree.assign(unit(_matrix(b.column("v"))))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), b.column("ids"), b.column("v")], names=["leaf", "ids", "v"])

    return materialize(entries.mapInArrow(batches, f"leaf int, ids {types['ids']}, v {types['v']}"), "indexed")


def _deepened(tree: Tree, indexed: DataFrame, size: dict[int, int]) -> bool:
    """Split the leaves that hold too many rows; whether any was split."""
    large = {leaf: n for leaf, n in size.items() if n > LEAF_ROWS}
    room, rows = MAX_LEAVES - tree.n_leaves, sum(large.values())
    wanted = {leaf: min(-(-4 * n // LEAF_ROWS), room * n // rows) for leaf, n in large.items()}
    take = [(leaf, min(SPLIT_SAMPLE, LEAF_SAMPLE * n)) for leaf, n in wanted.items() if n > 1]
    if not take:
        return False
    asked = indexed.sparkSession.createDataFrame(take, "leaf int, take int")
    nth = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("v")))
    sample = indexed.select("leaf", "v").withColumn("nth", nth).where(F.col("nth") <= SPLIT_SAMPLE)
    sample = sample.join(F.broadcast(asked), "leaf").where(F.col("nth") <= F.col("take")).select("leaf", "v")  # a row per leaf

    def grown(rows: pd.DataFrame) -> pd.DataFrame:
        part = grow(unit(np.array(rows["v"].tolist(), np.float64)))
        return pd.DataFrame({"leaf": rows["leaf"].iloc[:1].to_numpy(), "part": [pickle.dumps(part)]})

    nodes = {leaf: node for node, leaf in enumerate(tree.leaf) if leaf >= 0}
    split = False
    for r in sample.groupBy("leaf").applyInPandas(grown, "leaf int, part binary").orderBy("leaf").collect():  # MAX_LEAVES in all
        part = pickle.loads(bytes(r.part))
        if 1 < part.n_leaves <= MAX_LEAVES - tree.n_leaves:
            tree.graft(nodes[r.leaf], part)
            split = True
    return split


def _packed(leaves: list[int], size: dict[int, int]) -> dict[int, int]:
    """Leaves, neighbours in the tree next to each other, put into groups of at most ``BLOCK_ROWS`` rows, or of one."""
    out, group, rows = {}, 0, 0
    for leaf in leaves:
        if rows and rows + size[leaf] > BLOCK_ROWS:
            group, rows = group + 1, 0
        out[leaf] = group
        rows += size[leaf]
    return out


def _best(query: np.ndarray, x: np.ndarray, lengths: np.ndarray, products: np.ndarray, ids: list, n: int) -> list[tuple[float, int]]:
    """The ``n`` nearest rows: shortlisted by ``products``, scored on the vectors, ties by first id; rows whose product
    is minus infinity are none."""
    near = np.nonzero(products > -np.inf)[0]
    if len(near) > n:
        least = np.partition(products, len(products) - n)[len(products) - n]
        near = np.nonzero(products >= least - SLACK)[0]
    scores = (x[near] * query).sum(axis=1) / (lengths[near] * np.sqrt((query * query).sum()))
    ranked = sorted(zip((-scores).tolist(), [ids[i][0] for i in near], near.tolist(), strict=True))
    return [(-s, at) for s, _, at in ranked[:n]]


def _calibrate(indexed: DataFrame, test: pd.DataFrame, tree: Tree, size: dict[int, int], k: int, recall: float) -> int:
    """How many leaves to visit so that this share of the test queries' true neighbours is reached."""
    if not len(test):
        return 1
    y = scaled(np.array(test["v"].tolist(), np.float64))
    id_list = to_arrow_type(indexed.schema["ids"].dataType)

    def nearest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple]] = [[] for _ in y]
        for b in source:
            x = scaled(_matrix(b.column("v")))
            if not len(x):
                continue
            ids, leaf, lengths = b.column("ids").to_pylist(), b.column("leaf").to_pylist(), np.linalg.norm(x, axis=1)
            for i, products in enumerate(unit(y) @ unit(x).T):
                kept[i] += [(-s, ids[at], leaf[at]) for s, at in _best(y[i], x, lengths, products, ids, k + 1)]
                kept[i] = sorted(kept[i])[: k + 1]
        rows = [(i, -s, j, at) for i, found in enumerate(kept) for s, j, at in found]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), id_list, pa.int32()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "score", "ids", "leaf"])

    ids_type = dict(indexed.dtypes)["ids"]
    found = indexed.mapInArrow(nearest, f"i int, score double, ids {ids_type}, leaf int")
    best = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), F.col("ids")[0]))
    found = found.select("*", best.alias("n")).where(F.col("n") <= k + 1).collect()  # (k + 1) rows per test query
    order = []
    for x in unit(y):
        order.append({leaf: at for at, leaf in enumerate(leaf for leaf in tree.visits(x) if leaf in size)})
    places: list[int] = []
    for i, own in enumerate(test["own"]):
        ranked = sorted((-r.score, j, r.leaf) for r in found if r.i == i for j in r.ids if j != own)
        places += [order[i][leaf] for _, _, leaf in ranked[:k]]
    places_sorted = np.sort(places)
    width = 1
    while places and width < len(size) and (places_sorted < width).mean() < recall:
        width += 1
    return width


def _empty(asked: DataFrame) -> DataFrame:
    kind = dict(asked.dtypes)["id"]
    return asked.select(
        F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.lit(None).cast(kind).alias("vec_id"), F.lit(0.0).alias("score")
    ).limit(0)
