import os

import numpy as np
import pytest
from quillspark.llm import neighbours


def brute(rows, queries, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in queries:
        v = np.array(v, np.float64)
        s = (x * v).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(v))
        out[i] = sorted((-b, a) for a, b in zip(ids.tolist(), s.tolist(), strict=True) if a != i)[:k]
    return out


def recall_of(spark, rows, k=5):
    df = spark.createDataFrame([(i, [float(a) for a in v], 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = neighbours.search(df, df.where("vec_id % 50 = 0"), k=k).collect()
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], k)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for q, best in want.items():
        assert sorted(found.get(q, {})) == list(range(1, len(best) + 1))
        scores = [found[q][i][1] for i in sorted(found[q])]
        assert scores == sorted(scores, reverse=True)
        hits += len({i for _, i in best} & {i for i, _ in found[q].values()})
        total += len(best)
    return hits / max(total, 1)


def test_recall_on_clusters_and_noise(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    rows = [(i, centres[i % 40] + 0.4 * rng.normal(size=16)) for i in range(3000)]
    rows += [(3000 + i, rng.normal(size=16)) for i in range(1000)]
    assert recall_of(spark, rows) >= 0.9


def test_copies_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8).astype(np.float32)
    rows = [(i, hot) for i in range(0, 600)] + [(600 + i, rng.normal(size=8).astype(np.float32)) for i in range(300)]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows], "vec_id long, embedding array<float>")
    got = neighbours.search(df, df.where("vec_id % 50 = 0")).collect()
    for q in range(0, 600, 50):
        own = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert own == [i for i in range(6) if i != q][:5]


def test_invalid_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (50, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id % 50 = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1)]
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_small_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    assert recall_of(spark, [(i, rng.normal(size=4)) for i in range(400)]) >= 0.9


def test_recall_on_the_whole_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(path).collect()]
    assert recall_of(spark, rows) >= 0.9


def test_huge_tiny_long_and_clashing(spark):
    """Squares of these doubles leave the range; a vector of many dimensions; other columns are not looked at."""
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, -1e300]), (3, [5e-324, 0.0]), (4, [3.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, leaf int")
    got = sorted((r.rank, r.vec_id, round(r.score, 12)) for r in neighbours.search(df, df.where("vec_id = 0")).collect())
    assert [(r, i) for r, i, _ in got] == [(1, 1), (2, 4), (3, 3), (4, 2)]
    assert [s for *_, s in got] == [1.0, 1.0, round(0.5**0.5, 12), 0.0]
    rng = np.random.default_rng(4)
    assert recall_of(spark, [(i, rng.normal(size=3000)) for i in range(120)]) == 1.0


@pytest.mark.parametrize("most", [1000, 30])
def test_leaves_that_hold_too_much_are_split_again(spark, monkeypatch, most):
    rng = np.random.default_rng(6)
    for name, value in (("SAMPLE_ROWS", 100), ("LEAF_ROWS", 60), ("SPLIT_SAMPLE", 200), ("MAX_LEAVES", most)):
        monkeypatch.setattr(neighbours, name, value)
    sizes, packed = {}, neighbours._packed

    def watched(leaves, size):
        sizes.update(size)
        assert sorted(leaves) == sorted(size)
        return packed(leaves, size)

    monkeypatch.setattr(neighbours, "_packed", watched)
    centres = rng.normal(size=(20, 8))
    assert recall_of(spark, [(i, centres[i % 20] + 0.3 * rng.normal(size=8)) for i in range(4000)]) >= 0.9
    assert sum(sizes.values()) == 4000
    assert max(sizes.values()) <= 60 if most == 1000 else len(sizes) <= 30


def test_grafted_trees_assign_and_visit_every_leaf():
    rng = np.random.default_rng(7)
    x = neighbours.unit(rng.normal(size=(500, 5)))
    tree, part = neighbours.grow(x[:80]), neighbours.grow(x[80:300])
    node = next(i for i, leaf in enumerate(tree.leaf) if leaf >= 0)
    gone, before = tree.leaf[node], tree.n_leaves
    tree.graft(node, part)
    leaves = set(tree.in_order())
    assert len(leaves) == before - 1 + part.n_leaves and gone not in leaves
    assert set(tree.assign(x).tolist()) <= leaves and set(tree.visits(x[0])) == leaves
    assert next(tree.visits(x[0])) in leaves
