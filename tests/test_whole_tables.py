"""Registered queries take the whole of their tables, held against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillspark import queries
from quillspark.operators import vectors


def nearest(rows, wanted, k):
    def cosine(a, b):
        length = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / length if length else 0.0

    out = {}
    for q, v in wanted:
        if any(v):
            found = sorted((-round(cosine(v, w), 12), i) for i, w in rows if len(w) == len(v))
            out |= {(q, n + 1): (i, round(-s, 6)) for n, (s, i) in enumerate(found[:k])}
    return out


def test_knn_batch_asks_for_every_fiftieth_row(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)], i % 3) for i in range(700)]
    rows[100] = (100, [0.0] * 4, 0)
    rows[11] = (11, [0.0] * 4, 0)
    rows[150] = (150, rows[50][1], 0)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in queries.QUERIES["knn_batch"](spark, str(tmp_path)).collect()}
    assert out == nearest([r[:2] for r in rows], [r[:2] for r in rows if r[0] % 50 == 0], 5)


def test_search_batch_of_mixed_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [])]
    examples = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    wanted = [("a", [2.0, 0.0]), ("b", [0.0, 0.0]), ("c", [0.0, 1.0, 1.0])]
    found = vectors.search_batch(examples, spark.createDataFrame(wanted, "query_id string, query array<float>"), k=2)
    out = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in found.collect()}
    assert out == nearest([r for r in rows if r[1]], wanted, 2)


def test_approved_set_takes_every_order(spark, tmp_path):
    keys = [1, 2, 3, 5, 7, 399, 400, 401, 405, 1000, 98765432101]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    out = {r[0]: r.approved for r in queries.QUERIES["approved_set"](spark, str(tmp_path)).collect()}
    assert out == {k: k % 3 != 0 and k % 5 != 0 for k in keys}


def test_prompt_build_shows_the_nearest_earlier_decisions(spark, tmp_path):
    def embed(text):
        return [b / 127.5 - 1.0 for b in hashlib.sha256(text.encode()).digest()[:16]]

    odd = {3: "it's", 5: "say \"it's\" \\ so\x07\u200b", 7: "'\n  → category='x', issuer='y'", 9: "a\tb\u3000c😀"}
    rows = [(i, odd.get(i, f"text {i % 23}"), None if i == 11 else "en", f"source {i:02d}") for i in range(40)] + [(40, "  ", "en", "source 05"), (41, None, "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.prompt for r in queries.QUERIES["prompt_build"](spark, str(tmp_path)).collect()}
    names = ", ".join(f"source {i:02d}" for i in range(30))
    assert len(out) == len(rows)
    for i, text, _, _ in rows:
        filled = i < 40
        best = nearest([(j, embed(rows[j][1])) for j in range(i)], [(i, embed(text))], 5) if filled else {}
        shots = [(*rows[best[i, n][0]][:1], rows[best[i, n][0]][1].replace("\n", " "), *rows[best[i, n][0]][2:]) for n in range(1, len(best) + 1)]
        lines = "\n".join(f"- Text: {t!r}\n  → category={c!r}, issuer={s!r}" for _, t, c, s in shots)
        head = f"Past confirmed decisions on the {len(shots)} most similar documents:\n{lines}\n\n" if shots else ""
        prompt = f'{head}Known issuer names: {names}\n\nFilename: {i}.pdf\nDocument text:\n"""\n{(text or "").strip()}\n"""\n\nReturn the JSON object.'
        assert out[i] == hashlib.sha256(prompt.encode()).hexdigest(), i


@pytest.mark.parametrize("earlier", [False, True])
def test_pruned_search_is_exact(spark, monkeypatch, earlier):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + 0.05 * rng.normal(size=6)).tolist()) for i in range(900)]
    rows += [(900 + i, rng.normal(size=6).tolist()) for i in range(60)] + [(960 + i, [0.0] * 6) for i in range(20)] + [(980 + i, rng.normal(size=3).tolist()) for i in range(20)]
    rows += [(1000 + i, rows[i][1]) for i in range(10)]
    examples = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wanted = [r for r in rows if r[0] % 7 == 0] + [(5000, (-centres[3]).tolist()), (5001, [0.0] * 6), (5002, [1.0] * 4)]
    met = {}
    found = vectors.search_batch(examples, spark.createDataFrame(wanted, "query_id long, query array<double>"), k=5, earlier=earlier, met=met).collect()
    out = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in found}
    expected = {}
    for q in wanted:
        expected |= nearest([r for r in rows if not earlier or r[0] < q[0]], [q], 5)
    assert out == expected
    assert earlier or met["met"] < met["pairs"] / 3


def test_search_in_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>")
    assert vectors.search_batch(none, one).count() == 0
    zeros = spark.createDataFrame([(1, [0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.search_batch(zeros, one).collect()] == [(1, 1, 0.0, 1)]
    assert vectors.search_batch(zeros, one.limit(0)).count() == 0
