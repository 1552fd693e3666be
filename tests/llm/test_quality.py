import zlib

import numpy as np
from quillspark.llm import quality


def test_held_out_is_crc32(spark):
    ids = [0, 1, 2, 3, 17, -5, 123456789012, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", quality.held_out(__import__("pyspark").sql.functions.col("doc_id"))).collect()
    for i, h in got:
        assert h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)


def test_model_learns_main_effects_and_pairs():
    rng = np.random.default_rng(3)
    x = rng.random((6000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair can tell
    model = quality.fit(x[:4000], y[:4000])
    assert ((model.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.9
    assert (0, 1) in model.pairs
    y = (x[:, 2] + 0.2 * rng.random(6000) > 0.6).astype(float)
    model = quality.fit(x[:4000], y[:4000])
    assert ((model.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.9


def test_scores_are_sums_of_bins():
    rng = np.random.default_rng(4)
    x, y = rng.random((500, 3)), (rng.random(500) > 0.4).astype(float)
    model = quality.fit(x, y)
    for row, score in zip(x[:20], model.score(x[:20]), strict=True):
        total = model.base + sum(t[np.searchsorted(c, v, side="right")] for t, c, v in zip(model.tables, model.cuts, row, strict=True))
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[np.searchsorted(model.coarse[a], row[a], side="right"), np.searchsorted(model.coarse[b], row[b], side="right")]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-12


def test_operator_cases(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "A b c.", 3), (2, "A b c.", 3)], "doc_id long, text string, quality_score int").withColumnRenamed("quality_score", "y")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.score_documents(docs, model).collect()
    assert len(out) == 4 and all(0 <= r.quality_score <= 1 for r in out)
    none = quality.train(docs, labels.limit(0))
    assert all(abs(r.quality_score - quality.PRIOR) < 1e-9 for r in quality.score_documents(docs, none).collect())
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    from quillspark.llm.queries import op10_quality_classifier

    import os
    import pytest

    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("no test data")
    scored = op10_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.97
    clean = rows[rows.quality == 1]
    assert clean.predicted.mean() > 0.99


def plain_score(model, text):
    """The score from the definition, table by table."""
    x = quality.features_of(text)
    total = model.base
    for value, cuts, table in zip(x, model.cuts, model.tables, strict=True):
        total += table[sum(1 for c in cuts if value >= c)]
    for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
        total += table[sum(1 for c in model.coarse[a] if x[a] >= c), sum(1 for c in model.coarse[b] if x[b] >= c)]
    return 1 / (1 + np.exp(-total))


def test_whole_query_against_plain_scores_and_clashing_names(spark):
    texts = [None, "", "word " * 400_000, "One plain sentence.", "one plain sentence.", "$$$ || BUY !!! " * 9] + [f"Text {i}, of {i % 7} kinds. " * (1 + i % 5) for i in range(60)]
    rows = [(i, t, 0.5, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Quality_Score double, score string")
    labels = spark.createDataFrame([(i, int(i % 7 > 2), 0) for i in range(6, 66)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    assert out[0].__fields__ == ["doc_id", "text", "score", "quality_score"] and out[0].score == "x"
    assert out[0].quality_score == out[1].quality_score
    for i, t in enumerate(texts):
        assert abs(out[i].quality_score - plain_score(model, t)) < 1e-12
