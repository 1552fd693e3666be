from collections import defaultdict

import pytest
from quillspark.llm import mixing


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, place int")


def test_targets_and_caps(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3] if i % 10 else None, 0) for i in range(600)]
    out = mixing.mix_counts(make(spark, rows)).collect()
    assert len(out) == 600
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        size[r.source] += r.size
        taken[r.source] += r.size * r.n_copies
        target[r.source] = r.target
        assert r.n_copies <= 2
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-9
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 14


def water_fill(sizes, weights, total):
    capped, targets = set(), {}
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        w = sum(weights[s] for s in free)
        targets = {s: left * weights[s] / w for s in free}
        over = {s for s in free if targets[s] > 2 * sizes[s]}
        if not over:
            return targets | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


def test_targets_equal_repeated_sharing(spark):
    rows, i = [], 0
    for k, n in enumerate([3, 50, 200, 7, 120, 1, 9, 80]):
        for _ in range(n):
            rows.append((i, "a b c", f"s{k}", 0))
            i += 1
    out = mixing.mix_counts(make(spark, rows)).select("source", "target", "source_size").distinct().collect()
    sizes = {r.source: r.source_size for r in out}
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    want = water_fill(sizes, weights, 1.5 * sum(sizes.values()))
    for r in out:
        assert r.target == pytest.approx(want[r.source])


def test_same_places_whatever_the_ranges(spark, monkeypatch):
    rows = [(i * 7919 % 100003, "a b", "x" if i % 3 else "y", 0) for i in range(500)]
    docs = make(spark, rows)
    one = {r.id: r.n_copies for r in mixing.mix_counts(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 13)
    assert {r.id: r.n_copies for r in mixing.mix_counts(docs).collect()} == one


@pytest.mark.parametrize("bound", [0, 500_000])
def test_mix_repeats_rows_and_keeps_columns(spark, monkeypatch, bound):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", bound)
    rows = [(1, "a b", "x", 5), (1, "a b", "x", 5), (None, None, None, 6), (2, "", "y", 7), (3, "c", "y", None)]
    docs = make(spark, rows).withColumnRenamed("place", "size")
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    plan = mixing.mix_counts(docs).collect()
    assert got.count() == sum(r.n_copies for r in plan)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r.target == 0 for r in plan if r.source_size == 0)


@pytest.mark.parametrize("ranges", [50_000, 7])
def test_ids_that_are_no_numbers(spark, monkeypatch, ranges):
    """Places follow source, size and id, whatever the ids are and however the rows are dealt out."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    rows = [(f"id-{i * 7919 % 400:03d}" if i else None, "w " * (1 + i % 3), "ab"[i % 4 == 0], i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, place int")
    out = mixing.mix_counts(df).collect()
    seen = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.source, r["size"], r.id or "")):
        seen[r.source].append(r)
    for found in seen.values():
        each = found[0].target / found[0].source_size
        crossed, total = 0, 0.0
        for r in found:
            crossed, total = crossed + r.n_copies, total + each
            assert abs(crossed - total) <= 1
    again = {(r.id, r.source, r["size"]): r.n_copies for r in mixing.mix_counts(df.repartition(3)).collect()}
    assert again == {(r.id, r.source, r["size"]): r.n_copies for r in out}


def test_very_long_text_and_clashing_names(spark):
    rows = [(1, "word " * 400_000, "a", 1, 2), (2, "word", "a", 3, 4), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, times int, n_copies int")
    out = mixing.mix(df).collect()
    assert out and all(len(r) == 5 and (r.times, r.n_copies) == {1: (1, 2), 2: (3, 4)}[r.doc_id] for r in out)
