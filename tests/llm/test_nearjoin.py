import random
import re

import numpy as np
from quillspark.llm import nearjoin, shingles
from quillspark.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_strings(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = min(5, len(w))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows, roots=False):
    """Group id and number of links by row, from all pairs."""
    sets = [shingle_strings(t) for _, t in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    if roots:
        return [least.get(r) for r in {find(i) for i in range(len(rows))}]
    return [(doc, least.get(find(i)), n) for i, ((doc, _), n) in enumerate(zip(rows, links, strict=True))]


def make(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
    return " ".join(w)


def corpus(rng):
    rows = [(None, None), (1, None), (2, ""), (3, "!!"), (4, "one two"), (5, "One, TWO"), (6, "one two three")]
    base = [make(rng, rng.randint(5, 200)) for _ in range(25)]
    rows += [(100 + i, edited(rng, rng.choice(base), rng.randrange(6))) for i in range(250)]
    rows += [(100 + i, rows[20][1]) for i in range(5)] + [(None, rows[30][1]), (None, make(rng, 50))]
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, a string, n int")
    got = [(r.id, r.class_id, r.n_links) for r in nearjoin.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_against_all_pairs(spark):
    check(spark, corpus(random.Random(1)))


def test_small_blocks_and_sparse_counting(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK", 4)
    monkeypatch.setattr(nearjoin, "DENSE_CELLS", 0)
    monkeypatch.setattr(nearjoin, "PAIRS_AT_ONCE", 50)
    check(spark, corpus(random.Random(2)))


def test_exact_threshold():
    sets = [np.arange(n, dtype=np.uint64) for n in (5, 4, 3, 1)]
    i, j = np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3])
    assert nearjoin.verified(sets, i, j, 0.8).tolist() == [True, False, False, False]


def test_pruning_is_the_posterior():
    rng = np.random.default_rng(0)
    least = nearjoin.least_matches(0.8, 1e-2)
    s = rng.random(400_000)
    m = rng.binomial(16, s)
    for k, share in ((least[16], 1e-2), (least[16] - 1, 1e-2)):
        above = (s[m == k] >= 0.8).mean()
        assert (above >= share * 0.5) if k == least[16] else (above < share * 2)


def test_signatures_estimate_similarity():
    rng = random.Random(3)
    text = make(rng, 300, 5000)
    sets = [shingles.shingle_set(t) for t in (text, edited(rng, text, 6))]
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    a, b = shingles.signatures(sets, 512)
    assert abs((a == b).mean() - true) < 0.08


def test_keep_one(spark):
    rows = [(r[0], r[1]) for r in corpus(random.Random(4))]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key_a int")
    kept = nearjoin.keep_one(df)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted(brute(rows, roots=True), key=str)
    assert nearjoin.keep_one(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(205, 204), (204, 203), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 203: 203, 204: 203, 205: 203}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_very_long_text_and_clashing_names(spark):
    long = " ".join(str(i) for i in range(150_000))
    rows = [(1, long, "x", 1), (2, long + " more", "y", 2), (3, None, "z", 3), (None, long, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string, root int")
    out = {r.id: (r.class_id, r.n_links) for r in nearjoin.near_duplicates(df).collect()}
    assert out == {1: (1, 2), 2: (1, 2), None: (1, 2), 3: (3, 0)}
    kept = nearjoin.keep_one(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.class_id, r.root) for r in kept] == [(1, "x", 1), (3, "z", 3)]


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "BROADCAST_ROWS", 0)
    rows = [(i, " ".join(f"w{j}" for j in range(40)) + (" end" if i % 3 else "")) for i in range(30)] + [(99, "one of its own, with words enough")]
    out = {r.id: (r.class_id, r.n_links) for r in nearjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: (0, 29) for i in range(30)} | {99: (99, 0)}
