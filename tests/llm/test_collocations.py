import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quillspark.llm import collocations


def brute(rows, least, top, longest=4):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[words[i : i + k]] += 1
    out = []
    for lang, f in counts.items():
        candidates = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        rows = []
        for g, a in candidates.items():
            longer = [h for h in candidates if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * candidates[h] >= 80 * a for h in longer):
                continue
            score, _, l, r = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "B", "c", "é", "D.", "e,", "f\tg", "h\n", "\xa0i", "j  k", "ab", "Ab"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(0, 40)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), ("fr", "one two"), ("en", "a B c a B c " * 30), ("en", "x"), ("en", " \t "), ("en", "...")] + rows[:3]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(l, t, 1, 2) for l, t in rows], "lang string, text string, block int, Phrase int").repartition(3)
    return sorted(tuple(r)[:8] for r in collocations.collocations(docs, **options).collect())


@pytest.mark.parametrize(("names", "block"), [(10**6, 10**6), (0, 50), (10**6, 7)])
def test_equals_brute_force(spark, monkeypatch, names, block):
    monkeypatch.setattr(collocations, "BROADCAST_NAMES", names)
    real = collocations._blocks
    monkeypatch.setattr(collocations, "_blocks", lambda _, ahead: real(block, ahead))
    rows = texts(block)
    for top in (2000, 4) if block == 50 else (2000,):
        assert found(spark, rows, least=4, top=top) == brute(rows, 4, top)


def test_a_long_text_without_an_end_and_exact_products(spark, monkeypatch):
    real = collocations._blocks
    monkeypatch.setattr(collocations, "_blocks", lambda _, ahead: real(1000, ahead))
    rows = [("en", "u v " * 20_000 + "w")]
    out = found(spark, rows, least=30)
    assert out == brute(rows, 30, 2000) and out[0][3] >= 19_998
    grams = spark.createDataFrame([(9 * 10**12, [9 * 10**12], [9 * 10**12 + 1])], "f long, heads array<long>, tails array<long>")
    cut = grams.select("f", F.arrays_zip("heads", "tails").alias("cuts")).select(collocations._lowest_cut().alias("c")).first().c
    assert (cut.score, cut.cut) == (2_000_000 * 9 * 10**12 // (18 * 10**12 + 1), 1)


def test_names_of_any_size():
    import numpy as np

    ids = np.array([2**40, 2**41, 0, 2**40, 2**41, 2**41])
    assert [collocations._packed(np.array(x))[0] for x in ([], [65_535], [65_536], [2**31])] == [2, 2, 4, 8]
    assert (collocations._unpacked(*collocations._packed(ids)) == ids).all()
    x, y, n, places, which = collocations._pairs(ids, 4)
    assert sorted(zip(x, y, n, strict=True)) == [(2**40, 2**41, 2), (2**41, 2**41, 0)] and list(places) == [0, 3, 4]
    names = collocations._Names(np.array([2**40]), np.array([2**41]), np.array([2**42]))
    assert list(names.of(x, y)[which]) == [2**42, 2**42, 0]


def test_pairs_of_more_names_than_one_number_holds(spark):
    pairs = spark.createDataFrame([(2**40, 5, 3), (2**40, 5, 4), (7, 2**41, 1)], "x long, y long, n long")
    assert [tuple(r) for r in collocations._frequent(pairs, 2**42, 7).collect()] == [(2**40, 5, 7)]
    assert [tuple(r) for r in collocations._frequent(pairs.where("x < 10 and y < 10 or n < 5").selectExpr("x % 1000 + 1 as x", "y % 1000 + 1 as y", "n"), 1000, 7).collect()] == [(777, 6, 7)]


def test_empty_and_nothing_frequent(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).collect() == []
    assert found(spark, [("en", "a b c"), (None, None)]) == []
