import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from quillspark.llm import repeats
from quillspark.llm.suffixes import suffix_array


def brute(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept digest) per text, by counting every window."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    make = lambda n: " ".join(word() for _ in range(n))
    shared = [make(60) for _ in range(6)]
    texts = [None, "", "short", make(30)[:199], shared[0], shared[0], "ab" * 400, "a" * 1000, "a" * 199, "a" * 200]
    texts += [make(40) + shared[1] + make(30) + shared[1] + make(5), shared[2][:150] + make(40), make(10) + shared[3][:200] + "x", "y" + shared[3][:200], shared[3][:201]]
    for _ in range(60):
        s = rng.choice(shared)
        i = rng.randrange(len(s))
        texts.append(make(rng.randint(0, 60)) + s[i : i + rng.randint(150, 420)] + make(rng.randint(0, 60)))
    base = make(150)
    for _ in range(20):
        i = rng.randrange(len(base))
        texts.append(base[:i] + word() + base[i + 3 :])
    return texts


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key_a string")
    out = repeats.remove_repeats(df).orderBy("doc_id").collect()
    for r, want, t in zip(out, brute(texts), texts, strict=True):
        assert tuple(r.repeats) == want, t
        assert hashlib.sha256(bytes(r.kept_bytes)).hexdigest() == want[3] and r.key_a == "x"


def test_against_brute_force(spark):
    check(spark, corpus(random.Random(1)))


def test_crowded_anchors_and_small_steps(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWDED", 3)
    monkeypatch.setattr(repeats, "CHUNK", 500)
    monkeypatch.setattr(repeats, "SORTED_BYTES", 2000)
    check(spark, corpus(random.Random(2)))
    monkeypatch.setattr(repeats, "CROWDED", 0)
    check(spark, corpus(random.Random(3)))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(df).count() == 0


@pytest.mark.parametrize("depth", [None, 1, 2, 3, 5, 9, 30])
def test_suffix_order(depth):
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = rng.integers(1, rng.integers(2, 5), rng.integers(0, 60))
        order = suffix_array(text, depth).tolist()
        assert sorted(order) == list(range(len(text)))
        tails = [text[i:].tolist()[:depth] for i in order]
        assert tails == sorted(tails)


def test_every_window_has_an_anchor_of_its_least_hash():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 255, 3000), rng.integers(0, 2, 2000), np.zeros(2000), np.tile([1, 2, 3], 700)):
        data = data.astype(np.uint8)
        place, h, _ = repeats.anchors(data, 200)
        hashes = repeats.gram_hashes(data, repeats.GRAM)
        assert (hashes[place] == h).all()
        for i in range(len(data) - 199):
            own = hashes[i : i + 200 - repeats.GRAM + 1].min()
            inside = (place >= i) & (place <= i + 200 - repeats.GRAM)
            assert (h[inside] == own).any()
        assert len(place) < len(data) // 8


def test_crowded_periodic_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWDED", 3)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 0)
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        unit = rng.choice(["ab", "abc", "a", "abcdefgh" * 9])
        texts.append(rng.choice(["", "xy", "0123"]) + (unit * 600)[rng.randrange(9) : rng.randrange(150, 700)] + rng.choice(["", "z", str(rng.random())]))
    check(spark, texts)


@pytest.mark.parametrize("n", [400, 800])
def test_a_passage_that_many_documents_share_is_no_group(spark, monkeypatch, n):
    monkeypatch.setattr(repeats, "CROWDED", 20)
    rng = random.Random(n)
    words = lambda k: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(k))
    notice = words(60)
    groups = []
    real = repeats._sorted_spans
    monkeypatch.setattr(repeats, "_sorted_spans", lambda rows, length: groups.extend(r["count"] for r in rows.groupBy("g").count().collect()) or real(rows, length))
    check(spark, [f"{words(10)} {notice} {words(10)}" for _ in range(n)])
    assert max(groups, default=0) <= 20


def test_very_long_text_and_clashing_names(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    rows = [(1, long + long[:300], "x", 1, "p"), (2, None, None, None, None), (3, "short", "y", 2, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Repeats string, kept int, spans string")
    out = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    assert out[1].__fields__ == ["doc_id", "text", "kept", "spans", "kept_bytes", "repeats"]
    assert (out[1].repeats.n_bytes, out[1].repeats.n_removed, out[1].repeats.n_spans) == (1_500_300, 600, 2)
    assert (out[1].kept, out[3].spans, out[2].kept_bytes) == (1, "q", bytearray())
