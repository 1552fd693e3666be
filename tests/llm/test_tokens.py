"""Counts against the tokenizers library's unigram model over the same pieces."""

import os
import random

import pytest
from quillspark.llm import tokens

MODEL = tokens.DEFAULT_MODEL


def library(pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    unk = next(i for i, p in enumerate(pieces) if p[0] == "<unk>")
    made = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], unk, byte_fallback=True))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


def texts():
    rng = random.Random(5)
    alphabet = "etaoin shrdlu  \n\tABC.,!éñß–漢字🙂▁<s>0x1"
    out = ["", " ", "  ", "a", " a", "the the", "\n", "🙂🙂", "漢字 x", "<s> </s>", "é" * 50, "x" * 300, "▁▁a ▁b"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(400)]
    return out


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")
def test_counts_equal_library():
    pieces = tokens.load_pieces(MODEL)
    counts, made = tokens.WordCounts(pieces), library(pieces)
    made.encode_special_tokens = True
    for text in texts():
        assert counts.text(text) == len(made.encode(text, add_special_tokens=False).ids), repr(text)


def test_ties_prefer_longest_and_unknowns_join():
    pieces = [("<unk>", 0.0, "other"), ("▁", -1.0, "normal"), ("a", -1.0, "normal"), ("aa", -2.0, "normal"), ("▁aa", -3.0, "normal")]
    counts = tokens.WordCounts(pieces)
    assert counts.text("aa") == 1  # ▁+a+a, ▁+aa and ▁aa all score -3
    assert counts.text("zz") == 2  # the mark, one joined unknown


def test_random_vocabularies_equal_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = random.Random(11)
    for _ in range(30):
        names = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        pieces = [("<unk>", 0.0, "other")] + [(n, -float(rng.randint(1, 4)), "normal") for n in sorted(names)]
        made = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], 0, byte_fallback=False))
        made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counts = tokens.WordCounts(pieces)
        for _ in range(40):
            text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 25)))
            assert counts.text(text) == len(made.encode(text).ids), (pieces, text)


def test_operator_over_nulls_and_repeats(spark):
    docs = spark.createDataFrame(
        [(1, "aa a", "x"), (1, "aa a", "x"), (None, None, "y"), (2, "", None)], "doc_id long, text string, n_tokens string"
    )
    pieces = [("<unk>", 0.0, "other"), ("▁a", -1.0, "normal"), ("a", -1.0, "normal")]
    got = sorted(tokens.count_tokens(docs, pieces).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, 3), (1, 3), (None, 0), (2, 0)], key=lambda r: f"Row(doc_id={r[0]}")
    assert tokens.count_tokens(docs.limit(0), pieces).count() == 0


def test_one_very_long_word_and_repeated_vocabularies(spark):
    pieces = [("<unk>", 0.0, "other"), ("▁", -1.0, "normal"), ("ab", -1.0, "normal"), ("a", -2.0, "normal"), ("b", -2.5, "normal")]
    others = [("<unk>", 0.0, "other"), ("▁", -1.0, "normal"), ("a", -2.0, "normal"), ("b", -2.5, "normal")]
    rows = [(1, "ab" * 500_000, "x"), (1, "ab" * 500_000, "x"), (None, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    for _ in range(2):  # a worker must not mix the vocabularies up
        assert sorted(r.n_tokens for r in tokens.count_tokens(df, pieces).collect()) == [0, 500_001, 500_001]
        assert sorted(r.n_tokens for r in tokens.count_tokens(df, others).collect()) == [0, 1_000_001, 1_000_001]
    assert tokens.count_tokens(df.limit(0), pieces).count() == 0
