"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins; a score is a sum of table entries, one per feature and one per chosen pair
of features, put through the logistic function.  The tables are learned by cyclic boosting: in each round every
feature in turn (then every pair) gets one shallow tree of at most four leaves, fitted to the gradient on that
feature's (pair's) histogram and added to its table with a small step.

Learning takes at most ``MAX_TRAINING_ROWS`` labelled rows, those with the least hash of their id, so the driver
holds a bounded table however large the corpus is.  Features are computed on whole texts, on the executors; scoring
adds table entries for whole Arrow batches.

Defined cases: a null text is scored like an empty one, which gets a score; rows whose label is null are not learned
from; repeated rows get equal scores; a null id is never held out; without any labelled rows all scores are
``PRIOR``; texts may be of any length; columns of ``docs`` with any names pass through ``score_documents``, but for one
that is called like the score, which takes its place; an empty table stays empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import numbered

MAX_TRAINING_ROWS = 20_000
MAX_BINS = 32
PAIR_BINS = 8
ROUNDS = 200
PAIR_ROUNDS = 80
PAIRS = 6
STEP = 0.15
RIDGE = 1.0
PRIOR = 0.7

FEATURES = (
    "words", "chars_per_word", "distinct_words", "top_word", "short_words", "long_words", "upper", "digits", "symbols",
    "marks", "bars", "exclamations", "stops", "lines_per_word", "distinct_lines", "ends_sentence", "spaces", "capital_words",
)

_SYMBOLS = np.array([chr(b) in "#$%&*+=<>@\\^_`{}~[]" for b in range(256)])
_MARKS = np.array([chr(b) in ",;:'\"()-" for b in range(256)])


def features_of(text: str | None) -> list[float]:
    """The features of one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n, chars = max(len(words), 1), float(seen.sum())
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    return [
        float(len(words)),
        float(lengths.sum()) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        float((lengths <= 3).sum()) / n,
        float((lengths >= 15).sum()) / n,
        float(seen[65:91].sum()) / chars,
        float(seen[48:58].sum()) / chars,
        float(seen[_SYMBOLS].sum()) / n,
        float(seen[_MARKS].sum()) / n,
        float(seen[124]) / n,
        float(seen[33]) / n,
        float(seen[46] + seen[63]) / n,
        len(lines) / n,
        len(set(lines)) / max(len(lines), 1),
        1.0 if text.rstrip().endswith((".", "!", "?")) else 0.0,
        float(seen[32]) / n,
        sum(1 for w in counts if w[:1].isupper()) / max(len(counts), 1),
    ]


def feature_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """``cuts`` by feature; ``tables`` by feature; ``pairs`` of features with their coarse cuts and tables."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            at_a = np.searchsorted(self.coarse[a], x[:, a], side="right")
            total += table[at_a, np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-total))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(values) else np.zeros(0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of one cut of a histogram, and the cut; (0, 0) if none helps."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + RIDGE))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two on one histogram, as a table."""
    out = np.zeros(len(g))
    _, at = _split(g, h)
    for low, high in ((0, at), (at, len(g))) if at else ((0, len(g)),):
        _, cut = _split(g[low:high], h[low:high])
        for a, b in ((low, low + cut), (low + cut, high)) if cut else ((low, high),):
            out[a:b] = _leaf(g[a:b], h[a:b])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Cut one feature of a two-way histogram, then each half by the other; the better order of the two."""
    best, gained = np.zeros(g.shape), -1.0
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        out, total = np.zeros(gg.shape), 0.0
        rows = range(1, gg.shape[0])
        halves = max(
            ((_split(gg[:r].sum(0), hh[:r].sum(0))[0] + _split(gg[r:].sum(0), hh[r:].sum(0))[0], r) for r in rows),
            default=(0.0, 0),
        )
        parts = ((0, halves[1]), (halves[1], gg.shape[0])) if halves[1] else ((0, gg.shape[0]),)
        for low, high in parts:
            gain, cut = _split(gg[low:high].sum(0), hh[low:high].sum(0))
            total += gain
            for a, b in ((0, cut), (cut, gg.shape[1])) if cut else ((0, gg.shape[1]),):
                out[low:high, a:b] = _leaf(gg[low:high, a:b], hh[low:high, a:b])
        if total > gained:
            best, gained = (out.T if turned else out), total
    return best, gained


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn a model; deterministic."""
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    mean = (float(y.sum()) + PRIOR) / (len(y) + 1)
    model = Model(float(np.log(mean / (1 - mean))), [np.zeros(0)] * width, [np.zeros(1)] * width)
    if len(y) == 0 or y.min() == y.max():
        return model
    model.cuts = [_cuts(x[:, j], MAX_BINS) for j in range(width)]
    model.coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(width)]
    bins = [np.searchsorted(model.cuts[j], x[:, j], side="right") for j in range(width)]
    coarse = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = gradient()
            n = len(model.tables[j])
            step = STEP * _tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            model.tables[j] += step
            total += step[bins[j]]

    def histogram(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        cell = coarse[a] * shape[1] + coarse[b]
        g, h = gradient()
        size = shape[0] * shape[1]
        return np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape), cell

    ranked = sorted(
        ((-_pair_tree(*histogram(a, b)[:2])[1], a, b) for a in range(width) for b in range(a + 1, width))
    )
    model.pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h, cell = histogram(a, b)
            step = STEP * _pair_tree(g, h)[0]
            model.pair_tables[k] += step
            total += step.ravel()[cell]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the labelled rows that are not held out, at most ``MAX_TRAINING_ROWS`` of them."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    usable = usable.where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    chosen = usable.orderBy(F.xxhash64("id"), "id", "y").limit(MAX_TRAINING_ROWS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", "text")  # bounded by MAX_TRAINING_ROWS

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            x = feature_rows(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    id_type = texts.schema["id"].dataType.simpleString()
    learned = rows.mapInArrow(batches, f"id {id_type}, y double, x array<double>")
    # ids that repeat in docs could exceed the bound, hence the second limit
    found = learned.orderBy("id", "y", "x").limit(MAX_TRAINING_ROWS).toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), len(FEATURES))
    return fit(x, found["y"].to_numpy(np.float64))


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "quality_score", keep_text: bool = True) -> DataFrame:
    """``docs`` with a score from 0 to 1 per row; ``keep_text=False`` leaves the text out."""
    held, names, kept = numbered(docs, score_col)
    text = names[docs.columns.index(text_col)]
    kept = [(n, c) for n, c in kept if keep_text or n != text]
    schema = T.StructType([*(held.schema[n] for n, _ in kept), T.StructField("score", T.DoubleType())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            score = model.score(feature_rows(b.column(text).to_pylist()))
            columns = [*(b.column(n) for n, _ in kept), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(n for n, _ in kept), "score"])

    return held.mapInArrow(batches, schema).toDF(*[c for _, c in kept], score_col)
