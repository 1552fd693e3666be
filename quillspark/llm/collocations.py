"""Phrase collocations by hierarchical pair naming.

Texts become blocks of word numbers.  Frequent words get names; then, level by level, neighbouring names of frequent
phrases of k - 1 words are counted as pairs, the frequent pairs get names of their own, and names replace the pairs: the
name at a place stands for the phrase of k words that starts there.  A phrase of k words is frequent only if both its
parts of k - 1 words are, so no frequent phrase is missed, and nothing else is ever counted.  The pair that a name stands
for holds its parents: the counts before and after each cut are read off along them, and a phrase is inside a longer one
exactly if it is a parent of it or of something inside it.

Pairs are counted per block, merged by Spark, and named by a join over the whole corpus.  Names go back to the blocks by
look-up where they are at most ``BROADCAST_NAMES``, beyond that by a join with the distinct pairs of each block.  A block
holds ``BLOCK`` words of one language; a longer text is cut into blocks that look a few words ahead, and a phrase belongs
to the block in which it starts.

Words: A-Z lower-cased, pieces end at ``.,;:!?`` and line ends, words at spaces and tabs; no phrase leaves its piece.

Defined cases: a null text is empty and has no words; a null language is ``und``; repeated rows count each time; a table
without frequent phrases gives no rows; texts may be of any length, also without any end of a piece; other columns, whatever
their names, take no part; ties in rank are broken by count, then by the bytes of the phrase, so that ranks are unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize
from quillspark.scratch import drop_range, drop_since, ordinals, written

BLOCK = 1_000_000  # words
BROADCAST_NAMES = 1_000_000  # of two numbers or a word, and a number
LONGEST = 4
SCALE = 2_000_000

#: What ends a piece, and what ends a word.
_PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_WORD_ENDS = b"\x20\x09"
_BYTES = bytes(
    10 if c in _PIECE_ENDS else 32 if c in _WORD_ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_END, _NONE = 0, -1  # numbers of an end of a piece, and of nothing between two spaces

_BLOCKS = "block long, lang string, own long, width int, codes binary, words array<string>, counts array<long>"
_NAMED = "block long, lang string, own long, width int, ids binary"


class _Codes(dict):
    """Numbers of words within a block, from 1."""

    def __init__(self) -> None:
        super().__init__({b"\n": _END, b"": _NONE})

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self) - 1
        return found


def _coded(text: bytes, codes: _Codes) -> np.ndarray:
    found = text.translate(_BYTES).replace(b"\n", b" \n ").split(b" ")
    out = np.fromiter(map(codes.__getitem__, found), np.int32, len(found))
    return np.append(out[out != _NONE], np.int32(_END))


class _Buffer:
    """Words of one language, until they fill a block."""

    def __init__(self) -> None:
        self.codes, self.parts, self.size = _Codes(), [], 0

    def row(self, number: int, lang: str, own: int | None = None) -> dict:
        every = np.concatenate(self.parts)
        own = len(every) if own is None else own
        counts = np.bincount(every[:own], minlength=len(self.codes) - 1)[1:]
        words = [w for w, c in self.codes.items() if c > 0]
        return {"block": number, "lang": lang, "own": own, "codes": every, "words": [w.decode("utf-8", "replace") for w in words], "counts": counts.tolist()}


def _blocks(block: int, ahead: int):
    schema = pa.schema(
        [("block", pa.int64()), ("lang", pa.string()), ("own", pa.int64()), ("width", pa.int32()), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[str, _Buffer] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                buffer = held.setdefault(lang, _Buffer())
                new = _coded(text.as_py(), buffer.codes)
                if len(new) > block:  # a long text: blocks of its own
                    alone = _Buffer()
                    whole = _coded(text.as_py(), alone.codes)
                    for at in range(0, len(whole), block):
                        alone.parts = [whole[at : at + block + ahead]]
                        row = alone.row(base + made, lang, min(block, len(whole) - at))
                        yield pa.RecordBatch.from_pylist([_used(row)], schema)
                        made += 1
                    new = new[:0]
                buffer.parts.append(new)
                buffer.size += len(new)
                if sum(b.size for b in held.values()) >= block:
                    for name, b in held.items():
                        yield pa.RecordBatch.from_pylist([_used(b.row(base + made, name))], schema)
                        made += 1
                    held = {}
        for name, b in held.items():
            if b.size:
                yield pa.RecordBatch.from_pylist([_used(b.row(base + made, name))], schema)
                made += 1

    return run


def _used(row: dict) -> dict:
    """A block's row with the words only that stand in it (a long text's blocks share one list of words)."""
    codes = row["codes"]
    used = np.unique(codes)
    used = used[used > 0]
    again = np.zeros(len(row["words"]) + 1, np.int32)
    again[used] = np.arange(1, len(used) + 1)
    width, packed = _packed(again[codes])
    return row | {"width": width, "codes": packed, "words": [row["words"][i - 1] for i in used], "counts": [row["counts"][i - 1] for i in used]}


_TYPES = {2: np.uint16, 4: np.int32, 8: np.int64}


def _packed(ids: np.ndarray) -> tuple[int, bytes]:
    """Numbers from 0 in the narrowest type that holds them."""
    most = ids.max(initial=0)
    width = 2 if most < 2**16 else 4 if most < 2**31 else 8
    return width, ids.astype(_TYPES[width]).tobytes()


def _unpacked(width: int, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, _TYPES[width]).astype(np.int64)


def _out(rows: list[tuple[int, str, int, np.ndarray]]) -> pa.RecordBatch:
    packed = [_packed(r[3]) for r in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.string()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([p[0] for p in packed], pa.int32()),
            pa.array([p[1] for p in packed], pa.binary()),
        ],
        ["block", "lang", "own", "width", "ids"],
    )


def _word_names(table):
    """Blocks of word numbers to blocks of names; ``table``: a broadcast (lang, word, id), or None where each row has
    the places and ids of its own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number, lang, own, width, codes = (batch.column(k)[i].as_py() for k in range(5))
                words = batch.column(5)[i].values
                names = np.zeros(len(words) + 1, np.int64)
                if table is None:
                    at, ids = batch.column(6)[i], batch.column(7)[i]
                    if at.is_valid:
                        names[at.values.to_numpy() + 1] = ids.values.to_numpy()
                else:
                    if lang not in known:
                        known[lang] = table.value.filter(pc.equal(table.value["lang"], lang)).combine_chunks()
                    own_names = known[lang]
                    found = pc.index_in(words, value_set=own_names["word"])
                    ok = found.is_valid().to_numpy(zero_copy_only=False)
                    names[1:][ok] = own_names["id"].to_numpy()[found.drop_null().to_numpy()]
                yield _out([(number, lang, own, names[_unpacked(width, codes)])])

    return run


def _pairs(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of neighbours with names: left, right, count among the first ``end`` places, the places of all
    pairs, and which distinct pair stands there."""
    if len(ids) < 2:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    values, local = np.unique(ids, return_inverse=True)
    places = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    keys, which = np.unique(local[places] * len(values) + local[places + 1], return_inverse=True)
    counts = np.bincount(which[places < end], minlength=len(keys))
    return values[keys // len(values)], values[keys % len(values)], counts, places, which


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            number, _, own, width, ids = (batch.column(k)[i].as_py() for k in range(5))
            x, y, n, _, _ = _pairs(_unpacked(width, ids), own)
            for at in range(0, len(x), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x[part]), number)), pa.array(x[part]), pa.array(y[part]), pa.array(n[part])], ["block", "x", "y", "n"]
                )


class _Names:
    """Look-up of pairs among named ones."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        self.left, at_x = np.unique(x, return_inverse=True)
        self.right, at_y = np.unique(y, return_inverse=True)
        key = at_x * len(self.right) + at_y
        order = np.argsort(key)
        self.key, self.ids = key[order], ids[order]

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(self.ids) or not len(x):
            return np.zeros(len(x), np.int64)
        at_x = np.minimum(np.searchsorted(self.left, x), len(self.left) - 1)
        at_y = np.minimum(np.searchsorted(self.right, y), len(self.right) - 1)
        key = at_x * len(self.right) + at_y
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found = (self.left[at_x] == x) & (self.right[at_y] == y) & (self.key[at] == key)
        return np.where(found, self.ids[at], 0)


def _pair_names(table):
    """Replaces the names of a block by those of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None if table is None else _Names(*[table.value[c].to_numpy() for c in ("x", "y", "id")])
        for batch in batches:
            for i in range(batch.num_rows):
                number, lang, own, width, packed = (batch.column(k)[i].as_py() for k in range(5))
                ids = _unpacked(width, packed)
                x, y, _, places, which = _pairs(ids, own)
                if table is None:
                    own_names = [batch.column(k)[i] for k in (5, 6, 7)]
                    names = _Names(*[v.values.to_numpy() if v.is_valid else np.zeros(0, np.int64) for v in own_names])
                out = np.zeros(len(ids), np.int64)
                out[places] = names.of(x, y)[which]
                yield _out([(number, lang, own, out)])

    return run


def _sent(df: DataFrame, n: int, *columns: str):
    """The columns as a broadcast Arrow table where they are few, else None."""
    if n > BROADCAST_NAMES:
        return None
    return df.sparkSession.sparkContext.broadcast(df.select(*columns).toArrow())


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_NAMES else df


def phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = LONGEST, share: int = 80) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to ``longest`` words with a count of ``least`` or more, and the words of each language.

    Phrases: lang, phrase, k (words), a (count), l and r (counts before and after the lowest-scoring cut), cut, score, and
    ``subsumed``: whether a longer one holds it and has ``share`` per cent of its count.  Words: lang, n.
    """
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    start = written()
    blocks = materialize(read.mapInArrow(_blocks(BLOCK, longest - 1), _BLOCKS), "word-blocks")
    counted = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word"))
    counted = materialize(counted.agg(F.sum("w.counts").alias("f")), "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = ordinals(counted.where(F.col("f") >= least), [F.col("lang"), F.col("word")], "id")
    words = materialize(frequent.withColumn("id", F.col("id") + 1), "words")
    n_words = words.count()
    table = _sent(words, n_words, "lang", "word", "id")
    named = blocks
    if table is None:
        own = blocks.select("block", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
        own = own.groupBy("block").agg(F.collect_list("at").cast("array<long>").alias("at"), F.collect_list("id").alias("ids"))  # a block's words
        named = blocks.join(own, "block", "left")
    named = named.select("block", "lang", "own", "width", "codes", "words", *([] if table else ["at", "ids"]))
    named = materialize(named.mapInArrow(_word_names(table), _NAMED), "named-1")
    drop_range(spark, start, start + 1)  # the blocks of word numbers
    mark = written() - 1
    one = F.array("f")
    level = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", one.alias("heads"), one.alias("tails"))
    n_level, levels, at = n_words, [], mark
    for k in range(2, longest + 1):
        pairs = named.mapInArrow(_count_pairs, "block long, x long, y long, n long")
        found = materialize(_frequent(pairs, n_level, least), f"frequent-{k}")
        found = ordinals(found, [F.col("x"), F.col("y")], "id").withColumn("id", F.col("id") + 1)
        found = materialize(found, f"pairs-{k}")
        left = _few(level.select(F.col("id").alias("x"), "lang", F.col("phrase").alias("head"), "heads"), n_level)
        right = _few(level.select(F.col("id").alias("y"), "last", "tails"), n_level)
        grown = found.join(left, "x").join(right, "y")
        level = grown.select(
            "id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f",
            F.concat("heads", F.array("f")).alias("heads"), F.concat(F.array("f"), "tails").alias("tails"), "x", "y", F.arrays_zip("heads", "tails").alias("cuts"),
        )
        level = materialize(level, f"phrases-{k}")
        n_level = level.count()
        levels.append((k, level))
        if not n_level:
            break
        if k < longest:
            table = _sent(found, n_level, "x", "y", "id")
            if table is None:
                own = pairs.select("block", "x", "y").join(found.select("x", "y", "id"), ["x", "y"])
                own = own.groupBy("block").agg(*[F.collect_list(c).alias(f"own_{c}") for c in ("x", "y", "id")])  # a block's pairs
                named = named.join(own, "block", "left").select("block", "lang", "own", "width", "ids", "own_x", "own_y", "own_id")
            named = materialize(named.mapInArrow(_pair_names(table), _NAMED), f"named-{k}")
            drop_range(spark, at, at + 1)  # the names of the level before
            at = written() - 1
    parts = []
    for at, (k, level) in enumerate(levels):
        scored = level.select("id", "lang", "phrase", F.lit(k).alias("k"), F.col("f").alias("a"), _lowest_cut().alias("c"))
        if at + 1 < len(levels):
            longer = levels[at + 1][1]
            inside = longer.select(F.explode(F.array("x", "y")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("above"))
            scored = scored.join(inside, "id", "left")
        else:
            scored = scored.withColumn("above", F.lit(None).cast("long"))
        covered = F.col("above").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share
        parts.append(scored.select("lang", "phrase", "k", "a", "c.l", "c.r", F.col("c.cut").alias("cut"), "c.score", F.coalesce(covered, F.lit(False)).alias("subsumed")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    totals, out = materialize(totals, "word-totals"), materialize(out, "phrases")
    drop_since(spark, start, 2)  # all but these rows
    return out, totals


def _frequent(pairs: DataFrame, names: int, least: int) -> DataFrame:
    """(x, y, f) of the pairs that occur often enough, counted by one number where two names fit into one."""
    if (names + 1) ** 2 >= 2**63:
        return pairs.groupBy("x", "y").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    key = (F.col("x") * (names + 1) + F.col("y")).alias("key")
    counted = pairs.groupBy(key).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return counted.select(F.expr(f"key div {names + 1}L").alias("x"), (F.col("key") % (names + 1)).alias("y"), "f")


def _lowest_cut():
    """The cut with the lowest score, the first of equal ones, in exact arithmetic."""
    score = f"(cast(f as decimal(20,0)) * {SCALE}) div (cast(c.heads as decimal(20,0)) + cast(c.tails as decimal(20,0)))"
    return F.expr(f"array_min(transform(cuts, (c, i) -> struct({score} as score, i + 1 as cut, c.heads as l, c.tails as r)))")


def collocations(docs: DataFrame, *, top: int = 2000, **options) -> DataFrame:
    """Each language's ``top`` phrases that no longer one subsumes, by score, count and phrase: lang, rank, phrase, a, l, r,
    n, score, k and cut."""
    found, totals = phrases(docs, **options)
    # numbered over ranges of the order, so that no task holds a language
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    numbered = materialize(ordinals(found.where(~F.col("subsumed")), order, "nth"), "numbered")
    first = numbered.groupBy("lang").agg(F.min("nth").alias("first"))
    ranked = numbered.join(first.join(totals, "lang"), "lang").withColumn("rank", F.col("nth") - F.col("first") + 1).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k", "cut")
