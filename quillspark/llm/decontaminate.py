"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``span`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.
Both sides keep, for every ``span`` consecutive words, the least hash of the ``gram``-word runs inside: two equal
windows have the same least hash, so every shared window shares a fingerprint.  Items shorter than ``span`` are
matched on the hash of the whole item against all runs of as many words; the work for that is done only for
lengths that occur.  Texts with a shared fingerprint are read again, and each of their windows with such a
fingerprint is extended to its words and joined with the benchmark windows of the same words.

Fingerprints of the benchmark are broadcast only when their counted number is within ``BROADCAST_WINDOWS``;
beyond that a blocked Bloom filter of them is, and the same joins shuffle what it lets pass: fingerprints, and windows
cut from texts with a fingerprint of the benchmark, never a text for each of its places.

Defined cases: null texts and texts without words have no windows and no hits; repeated rows and copies of a text
share one result; items that repeat or share windows are all reported; a null item id counts as no item, though its
windows hit; with no items nothing is hit; columns of ``docs`` are kept whatever their names, the result is in one
struct column, and takes the place of a column of that name; a text of any length is judged whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, materialize, numbered, text_key
from quillspark.llm.urlfilter import bloom_filter, may_hold

BROADCAST_WINDOWS = 500_000  # of at most ``span`` words each
BROADCAST_SUSPECTS = 500_000  # of two numbers
BROADCAST_TEXTS, BROADCAST_CHARS = 100_000, 16_000_000  # texts with hits, and the characters of their items
#: Words before lower-casing A-Z: the same words, as capitals are no bounds either way.  Java matches a class of
#: listed ranges several times faster than the equal class of all others.
CASED_WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CASED_WORD), F.lit(0))


def _lowered(word: Column) -> Column:
    """A word with A-Z lower-cased.  The full mapping does just that to words in ASCII, and is faster; in others it
    would depend on the letters around."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(ascii_lower(word))


def _window(w: Column, at: Column, length: Column) -> Column:
    """The words of a window as one string, A-Z lower-cased."""
    return ascii_lower(F.concat_ws(" ", F.slice(w, at + 1, length)))


def _run_hash(h: Column, length: int) -> Column:
    """Hash of each run of ``length`` words, from the words' hashes."""
    runs = F.transform(h, lambda x, i: F.xxhash64(F.lit(length), x, *[F.get(h, i + k) for k in range(1, length)]))
    return F.slice(runs, 1, F.greatest(F.size(h) - (length - 1), F.lit(0)))


def _least(g: Column, width: int) -> Column:
    least = F.transform(g, lambda x, i: F.least(x, *[F.get(g, i + k) for k in range(1, width)]) if width > 1 else x)
    return F.slice(least, 1, F.greatest(F.size(g) - (width - 1), F.lit(0)))


def _starts(prints: Column, length: int) -> Column:
    return F.transform(prints, lambda p, s: F.struct(p.alias("print"), s.alias("start"), F.lit(length).alias("length")))


def _prints(df: DataFrame, lengths: list[int], span: int, gram: int) -> DataFrame:
    """Adds ``prints``: an array by window length, of the fingerprints by window start, from a text ``t``."""
    df = df.withColumn("h", F.transform(_words(F.col("t")), lambda x: F.xxhash64(_lowered(x))))
    if span in lengths:
        df = df.withColumn("g", _run_hash(F.col("h"), gram)).withColumn("m", _least(F.col("g"), span - gram + 1))
    parts = [F.col("m") if n == span else _run_hash(F.col("h"), n) for n in lengths]
    return df.withColumn("prints", F.array(*parts))


def benchmark_windows(items: DataFrame, item_id: str, item_text: str, span: int, gram: int) -> tuple[DataFrame, list[int]]:
    """(item, print, words, length) per window of the items, and the lengths of windows that occur."""
    read = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("t"), _words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    sizes = read.select(F.least(F.size("w"), F.lit(span)).alias("n")).distinct().collect()  # at most ``span`` rows
    lengths = sorted(r.n for r in sizes)
    parts = []
    for n in lengths:
        own = read.where(F.size("w") >= span if n == span else F.size("w") == n)
        own = _prints(own, [n], span, gram).select("item", "w", F.posexplode(F.col("prints")[0]).alias("at", "print"))
        parts.append(own.select("item", "print", _window(F.col("w"), F.col("at"), F.lit(n)).alias("window"), F.lit(n).alias("length")))
    if not parts:
        return read.select("item", F.lit(0).cast("long").alias("print"), F.lit("").alias("window"), F.lit(0).alias("length")).limit(0), []
    return reduce(DataFrame.unionByName, parts).distinct(), lengths


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = 10,
    gram: int = 5,
) -> DataFrame:
    """(key_a, key_b, start, length, item) for every benchmark window in every distinct text of ``docs``."""
    found, lengths = benchmark_windows(items, item_id, item_text, span, gram)
    windows = materialize(found, "windows")
    if not lengths:
        return docs.select(*text_key(F.col(text_col)), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("item")).limit(0)
    small = windows.count() <= BROADCAST_WINDOWS
    sent = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    shortest = min(lengths)
    read = docs.select(*text_key(F.col(text_col)), F.col(text_col).alias("t"))
    prints = _prints(read, lengths, span, gram).where(F.size("h") >= shortest)
    prints = prints.select("key_a", "key_b", F.explode(F.array_distinct(F.flatten("prints"))).alias("print"))
    if not small:
        known_prints = windows.select(F.col("print").alias("key_hash")).distinct()
        bits, blocks = bloom_filter(known_prints, known_prints.count())
        bits = materialize(bits, "print-filter")  # one row of at most FILTER_BLOCKS words
        prints = prints.crossJoin(F.broadcast(bits)).where(may_hold(F.col("bits"), F.col("print"), blocks)).drop("bits")
    suspects = prints.join(sent(windows.select("print").distinct()), "print", "left_semi").select("key_a", "key_b").distinct()
    suspects = materialize(suspects, "suspects")
    again = read.join(F.broadcast(suspects) if suspects.count() <= BROADCAST_SUSPECTS else suspects, ["key_a", "key_b"], "left_semi")
    again = _prints(again.withColumn("w", _words(F.col("t"))), lengths, span, gram)
    starts = F.flatten(F.array(*[_starts(F.col("prints")[i], n) for i, n in enumerate(lengths)]))
    if small:
        placed = again.select("key_a", "key_b", "w", F.explode(starts).alias("x")).select("key_a", "key_b", "w", "x.print", "x.start", "x.length")
        placed = placed.join(sent(windows.select("print", "length").distinct()), ["print", "length"], "left_semi")
        placed = placed.select("key_a", "key_b", "print", "start", "length", _window(F.col("w"), F.col("start"), F.col("length")).alias("window"))
    else:  # windows are cut where the words are at hand, for what the filter lets pass
        cut = lambda x: F.struct(x["print"].alias("print"), x["start"].alias("start"), x["length"].alias("length"), _window(F.col("w"), x["start"], x["length"]).alias("window"))
        passing = F.filter(starts, lambda x: may_hold(F.col("bits"), x["print"], blocks))
        placed = again.crossJoin(F.broadcast(bits)).select("key_a", "key_b", F.inline(F.transform(passing, cut))).distinct()
    hits = placed.join(sent(windows), ["print", "length", "window"])
    return hits.select("key_a", "key_b", "start", "length", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, *, text_col: str = "text", info_col: str = "contamination", **options) -> DataFrame:
    """``docs`` with a struct column ``contamination``: n_words, n_hit (words in any hit) and the hitting items."""
    hits = find_hits(docs, items, text_col=text_col, **options)
    places = F.transform(F.col("runs"), lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1))
    per_text = hits.groupBy("key_a", "key_b").agg(
        F.collect_set(F.struct("start", "length")).alias("runs"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")
    )
    per_text = per_text.select(
        F.col("key_a").alias("hit_a"), F.col("key_b").alias("hit_b"), F.size(F.array_distinct(F.flatten(places))).cast("long").alias("n_hit"), "items"
    )
    # a table of its own, so that the join below is between two plain shuffles, where a hot text is split, or a broadcast
    per_text = materialize(per_text, "hits")
    bound = per_text.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.array_join("items", ","))).alias("chars")).first()
    if bound.n <= BROADCAST_TEXTS and (bound.chars or 0) <= BROADCAST_CHARS:
        per_text = F.broadcast(per_text)
    held, names, kept = numbered(docs, info_col)
    text = F.col(names[docs.columns.index(text_col)])
    key_a, key_b = text_key(text)
    n_words = F.coalesce(F.regexp_count(text, F.lit(CASED_WORD)), F.lit(0)).cast("long")
    read = held.select(*[n for n, _ in kept], key_a, key_b, n_words.alias("n_words"))
    joined = read.join(per_text, (F.col("key_a") == F.col("hit_a")) & (F.col("key_b") == F.col("hit_b")), "left")
    result = F.struct(
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return joined.select(*[F.col(n).alias(c) for n, c in kept], result.alias(info_col))
