"""Repeated byte strings: remove what is covered by a string of ``length`` bytes that also starts elsewhere.

Texts are read as UTF-8 bytes and matches never cross them.  The suffix sort is distributed by content: every window
of ``length`` bytes contains the least hash of its ``GRAM``-byte strings, so equal windows share such an anchor, and
only the surroundings of anchors that occur more than once can hold a repeat.  Anchors with equal surroundings are
repeats without a comparison.  Those whose surroundings differ are grouped by anchor, and each group of surroundings
is sorted by the difference-cover algorithm (``suffixes``) down to ``length`` bytes; windows that agree with a
neighbour in that order are repeats.

The windows of anchors that more than ``CROWDED`` different surroundings share, as in a licence text that millions of
documents quote, are dealt out each on its own, by 128 bits, and merged where they are before they meet, so that no group
is larger than that.

Defined cases: null texts are empty; texts shorter than ``length`` lose nothing; texts may be of any length; rows that
repeat are copies of each other and lose everything of at least ``length`` bytes; results depend on the text alone;
columns of ``docs`` pass through whatever their names, but for those that are called like the results, which take their
place; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import materialize, numbered, text_key
from quillspark.llm.shingles import _mixed
from quillspark.llm.suffixes import shared_prefix, suffix_array

GRAM = 64
CHUNK = 1 << 20  # bytes of one text hashed at a time
SORTED_BYTES = 2_000_000  # surroundings sorted at a time; a group is not divided
PARTS = 10  # ranges of windows around an anchor that are judged each on its own
CROWDED = 50_000  # different surroundings of one anchor, from where their windows are dealt out
BROADCAST_ROWS = 300_000  # anchors
_BASE = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    name = f"{base}"
    if name not in _powers or len(_powers[name]) < n:
        size = max(n, 4096)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` consecutive bytes."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    return _mixed((sums[gram:] - sums[:-gram]) * _power(pow(_BASE, -1, 2**64), n))


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of every ``width`` consecutive values."""
    n = len(values) - width + 1
    pick, fill = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    size = -(-len(values) // width) * width
    padded = np.full(size, fill, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    behind = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places and hashes of anchors: places in any window of ``length`` bytes that hold its least hash.

    Which places of a window are anchors depends on the window alone, so equal windows have them alike.  Only in
    periodic text, where very many places hold the same hash, needless ones are left out; the third value tells.
    """
    width = length - gram + 1
    places: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    loose = False
    for at in range(0, max(len(data) - length + 1, 0), CHUNK):
        h = gram_hashes(data[at : at + CHUNK + length - 1], gram)
        least = _sliding(h, width, True)
        edge = np.zeros(width - 1, np.uint64)
        is_least = _sliding(np.concatenate([edge, least, edge]), width, False) == h
        found = np.nonzero(is_least)[0]
        if len(found) > 64 + 8 * len(h) // width:
            loose = True
            found = _thinned(found, h[found].tolist(), width)
        places.append(found + at)
        hashes.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), False
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first], loose


def _thinned(found: np.ndarray, values: list[int], width: int) -> np.ndarray:
    """Anchors without those whose neighbours with the same hash are in every window that they are in."""
    following, ahead = [-1] * len(found), {}
    for i in range(len(found) - 1, -1, -1):
        following[i] = ahead.get(values[i], -1)
        ahead[values[i]] = i
    kept: list[int] = []
    last: dict[int, int] = {}
    for i, (place, value) in enumerate(zip(found.tolist(), values, strict=True)):
        before, after = last.get(value), following[i]
        if before is not None and after >= 0 and found[after] - before <= width - 1:
            continue
        kept.append(place)
        last[value] = place
    return np.array(kept, np.int64)


def _bounds(place: np.ndarray, size: np.ndarray | int, length: int) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(place - (length - GRAM), 0), np.minimum(place + length, size)


def _anchor_rows(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """(h, c, key_a, key_b, place, size) per anchor of every text; c stands for its surroundings."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            out: list[tuple] = []
            for key_a, key_b, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                if len(raw) < length:
                    continue
                place, h, loose = anchors(np.frombuffer(raw, np.uint8), length)
                start, end = _bounds(place, len(raw), length)
                c = [xxhash.xxh3_64_intdigest(raw[s:e], seed=p - s) for s, e, p in zip(start.tolist(), end.tolist(), place.tolist(), strict=True)]
                n = len(place)
                out.append((h.view(np.int64), np.array(c, np.uint64).view(np.int64), np.full(n, key_a), np.full(n, key_b), place, np.full(n, len(raw)), np.full(n, int(loose))))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["h", "c", "key_a", "key_b", "place", "size", "loose"])

    read = docs.select(*text_key(F.col(text_col)), F.col(text_col).alias("text"))
    return read.mapInArrow(batches, "h long, c long, key_a long, key_b long, place long, size long, loose long")


def _surroundings(docs: DataFrame, wanted: DataFrame, text_col: str, length: int) -> DataFrame:
    """One row per entry of ``wanted``: g, the anchor it is sorted with, where it is from, its bytes, where in them the
    anchor is, and how far before the anchor windows start."""
    per_text = wanted.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("h", "place", "many", "loose")).alias("places"))
    per_text = per_text.select(F.col("key_a").alias("want_a"), F.col("key_b").alias("want_b"), "places")
    key_a, key_b = text_key(F.col(text_col))
    read = docs.select(key_a, key_b, F.col(text_col).alias("text"))
    read = read.join(per_text, (F.col("key_a") == F.col("want_a")) & (F.col("key_b") == F.col("want_b")))
    read = read.groupBy("key_a", "key_b").agg(F.first("text").alias("text"), F.first("places").alias("places"))

    names = ["g", "key_a", "key_b", "start", "many", "bytes", "anchor", "low", "high"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
    spread = length - GRAM

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            out: list[list] = [[] for _ in names]
            for key_a, key_b, text, places in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode("utf-8", "replace")
                for x in places:
                    place = x["place"]
                    first, last = max(0, place + length - len(raw)), min(spread, place)
                    start = place - last
                    row = (x["h"], key_a, key_b, start, x["many"], raw[start : place - first + length], -1 if x["loose"] else place - start, 0, spread)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    return read.mapInArrow(
        batches, "g long, key_a long, key_b long, start long, many boolean, bytes binary, anchor int, low int, high int"
    )


def _ranges(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """``low`` to ``high`` in ``n`` parts: how far before the anchor a window starts."""
    cuts = [low + (high + 1 - low) * i // n for i in range(n + 1)]
    return [(a, b - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


def sorted_repeats(parts: list[bytes], texts: np.ndarray, starts: np.ndarray, many: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(part, first, end) of the runs of windows in ``parts`` that also stand elsewhere.

    ``texts`` and ``starts`` say where a part is from, so that a window is not taken for a repeat of itself;
    ``many`` marks parts that occur more than once.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"\x00".join(parts) + b"\x00", np.uint8)
    data = raw.astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    data[ends] = 1
    begin = ends - sizes
    order = suffix_array(data, length)
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    within = np.arange(len(data)) - begin[part]
    order = order[within[order] + length <= sizes[part[order]]]  # whole windows
    if not len(order):
        return []
    same = shared_prefix(raw, order[:-1], order[1:], length)
    first = np.concatenate([[0], np.nonzero(~same)[0] + 1])
    owner = part[order]
    where = texts[owner] * (1 << 40) + starts[owner] + within[order]
    low, high = np.minimum.reduceat(where, first), np.maximum.reduceat(where, first)
    often = np.logical_or.reduceat(many[owner], first)
    repeated = np.repeat((low != high) | often, np.diff(np.concatenate([first, [len(order)]])))
    hit = np.sort(order[repeated])
    if not len(hit):
        return []
    cut = np.nonzero((np.diff(hit) != 1) | (np.diff(part[hit]) != 0))[0] + 1
    runs = zip(hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])], strict=True)
    return [(int(part[a]), int(within[a]), int(within[b]) + length) for a, b in runs]


def _sifted(group: list[tuple], length: int) -> tuple[list[tuple], list[tuple[int, int, int, int]]]:
    """What of a group of surroundings of one anchor has to be sorted, and spans that are repeats without.

    The windows around an anchor are taken in ``PARTS`` ranges by how far before it they start.  The windows of a
    range have a string in common; if that stands in one surrounding only, none of them is repeated.  If all that
    they cover stands in two, all are.  Groups with anchors of periodic text are sorted as they are.
    """
    if len(group) < 2:
        return [], []
    if any(row[6] < 0 for row in group):
        return [row[1:6] for row in group], []
    parts, cores, wholes = [], Counter(), Counter()
    for row in group:
        raw, anchor, low, high = row[5:9]
        for a, b in _ranges(low, high, min(PARTS, high - low + 1)):
            first, last = max(a, anchor + length - len(raw)), min(b, anchor)
            if first > last:
                continue
            core = (a, raw[anchor - a : anchor - b + length])
            whole = (first, last, raw[anchor - last : anchor - first + length])
            cores[core] += 1
            wholes[whole] += 1
            parts.append((row, core, whole))
    to_sort, spans, stands = [], [], set()
    for row, core, whole in parts:
        if cores[core] < 2:
            continue
        start = row[3] + row[6] - whole[1]
        if wholes[whole] > 1 and not row[4]:
            spans.append((row[1], row[2], start, start + len(whole[2])))
        if wholes[whole] == 1:
            to_sort.append((row[1], row[2], start, row[4], whole[2]))
        elif cores[core] > wholes[whole] and whole not in stands:
            stands.add(whole)  # one for all, for others to be compared with
            to_sort.append((row[1], row[2], start, True, whole[2]))
    return to_sort, spans


def _sorted_spans(rows: DataFrame, length: int) -> DataFrame:
    """(key_a, key_b, first, end) of repeats among the surroundings, group by group."""

    def settle(held: list[tuple]) -> list[tuple[int, int, int, int]]:
        key_a, key_b, start, many, parts = zip(*held, strict=True)
        ids: dict[tuple[int, int], int] = {}
        texts = np.array([ids.setdefault(k, len(ids)) for k in zip(key_a, key_b, strict=True)], np.int64)
        found = sorted_repeats(list(parts), texts, np.array(start, np.int64), np.array(many, bool), length)
        return [(key_a[p], key_b[p], start[p] + a, start[p] + e) for p, a, e in found if not many[p]]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        ready: list[tuple] = []
        size, last = 0, None

        def close() -> None:
            """The group is whole."""
            nonlocal size
            to_sort, spans = _sifted(group, length)
            ready.extend(spans)
            held.extend(to_sort)
            size += sum(len(x[4]) for x in to_sort)
            group.clear()
            if size >= SORTED_BYTES:
                ready.extend(settle(held))
                held.clear()
                size = 0

        for b in source:
            for row in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if row[0] != last:
                    close()
                    last = row[0]
                group.append(row)
            if ready:
                yield _spans(ready)
                ready.clear()
        close()
        if held:
            ready.extend(settle(held))
        yield _spans(ready)

    return rows.mapInArrow(batches, "key_a long, key_b long, first long, end long")


def _single_windows(rows: DataFrame, length: int) -> DataFrame:
    """(key_a, key_b, first, end) of the windows in surroundings that stand at more than one place, or in surroundings
    that do."""
    names = ["w_a", "w_b", "key_a", "key_b", "first", "many"]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            out: list[list] = [[] for _ in names]
            for key_a, key_b, start, many, raw in zip(*(b.column(n).to_pylist() for n in ("key_a", "key_b", "start", "many", "bytes")), strict=True):
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(len(raw) - length + 1)), np.int64).reshape(-1, 2)
                n = len(digests)
                for column, values in zip(out, (digests[:, 0], digests[:, 1], np.full(n, key_a), np.full(n, key_b), start + np.arange(n), np.full(n, many)), strict=True):
                    column.append(values)
                if sum(map(len, out[0])) >= 100_000:
                    yield windows(out)
                    out = [[] for _ in names]
            yield windows(out)

    def windows(out: list[list]) -> pa.RecordBatch:
        columns = [np.concatenate(c) if c else np.zeros(0, bool if n == "many" else np.int64) for n, c in zip(names, out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    single = rows.mapInArrow(batches, "w_a long, w_b long, key_a long, key_b long, first long, many boolean")
    single = materialize(single, "windows")
    where = F.struct("key_a", "key_b", "first")
    often = single.groupBy("w_a", "w_b").agg(F.min(where).alias("low"), F.max(where).alias("high"), F.max("many").alias("m"))
    often = materialize(often.where("m or low <> high").select("w_a", "w_b"), "often")
    found = single.where("not many").join(often, ["w_a", "w_b"], "left_semi")
    return found.select("key_a", "key_b", "first", (F.col("first") + length).alias("end"))


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key_a", "key_b", "first", "end"])


def repeated_spans(docs: DataFrame, *, text_col: str = "text", length: int = 200) -> DataFrame:
    """(key_a, key_b, first, end): byte ranges to remove from each distinct text; they may overlap."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    rows = _anchor_rows(docs, text_col, length)
    counted = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    counted = materialize(counted.where("n > 1").select(F.col("h").alias("r"), (F.col("low") != F.col("high")).alias("mixed")), "anchors")
    found = rows.join(counted, F.col("h") == F.col("r")).drop("r")
    found = materialize(found, "repeated")

    mixed = found.where("mixed").groupBy("h", "c").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key_a", "key_b", "place")).alias("at"), F.max("loose").alias("loose")
    )
    mixed = materialize(mixed, "mixed")
    crowd = mixed.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWDED)
    crowd = materialize(crowd.select(F.col("h").alias("full")), "crowd")
    wanted = mixed.join(F.broadcast(crowd) if crowd.count() <= BROADCAST_ROWS else crowd, F.col("h") == F.col("full"), "left")
    # the least place of equal surroundings stands for them
    wanted = wanted.select("at.key_a", "at.key_b", "at.place", "h", (F.col("n") > 1).alias("many"), "loose", F.col("full").isNotNull().alias("crowded"))
    parts = _surroundings(docs, wanted.where("not crowded"), text_col, length).repartition("g").sortWithinPartitions("g")
    fine = materialize(_sorted_spans(parts, length), "fine")
    wanted = wanted.where("crowded")
    if not crowd.isEmpty():
        fine = fine.unionByName(_single_windows(_surroundings(docs, wanted, text_col, length), length))

    often = mixed.where("n > 1").select(F.col("h").alias("r"), F.col("c").alias("s"))
    equal = found.where("not mixed").unionByName(
        found.where("mixed").join(often, (F.col("h") == F.col("r")) & (F.col("c") == F.col("s")), "left_semi")
    )
    first = F.greatest(F.col("place") - (length - GRAM), F.lit(0))
    end = F.least(F.col("place") + length, F.col("size"))
    equal = equal.select("key_a", "key_b", first.alias("first"), end.alias("end"))
    return equal.unionByName(fine)


def remove_repeats(
    docs: DataFrame, *, text_col: str = "text", length: int = 200, kept_col: str = "kept_bytes", keep_text: bool = True
) -> DataFrame:
    """``docs`` with the bytes that are left of each text, and n_bytes, n_removed, n_spans in a struct ``repeats``.

    ``keep_text=False`` leaves out the text and what is left of it; the struct holds the digest of that anyway.
    """
    spans = repeated_spans(docs, text_col=text_col, length=length).distinct().groupBy("key_a", "key_b")
    spans = spans.agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    # a table of its own, so that the rows of a text with very many copies are split
    spans = materialize(spans.select(F.col("key_a").alias("span_a"), F.col("key_b").alias("span_b"), "spans"), "spans")
    held, names, labels = numbered(docs, "repeats", *([kept_col] * keep_text))
    text = names[docs.columns.index(text_col)]
    key_a, key_b = text_key(F.col(text))
    read = held.select(*names, key_a, key_b)
    read = read.join(spans, (F.col("key_a") == F.col("span_a")) & (F.col("key_b") == F.col("span_b")), "left")
    read = read.select(*names, "spans")
    labels = [(n, c) for n, c in labels if keep_text or n != text]
    kept = [n for n, _ in labels]
    own = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])
    fields = [T.StructField(n, read.schema[n].dataType) for n in kept]
    fields += [T.StructField("kept", T.BinaryType())] * keep_text + [T.StructField("repeats", own)]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            left, info = [], []
            for value, found in zip(b.column(text).to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = (value or "").encode("utf-8", "replace")
                rest, runs = cut_out(raw, [(s["first"], s["end"]) for s in found or ()])
                left.append(rest)
                info.append({"n_bytes": len(raw), "n_removed": len(raw) - len(rest), "n_spans": runs, "kept_sha256": hashlib.sha256(rest).hexdigest()})
            struct = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
            arrays = [*(b.column(n) for n in kept), *([pa.array(left, pa.binary())] * keep_text), pa.array(info, struct)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    out = read.mapInArrow(batches, T.StructType(fields))
    return out.toDF(*[c for _, c in labels], *([kept_col] * keep_text), "repeats")


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``raw`` without the spans, and the number of maximal runs cut out."""
    left, at, runs, reached = [], 0, 0, -1
    for first, end in sorted(spans):
        if first > reached:
            runs += 1
            left.append(raw[at:first])
        reached = max(reached, end)
        at = reached
    left.append(raw[at:])
    return b"".join(left), runs
